"""The training-data operators on odd rows (null and repeated ids, clashing columns, empty tables), their files' footers, and
fingerprints recomputed by hand."""

import gc
import math
import re
import struct
import types

import public_tokenizers as P
import pyarrow as pa
import pyarrow.orc
import pyspark.sql.types
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corkboard.llm import bpe, exactdedup, imatch, jaccard, langid, mixing, quality, tokencount, tokenstore, warc
from corkboard.llm.common import shared_path, utf8

HUB, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, row string, bucket string, kept string"
ROWS = [(None, "a null id", "en", "s"), (None, None, "en", None), (7, "one two three", "en", "s"), (7, "one two three", "en", "s"), (7, "another text of seven", None, "s"), (8, "", "de", "t"), (9, "one two  three", "en", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "clash", "clash", "clash", "clash", "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rows_stay(spark, odd, empty):
    """Every operator gives a row for each row, whatever its id; and none for none."""
    speech = langid.fit(odd)
    model = quality.fit(quality.labelled(odd, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")))
    path = shared_path(spark, "odd-tokens")
    tokenstore.write(odd, HUB, path)
    none = shared_path(spark, "no-tokens")
    tokenstore.write(empty, HUB, none)
    found = {
        "quality": (quality.score(odd, model), quality.score(empty, model)),
        "tokens": (tokenstore.summary(spark, path), tokenstore.summary(spark, none)),
        "language": (langid.predict(odd, speech), langid.predict(empty, speech)),
        "counts": (tokencount.count(odd, HUB), tokencount.count(empty, HUB)),
        "jaccard": (jaccard.join(odd), jaccard.join(empty)),
        "fingerprints": (imatch.compare(odd), imatch.compare(empty)),
        "bpe": (bpe.round_trip(odd, RANKS, P.PATTERN, True), bpe.round_trip(empty, RANKS, P.PATTERN)),
        "dedup": (exactdedup.dedup(odd), exactdedup.dedup(empty)),
    }
    for name, (some, no) in found.items():
        assert (name, sorted(r.doc_id or 0 for r in some.collect()), no.count()) == (name, [0, 0, 7, 7, 7, 8, 9], 0)
    starts = [(r.start, r.n_tokens) for r in found["tokens"][0].orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert {(r.doc_id, r.component_id) for r in found["jaccard"][0].collect()} == {(None, None), (7, 7), (8, 8), (9, 7)}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found["dedup"][0].collect()} == {(None, None, 1), (None, 8, 2), (8, 8, 2), (7, 9, 3), (9, 9, 3), (7, 7, 1)}


def test_mix_blocks(spark, odd):
    kept = [c for c in odd.columns if c != "row"] + ["row"]
    assert mixing.mix(odd.select(*kept), repeats=2.0, block_tokens=8).select(*kept).distinct().count() == 6
    docs = spark.createDataFrame([(i, "w " * (1 + i % 3), "ab"[i % 4 == 0]) for i in range(200)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, passes=1.5, block_tokens=8).toPandas()
    for _, part in mixed.groupby("source"):
        last = part.mix_epoch.max()
        full = part[part.mix_epoch == 0].sort_values("mix_order")
        assert (full.mix_block.diff().dropna() >= 0).all()  # a block's documents stay together
        cut = part[part.mix_epoch == last]
        blocks = {d: b for d, b in zip(part.doc_id, part.mix_block, strict=True)}
        assert len(cut) < len(full) and cut.mix_block.max() <= len(set(full.mix_block)) and set(range(cut.mix_block.max())) >= set(cut.mix_block) - {cut.mix_block.max()}
        assert len(blocks) == len(full)
    first = mixed[mixed.mix_epoch == 0].set_index("doc_id").mix_block
    other = mixed[mixed.mix_epoch == 1].set_index("doc_id").mix_block
    assert (first.loc[other.index] != other).any()  # epochs have permutations of their own
    for bits in (0, 1, 5):
        rows = spark.range(1 << bits).select(mixing.permuted(3, F.lit("s"), F.lit(4).cast("long"), F.col("id"), F.lit(bits)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(1 << bits))
    with pytest.raises(ValueError):
        mixing.mix(docs, passes=5.0, repeats=2.0)


def scanned(df):
    """Rows that the scan of a frame without shuffles hands on, before any filter of Spark's."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files(spark):
    """Row indexes prune row groups by their least and greatest id; Bloom filters deny an id between two that are there."""
    docs = spark.range(0, 80_000, 2).select(F.col("id").alias("doc_id"), F.lit("a few words of text").alias("text")).repartition(3)
    path, bare = shared_path(spark, "orc"), shared_path(spark, "orc-without")
    tokenstore.write(docs, HUB, path)
    tokenstore.encode(docs, HUB).write.options(**{"orc.row.index.stride": str(tokenstore.ROWS_AN_INDEX), "orc.compress": "ZSTD"}).orc(bare)
    f = pyarrow.orc.ORCFile(spark.read.orc(path).inputFiles()[0].removeprefix("file://"))
    assert f.row_index_stride == tokenstore.ROWS_AN_INDEX and f.compression.lower() == "zstd" and f.nrows > 2 * tokenstore.ROWS_AN_INDEX

    def read(where, rule):
        return scanned(spark.read.orc(where).filter(rule).select("doc_id"))

    there, absent = "doc_id = 12346", "doc_id = 12345"
    assert tokenstore.read(spark, path).filter(there).count() == 1 and tokenstore.read(spark, path).filter(absent).count() == 0
    assert (read(path, there), read(path, absent), read(bare, absent)) == (1000, 0, 1000)  # one row group, none by the Bloom filter, one without it
    spark.conf.set("spark.sql.orc.filterPushdown", "false")
    try:
        assert read(path, there) == 40_000
    finally:
        spark.conf.unset("spark.sql.orc.filterPushdown")


def test_stripes_are_read_in_parallel(spark, monkeypatch):
    """One file of several stripes is several tasks, and each row comes once."""
    monkeypatch.setattr(tokenstore, "STRIPE_BYTES", 1 << 16)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    path = shared_path(spark, "stripes")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        tokenstore.write(docs, HUB, path)
        found = tokenstore.read(spark, path)
        files = found.inputFiles()
        assert len(files) == 1 and pyarrow.orc.ORCFile(files[0].removeprefix("file://")).nstripes > 3
        own = found.select("doc_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in own) == 60_000 and len(own) > 3 and found.select("doc_id").distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_components(spark, monkeypatch):
    """Two families that share a passage: members of one family are never paired, and the result is that of all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join(passage + [f"f{f}w{i}" for i in range(30 + 30 * f)] + [f"x{f}n{n}"]) for f in range(2) for n in range(60)]
    found = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    across = 100 * len(sets[0] & sets[60]) >= 85 * len(sets[0] | sets[60])
    assert {r.component_id for r in found} == ({0} if across else {0, 60})
    keys = jaccard._often(jaccard.np.array([1, 1, 1, 1, 1, 1, 2, 2]), jaccard.np.array([5, 4, 3, 2, 1, 6, 1, 2]))
    assert [k > 0 for k in keys] == [True, True, True, True, False, False, False, False]


def _by_hand(texts, share_of, words):
    def terms(t):
        return [x for x in dict.fromkeys(regex.split(r"[^\p{L}\p{N}]+", t.lower())) if x]

    def one(t):
        own = terms(t)
        scale = min(4, max(0, math.floor(math.log(max(len(own) * share_of, 1.0) / 16) / math.log(4) + 0.5)))
        subsets = {}
        for term in own:
            h = xxhash.xxh64_intdigest(term.encode(), 42)
            for k in range(scale, 5):
                if term in words and h % 4**k == 0:
                    subsets.setdefault((h >> (10 + 4 * k)) % 16 + 16 * k, []).append(term)
        out = f"{scale}:"
        for s in sorted(subsets):
            h = 0
            for term in sorted(x.encode() for x in subsets[s]):
                h = xxhash.xxh64_intdigest(f"{s:02X}".encode() + term, xxhash.xxh64_intdigest(struct.pack("<Q", h), 42))
            out += f"{s:02X}{h:016x}"[:2] + f"{h:016x}"[-6:]
        return out

    def alike(a, b):
        if a == b:
            return 1.0
        scale = max(int(a.split(":")[0]), int(b.split(":")[0]))
        x, y = ({e for e in re.findall(".{8}", p.split(":")[1]) if 16 * scale <= int(e[:2], 16) < 16 * scale + 16} for p in (a, b))
        subsets = {e[:2] for e in x | y}
        return len(x & y) / len(subsets) if subsets else 0.0

    return terms, one, alike


def test_fingerprints_by_hand(spark):
    from tests.llm.test_llm import texts as some

    texts = [re.sub("[\u0558\u088f]", "", t or "") for t in some()]  # the JVM's Unicode tables and regex's differ on these
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    terms, _, _ = _by_hand(texts, 1, set())
    df = {}
    for t in texts:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
    most = max(2, int(imatch.MOST_SHARE * len(texts)))
    words = {x for x, n in df.items() if 2 <= n <= most}
    share = sum(df[x] for x in words) / sum(df.values())
    _, one, alike = _by_hand(texts, share, words)
    for task_bytes in (1 << 25, 2000):  # one bucket, and many
        imatch.TASK_BYTES, before = task_bytes, imatch.TASK_BYTES
        found = {r.doc_id: r for r in imatch.compare(docs).collect()}
        imatch.TASK_BYTES = before
        for i, t in enumerate(texts):
            k = len(t) // 3
            edited = t[: len(t) - k] + texts[i - 1][:k]
            assert (found[i].fingerprint, found[i].edited_fingerprint) == (one(t), one(edited))
            assert found[i].near_edited == pytest.approx(alike(one(t), one(edited))) and found[i].near_next == pytest.approx(alike(one(t), one(texts[i - 1])))


def test_no_row_carries_the_lexicon(spark, odd):
    plan = imatch.compare(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS table#" not in plan


def test_warc_odd(spark, monkeypatch):
    rows = [(None, "u", "z" * 2000, "clash"), (3, "u", "z" * 2000, "clash"), (3, "u", "z" * 2000, "clash"), (1, "v", "z" * 2000, "clash"), (4, None, None, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string").coalesce(1)
    path, again = shared_path(spark, "odd-warc"), shared_path(spark, "odd-warc")
    warc.write(pages, path)
    warc.write(pages, again)
    found = sorted((r.page_id or 0, r.record_type, r.refers_to, r.sound) for r in warc.pages(spark, path).collect())
    assert found == [(0, "revisit", 3, True), (1, "revisit", 3, True), (3, "response", None, True), (3, "response", None, True), (4, "response", None, True)]
    ids = [sorted(r.record_id for r in warc.read(spark, p).collect()) for p in (path, again)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 5  # a repeated task writes the same records
    none = shared_path(spark, "no-warc")
    warc.write(pages.limit(0), none)
    assert warc.pages(spark, none).count() == 0


def test_warc_files_are_bounded(spark):
    """Files follow the bytes of their records; every record has an id of its own, and each revisit refers to one that is there."""
    big = "".join(chr(97 + i % 26) for i in range(30_000))
    rows = [(i, f"http://h/{i}", f"{i % 1150} {big}") for i in range(1300)] + [(5000, "http://h/a", "x" * 2000), (5000, "http://h/a", "x" * 2000), (4000, "http://h/b", "x" * 2000), (None, "http://h/n", "x" * 2000)]
    path = shared_path(spark, "warc-files")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()
    assert len(files) > 1 and max(f.length for f in files) < 34 << 20
    read = warc.read(spark, path).drop("block")
    ids = [r.record_id for r in read.collect()]
    assert len(ids) == len(set(ids))
    told = warc.pages(spark, path)
    assert told.filter("NOT sound").count() == 0
    assert told.filter("record_type = 'revisit'").count() == 152 and told.filter("page_id = 5000 AND record_type = 'response'").count() == 2
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    refers = {f["warc-refers-to"] for r in raw for f, _ in warc.parse(bytes(r.content)) if "warc-refers-to" in f}
    assert len(refers) == 150 and refers <= set(ids)


def test_bytes_are_compared(spark, monkeypatch):
    """Texts of one digest and one length, but other bytes, are refused, not merged."""
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string")
    groups = exactdedup.grouped(exactdedup.digests(docs))
    exactdedup.check_bytes(groups, exactdedup.snapshot(groups), docs)
    assert exactdedup.dedup(docs).filter("kept").count() == 5
    many = spark.createDataFrame([(i, f"text {i:04d}") for i in range(600)], "doc_id long, text string")
    assert exactdedup.dedup(many).filter("kept").count() == 600
    monkeypatch.setattr(exactdedup, "_digest", lambda n: F.rpad(F.substring(F.sha2(F.encode(n, "UTF-8"), 256), 1, 1), 64, "0"))  # 16 digests
    with pytest.raises(ValueError, match="differ"):
        exactdedup.dedup(many)


def test_pipeline_gives_memory_back(spark, odd, monkeypatch):
    """Encoding leaves no model in its workers; near duplicates are sought in small batches, which other plans don't get."""
    corpus_pipeline.encode_stage(spark, odd, "").collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([bpe.byte_bpe.cache_info().currsize] * batch.num_rows, pa.int64())})

    assert {r.n for r in spark.range(64).mapInArrow(held, "n long").collect()} == {0}
    key, asked, join = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.join
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "join", lambda *a, **b: asked.append(spark.conf.get(key)) or join(*a, **b))
    corpus_pipeline.near_stage(spark, odd, "")
    assert asked == ["1000"] and spark.conf.get(key) == before


def test_texts_without_nulls_are_not_copied():
    texts = pa.array(["one", "", "three"])
    assert utf8(texts)[0].ctypes.data == texts.buffers()[2].address
    data, offsets = utf8(pa.array(["one", None, "three"]).slice(1))
    assert bytes(data) == b"three" and offsets.tolist() == [0, 0, 5]


def test_token_files_look_for_no_cycles(monkeypatch):
    """Encoding token files doesn't run the cycle collector, which is on again after it."""
    task = []
    frame = types.SimpleNamespace(mapInArrow=lambda f, schema: task.append(f), schema={"doc_id": pyspark.sql.types.StructField("doc_id", pyspark.sql.types.LongType())})
    frame.select = frame.repartitionByRange = frame.sortWithinPartitions = lambda *columns: frame
    on = []
    monkeypatch.setattr(tokenstore, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokenstore, "hub_tokenizer", lambda file: types.SimpleNamespace(encode=lambda texts: on.append(gc.isenabled()) or [b""] * len(texts)))
    monkeypatch.setattr(tokenstore, "F", types.SimpleNamespace(coalesce=lambda *c: types.SimpleNamespace(alias=str), lit=str))
    tokenstore.encode(frame, HUB)
    found = list(task[0]([pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["a", ""])})]))
    assert on == [False] and gc.isenabled() and found[0].column("before").to_pylist() == [0, 1]


def test_pipeline_stages(spark, odd, empty, tmp_path):
    spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, str(tmp_path))
        assert (name, found.columns, [f.dataType for f in found.schema]) == (name, odd.columns, [f.dataType for f in odd.schema])
        assert {r.score for r in found.collect()} <= {"clash"} and stage(spark, empty, str(tmp_path)).count() == 0
    kept = corpus_pipeline.exact_stage(spark, odd, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[0][0] == 0
    encoded = corpus_pipeline.encode_stage(spark, odd, str(tmp_path)).collect()
    assert all(len(r.ids) == r.n_tokens for r in encoded) and len(encoded) == len(ROWS)


def test_order_of_the_mix(spark, tmp_path):
    """The last stage tells the mix's order though the files between are of unequal size, which Spark reads by size."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 97 * 40 if i % 3 else 1)), "en", "abc"[min(i % 7, 2)], i) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.files.openCostInBytes": "1"}.items():
        spark.conf.set(k, v)
    try:
        corpus_pipeline.mix_stage(spark, docs, "").write.parquet(f"{tmp_path}/mix")
        stage = spark.read.parquet(f"{tmp_path}/mix")
        found = corpus_pipeline.encode_stage(spark, stage, "")
        rows = found.select("doc_id", "mix_place").collect()
        mixed = mixing.mix(docs, entropy=0.95, repeats=2.0).withColumn("spread", F.xxhash64("source", "mix_epoch", "mix_block"))
        want = [r.doc_id for r in mixed.orderBy("mix_epoch", "spread", "source", "mix_order").collect()]
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(stage.inputFiles()) > 4 and len({r.mix_place for r in rows}) == len(rows) == len(want) > 600
    assert [r.doc_id for r in rows] != want and [r.doc_id for r in sorted(rows, key=lambda r: r.mix_place)] == want


def _xx(seed, *values):
    """Spark's xxhash64 of whole numbers (those below 2**31 given as ints of 4 bytes where marked) and texts."""
    h = 42
    for v in (seed, *values):
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def _mixed_by_hand(rows, passes, entropy, repeats, block_tokens, seed=1):
    """What a mix takes: (doc_id, source, epoch, place of the block) of each, in whole numbers and plain loops."""
    tokens = {}
    for _, text, source in rows:
        tokens[source] = tokens.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    total, least = sum(tokens.values()), min(tokens.values())

    def weights(a):
        p = {s: (t / total) ** a for s, t in tokens.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def bisect(ok, low, below):
        lo, hi = low, 1.0
        for _ in range(50):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if ok(m) == below else (lo, m)
        return lo if below else hi

    exponent = bisect(lambda a: -sum(w * math.log(w) for w in weights(a).values()) >= entropy * math.log(len(tokens)), 0.0, True)
    seldom = lambda a: min(weights(a).values()) * passes * total / least <= repeats
    if not seldom(exponent):
        exponent = bisect(seldom, exponent, False)
    out = set()
    for source, weight in weights(exponent).items():
        want = weight * passes * total
        epochs = math.floor(want / tokens[source] + 1e-9)
        rest = max(0.0, want - epochs * tokens[source])
        bits = math.ceil(math.log2(max(tokens[source] / block_tokens, 1.0)))
        low, half = (1 << bits) - 1, (bits + 1) // 2 + (bits == 0)

        def place(h, epoch):
            x = ((h & ((1 << 64) - 1)) >> (64 - bits)) if bits else 0
            for k in range(3):
                draw = _xx((seed,), (k,), source, epoch)
                x = (x * ((draw & low) | 1) + (((draw & ((1 << 64) - 1)) >> 20) & low)) & low
                x ^= x >> half
            return x

        own = sorted((place(h, epochs), h, i, n) for i, h, n in ((i, _xx((seed,), i, t), len(t.split())) for i, t, s in rows if s == source))
        for e in range(epochs):
            out |= {(i, source, e, place(h, e)) for _, h, i, _ in own}
        through = 0
        for b, h, i, n in own:
            through += n
            if rest > 0.5 and through <= rest:
                out.add((i, source, epochs, b))
    return exponent, out


def test_mix_by_hand(spark):
    """Exponent, repeats, permutations and what the last, cut epoch takes."""
    rows = [(i, "w " * (1 + i % 9), "abcd"[min(i % 16, 3)]) for i in range(1, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for passes, entropy, repeats in ((2.0, 0.9995, 9.0), (2.5, 0.99, 5.0), (0.4, 0.8, 1.0), (1.0, 0.6, 1.0)):
        found = mixing.mix(docs, passes=passes, entropy=entropy, repeats=repeats, block_tokens=32).collect()
        exponent, want = _mixed_by_hand(rows, passes, entropy, repeats, 32)
        got = {(r.doc_id, r.source, r.mix_epoch, r.mix_block) for r in found}
        assert len(got) == len(found) and got == want
        if passes > 1:
            assert exponent < 0.9 and max(e for _, _, e, _ in want) > 1
