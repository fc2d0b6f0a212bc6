"""The training-data operators: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corkboard.llm import bpe, exactdedup, imatch, jaccard, langid, mixing, quality, tokencount, tokenstore, warc
from corkboard.llm.common import id_remainder, shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rep string, id long"
HUB, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 60, 250]))) for _ in range(60)]
    out = list(base)
    for t in base[:40]:  # near copies, each of one or two words changed
        w = t.split()
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    odd = [None, "", " ", "\n\t", "a", "A a", "<|endoftext|> x<|endoftext|>", "漢字 ՘ ࢏ 1²½", "x" * 5000, "it's  'll \r\n\r\n end ", "long word " * 3000]
    return out + odd + base[:5] * 3 + odd


@pytest.fixture(scope="module")
def docs(spark):
    items = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", 0, "clash", "clash", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(items, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_exact(docs, empty):
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in enumerate(texts()):
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    found = by_id(exactdedup.dedup(docs))
    for i, t in enumerate(texts()):
        g = groups[strip(t)]
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (min(g)[1], len(g), min(g)[1] == i)
        assert found[i].text_sha256 == hashlib.sha256(strip(t).encode()).hexdigest()
    assert exactdedup.dedup(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 30000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    f = exactdedup.FuseFilter.from_bytes(exactdedup.FuseFilter.of(keys).to_bytes())
    assert f.might_hold(keys).all()
    assert f.might_hold(np.arange(20_000, dtype=np.uint64)).mean() < 0.02


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, empty, width, percent):
    import re

    sets = []
    for t in texts():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    found = by_id(jaccard.join(docs, width, percent))
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(sets))] == [(len(s), top(i)) for i, s in enumerate(sets)]
    assert jaccard.join(empty).count() == 0


def test_jaccard_sketches():
    """A sketch's distance never exceeds that of the sets, and is near it for sets that are nearly linked."""
    rng = np.random.default_rng(5)
    for size, edits in ((40, 3), (700, 60), (5000, 500), (5000, 900)):
        base = rng.integers(0, 1 << 64, size, np.uint64)
        other = np.concatenate([base[edits:], rng.integers(0, 1 << 64, edits, np.uint64)])
        sets = [np.unique(base), np.unique(other)]
        flat, bounds = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        band = np.searchsorted(jaccard.bands(85)[0], [size, size], "right") - 1
        x, y = (np.frombuffer(b, np.uint64) for b in jaccard._sketch_bits(flat, bounds, np.array([0, 1]), band, 85))
        apart = np.bitwise_count(x ^ y).sum(dtype=np.int64)
        assert 0.85 * 2 * edits - 3 <= apart <= 2 * edits


def test_jaccard_blocks(spark, monkeypatch):
    """A passage that many documents share, most of them otherwise different: compared in blocks, the same links."""
    monkeypatch.setattr(jaccard, "LARGE", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for g in range(20):
        own = [f"g{g}w{i}" for i in range(40)]
        for c in range(3):
            words = list(own)
            words[rng.randrange(40)] = f"x{g}c{c}"
            texts[3 * g + c] = passage + " " + " ".join(words)
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in texts.items())}
    least = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if v == old else v for k, v in least.items()}
    found = jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == least


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(HUB)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts()]
    for head in (10, 300_000):  # with and without a tail that is joined
        found = by_id(tokencount.count(docs, HUB, head))
        assert [(found[i].n_tokens, found[i].n_bytes) for i in range(len(ids))] == [(len(x), len((t or "").encode())) for x, t in zip(ids, texts(), strict=True)]
    path = shared_path(spark, "test-tokens")
    tokenstore.write(docs, HUB, path)
    found, start = by_id(tokenstore.summary(spark, path)), 0
    for i, x in enumerate(ids):
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes()))
        start += len(x) + 1
    assert tokencount.count(empty, HUB).count() == 0


def test_bpe(docs, empty):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    found, encoded = by_id(bpe.round_trip(docs, RANKS, P.PATTERN)), by_id(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN))
    for i, t in enumerate(texts()):
        ids = library.encode_ordinary(t or "")
        assert encoded[i].ids == ids and bytes(encoded[i].decoded) == (t or "").encode()
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_quality_and_language(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.labelled(d.filter(id_remainder("doc_id", 4) != 2), labels))
    held = quality.score(d, model).join(labels, "doc_id").filter(id_remainder("doc_id", 4) == 2).toPandas()
    assert (held.predicted == held.quality).mean() > 0.85
    speech = langid.fit(d.filter(id_remainder("doc_id", 3) != 1))
    held = langid.predict(d, speech).filter(id_remainder("doc_id", 3) == 1).toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.95
    odd = by_id(langid.predict(docs, speech))
    assert {odd[i].lang_pred for i, t in enumerate(texts()) if not any(c.isalpha() for c in t or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, quality.fit(quality.labelled(empty, labels))).count() == 0 and langid.predict(empty, langid.fit(empty)).count() == 0


def test_mixing(docs, empty):
    m = mixing.mix(docs, repeats=2.0, entropy=0.99).toPandas()
    assert set(m.doc_id) == set(range(len(texts())))  # without a budget every document is taken
    assert m.groupby("doc_id").size().max() <= 2 and not m.duplicated(["doc_id", "mix_epoch"]).any()
    cut = mixing.mix(docs, passes=0.5).toPandas()
    whole = docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("t")).toPandas()
    for source, total in zip(whole.source, whole.t, strict=True):
        got = cut[cut.source.isna() if source is None else cut.source == source].mix_tokens.sum()
        assert got <= total / 2
    assert mixing.mix(empty, repeats=2.0).count() == 0


def test_fingerprints(docs, empty):
    found, all_texts = by_id(imatch.compare(docs)), [t or "" for t in texts()]
    n = len(all_texts)
    for i, t in enumerate(all_texts):
        k = len(t) // 3
        edited = t[: len(t) - k] + all_texts[(i - 1) % n][:k]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(t)
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    for i in range(n):
        for j in range(i):
            if all_texts[i] == all_texts[j]:
                assert found[i].fingerprint == found[j].fingerprint
    assert imatch.compare(empty).count() == 0


def test_warc(spark):
    long = "é<p>" * 40_000
    pages = [(1, "u", "x" * 1000), (2, "u\r\nv", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long + "\r\n\r\nWARC/1.1\r\n")]
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    found = {r.page_id: r for r in warc.pages(spark, path).collect()}
    assert [(found[1].record_type, found[1].refers_to), found[2].record_type, found[3].record_type] == [("revisit", 2), "response", "response"]
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest, found[i].sound) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert i == 1 or bytes(found[i].payload) == raw
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
