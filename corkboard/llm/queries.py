"""The queries of this subpackage, one for each operator, over the whole of its tables."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.llm import bpe, exactdedup, filteraudit, hostrules, imatch, importance, jaccard, langid, mixing, quality, tokencount, tokenstore, warc
from corkboard.llm.common import documents, id_remainder, shared_path, ship


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many tokens as there are, weights of 0.9995 of the greatest entropy, no source more than four times, in blocks of
    about 512 tokens. Null sources are one, null texts have no tokens; an empty table gives none."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), passes=2.0, entropy=0.9995, repeats=4.0, block_tokens=512)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_tokens", "mix_weight")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose remainder isn't 2, scores all."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.labelled(docs.filter(id_remainder("doc_id", 4) != 2), labels))
    return quality.score(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; rows of one doc_id follow one another. An empty table gives none."""
    path = shared_path(spark, "token-files")
    tokenstore.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokenstore.summary(spark, path)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose remainder isn't 1, predicts all."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(id_remainder("doc_id", 3) != 1))
    return langid.predict(docs.drop("lang"), model).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens; rows of one doc_id stay apart. An empty table gives none."""
    counts = tokencount.count(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are linked with nothing, nor are rows without doc_id; rows that share one count as one document. An
    empty table gives none."""
    return jaccard.join(documents(spark, sf_dir), width=4, percent=85)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows of one doc_id follow one another by a hash of the text. An empty table gives none."""
    return imatch.compare(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null payloads are empty; rows of one page_id are records each. An empty table gives none."""
    path = shared_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.pages(spark, path).drop("payload")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids, and digests of nothing. An empty table gives none."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those of white space, are one group; a null doc_id comes after others. An empty table gives none."""
    return exactdedup.dedup(documents(spark, sf_dir))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts. Null texts have no words, null sources are the host of the empty name; no documents, no rows."""
    found = hostrules.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "verdict")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty ones, null sources the part of the empty name; no documents, no rows."""
    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words at least, towards the benchmark's words. Null texts have no features; no documents,
    no rows."""
    return importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: White space and words as in the contract.
OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, true AS sound FROM g
"""

_RUN = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER f" for k in range(1, 8)]])
_R = {r: f"(f_{r} + w_{r} * p_{r}) / (n_docs + w_{r})" for r in ("base", "symbols", "lines", "repeats")}


def _prior_sql(rule: str) -> str:
    """p_ and w_ of a rule, from sums of hosts."""
    return f"""F_{rule} / N AS p_{rule}, CASE WHEN F_{rule} IN (0, N) THEN 1.0 WHEN p_{rule} * (1 - p_{rule}) * (1 - nn / N ** 2 - (k - 1) / N) <= 1e-12 THEN N
    ELSE CASE WHEN (S_{rule} / N - p_{rule} ** 2 - p_{rule} * (1 - p_{rule}) * (k - 1) / N) / (p_{rule} * (1 - p_{rule}) * (1 - nn / N ** 2 - (k - 1) / N)) <= 1 / (N + 1) THEN N
      ELSE greatest(1.0, 1 / ((S_{rule} / N - p_{rule} ** 2 - p_{rule} * (1 - p_{rule}) * (k - 1) / N) / (p_{rule} * (1 - p_{rule}) * (1 - nn / N ** 2 - (k - 1) / N))) - 1) END END AS w_{rule}"""


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
runs AS (SELECT doc_id, i, {_RUN} AS run FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run) > 1 AS twice FROM runs),
covered AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM twice),
rep AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM covered GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(lw.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN lw USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines, 100 * n_repeat_words > 15 * n_words AS repeats FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n_docs, {", ".join(f"CAST(count(*) FILTER ({r}) AS DOUBLE) AS f_{r}" for r in _R)} FROM r GROUP BY host),
s AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n_docs) AS N, sum(n_docs ** 2) AS nn, {", ".join(f"sum(f_{r}) AS F_{r}, sum(f_{r} ** 2 / n_docs) AS S_{r}" for r in _R)} FROM h),
p AS (SELECT {", ".join(_prior_sql(r) for r in _R)} FROM s),
rates AS (SELECT host, {", ".join(f"{x} AS r_{r}" for r, x in _R.items())} FROM h, p),
v AS (SELECT r.*, greatest({", ".join(f"r_{r}" for r in _R)}) AS host_rate, CASE WHEN base THEN 'base' WHEN greatest({", ".join(f"r_{r}" for r in _R)}) > {hostrules.HOST_LIMIT} THEN 'host'
  {" ".join(f"WHEN {r} AND r_{r} > {hostrules.RULE_LIMIT} THEN '{r}'" for r in list(_R)[1:])} END AS verdict FROM r JOIN rates USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, verdict IS NULL AS kept, round(host_rate, 6) AS host_rate, verdict FROM v
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
b AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM f LEFT JOIN b USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
bits(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
st AS (SELECT filter_order, step, bit, coalesce((SELECT sum(y.bit) FROM bits y WHERE strpos(filter_order, y.l) < step), 0) AS before FROM o, range(1, 6) g(step), bits z WHERE z.l = substr(filter_order, CAST(step AS BIGINT), 1)),
a AS (SELECT part, filter_order, step, n, good, toxic, mask & bit > 0 AS fails, mask & CAST(before AS INT) > 0 AS gone, mask = bit AS only_this, mask FROM c, st)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (only_this), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (fails), 0) AS BIGINT) AS shapley FROM a GROUP BY part, filter_order, step
"""

_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _buckets_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, word, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{importance.WORD}')) AS word FROM {table}) GROUP BY ALL)"


OP13_SQL = f"""
WITH dw AS {_buckets_sql("documents", "doc_id")}, bw AS {_buckets_sql("benchmark", "item_id")},
k AS (SELECT word, {_CRC} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""

_QUERIES = [op1_mixing, op2_quality, op3_token_files, op4_language, op5_token_counts, op6_jaccard_join, op7_fingerprints, op8_warc, op9_byte_bpe, op10_exact_dedup, op11_host_rules, op12_filter_audit, op13_importance]


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run: token ids of what its stages keep. An empty table gives none."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": _shipped(pipeline)} | {q.__name__: _shipped(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_host_rules": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_importance": OP13_SQL}
