"""Evidence of candidates, kinds and scores of trails, the tour; each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.operators import discovery, search, tour, trails
from corkboard.plans.queries import _CANDIDATE_STEPS, _CANDIDATES, _DOC_LINKS, _RANKED, _WHOLE_CANDIDATES, AS_OF, THRESHOLD, _age_sql, _terms_sql, _vectors, query
from corkboard.sources import corpus

# ---- conversations, whose notes have many sections ------------------------------------------------------------------

_TURNS = f"""s AS (SELECT conv_id * 1000 + turn AS section_id, conv_id AS note_id, role AS heading, turn + 1 AS line, text FROM conversations),
notes AS (SELECT DISTINCT note_id FROM s), {_terms_sql("s")}, {_CANDIDATE_STEPS}"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    turns = corpus.turns(spark, sf_dir)
    terms = stored(search.terms(turns), "terms")
    n = turns.select("note_id").distinct().count()
    return turns, terms, discovery.vectors(terms, n), n


@query(f"""WITH {_TURNS}, {_RANKED}, sd AS (SELECT l, r, 'l' AS side, l AS note_id, term FROM k WHERE k <= 8 UNION ALL SELECT l, r, 'r', r, term FROM k WHERE k <= 8),
o AS (SELECT l, r, side, section_id, sum(term_count) AS n FROM sd JOIN terms USING (note_id, term) GROUP BY ALL),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l, r, side ORDER BY n DESC, section_id) = 1)
SELECT l, r, side, section_id, 'conv_' || note_id || '.md:' || line || '-' || line AS citation, heading, sha256(regexp_replace(substr(text, 1, 500), '\\s+$', '') || CASE WHEN length(text) > 500 THEN '…' ELSE '' END) AS passage_sha256, length(text) > 500 AS truncated
FROM b JOIN s USING (section_id)""")
def candidate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both notes of each candidate pair of conversations, the turn that shares most of its terms."""
    turns, terms, vectors, _ = _turns(spark, sf_dir)
    ranked = discovery.ranked_terms(discovery.candidates(vectors, THRESHOLD), vectors)
    told = turns.withColumn("path", F.concat(F.lit("conv_"), F.col("note_id").cast("string"), F.lit(".md")))
    return discovery.best_passages(ranked, terms, told).select("l", "r", "side", "section_id", "citation", "heading", F.sha2("passage", 256).alias("passage_sha256"), "truncated")


@query(f"""WITH {_TURNS}, d AS (SELECT term, count(DISTINCT note_id) AS df FROM terms GROUP BY term), m AS (SELECT greatest(4, ceil(n / 5.0)) AS most, n.n AS notes FROM n),
c AS (SELECT count(*) AS total_terms, count(*) FILTER (df BETWEEN 2 AND most) AS usable_terms, count(*) FILTER (df < 2) AS too_rare, count(*) FILTER (df > most) AS too_common, max(notes) AS notes FROM d, m)
SELECT total_terms, usable_terms, too_rare, too_common, (SELECT count(*) FROM pairs) AS pairs_compared, (SELECT count(*) FROM cand) AS candidates,
CASE WHEN notes >= 20 AND (SELECT count(*) FROM cand) = 0 THEN 'no_candidates' END AS warning FROM c""")
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, terms, vectors, n = _turns(spark, sf_dir)
    return discovery.diagnostics_of(vectors, discovery.diagnostics(terms, n), discovery.candidates(vectors, THRESHOLD), n)


# ---- documents, which have links, tags, dates and candidates ----------------------------------------------------------

_NODES = f"""tn AS (SELECT note_id, coalesce(nullif(n.domain, ''), 'Unclassified') AS domain, n.updated_at AS modified, make_timestamp((epoch_us(n.updated_at) // 1000000 - note_id * 7 % 200 * 86400 - note_id * 104729 % 86400) * 1000000) AS created, source,
  regexp_split_to_array(lower('Document ' || note_id || ' ' || n.relative_path || ' ' || source || ' ' || coalesce(n.domain, '')), '[^\\p{{L}}\\p{{N}}]+') AS label FROM notes n JOIN documents ON doc_id = note_id),
{_DOC_LINKS}, nb AS (SELECT source_id AS me, target_id AS other FROM dl UNION SELECT target_id, source_id FROM dl),
ends AS (SELECT source_id AS me FROM dl UNION ALL SELECT target_id FROM dl),
deg AS (SELECT note_id, count(me) AS degree FROM tn LEFT JOIN ends ON me = note_id GROUP BY note_id),
p AS (SELECT degree AS p90 FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg) WHERE i = floor((n - 1) * 0.9)),
cen AS (SELECT note_id, degree, CASE WHEN p90 = 0 THEN 0 ELSE least(degree / p90, 1.0) END AS c FROM deg, p),
cx AS (SELECT least(s.domain, t.domain) AS a, greatest(s.domain, t.domain) AS b, count(*) AS n FROM dl JOIN tn s ON s.note_id = source_id JOIN tn t ON t.note_id = target_id WHERE s.domain <> t.domain GROUP BY ALL)"""
_FACT_STEPS = f"""{_RANKED}, {_NODES},
w1 AS (SELECT me AS f, me AS t FROM nb UNION SELECT me, other FROM nb), w2 AS (SELECT DISTINCT a.f, b.t FROM w1 a JOIN w1 b ON a.t = b.f), w3 AS (SELECT DISTINCT a.f, b.t FROM w2 a JOIN w1 b ON a.t = b.f),
rt AS (SELECT l, r, count(*) AS terms, count(*) FILTER (NOT list_contains(a.label, term) AND NOT list_contains(b.label, term)) AS surprise FROM k JOIN tn a ON a.note_id = l JOIN tn b ON b.note_id = r WHERE k <= 8 GROUP BY l, r),
mu AS (SELECT l, r, count(*) AS m FROM rt JOIN nb x ON x.me = l JOIN nb y ON y.me = r AND x.other = y.other GROUP BY ALL),
f AS (SELECT rt.l, rt.r, terms, surprise, a.domain <> b.domain AS far, w3.f IS NULL AS apart, abs(epoch_us(a.created) - epoch_us(b.created)) / 86400000000.0 AS gap, a.source = b.source AS tagged, least(coalesce(m, 0), 12) AS m,
  a.domain <> b.domain AND coalesce(cx.n, 0) <= 1 AS rare, least(a.modified, b.modified) AS older
  FROM rt JOIN tn a ON a.note_id = rt.l JOIN tn b ON b.note_id = rt.r LEFT JOIN w3 ON w3.f = rt.l AND w3.t = rt.r LEFT JOIN cx ON cx.a = least(a.domain, b.domain) AND cx.b = greatest(a.domain, b.domain) LEFT JOIN mu ON mu.l = rt.l AND mu.r = rt.r),
g AS (SELECT *, CAST(apart AS INT) + CAST(rare AS INT) + CAST(surprise >= 2 AS INT) + CAST(apart AND terms >= 3 AS INT) AS cnt, CAST(terms >= 2 AS INT) + CAST(tagged AS INT) + CAST(m > 0 AS INT) AS signals FROM f),
kd AS (SELECT *, 'parallel_invention' AS kind FROM g WHERE far AND gap <= 14 AND surprise >= 2 AND cnt >= 2 UNION ALL SELECT *, 'unwritten_link' FROM g WHERE apart
  UNION ALL SELECT *, 'distant_neighbors' FROM g WHERE rare UNION ALL SELECT *, 'reinforced' FROM g WHERE signals >= 2 AND cnt >= 2)"""
_FACTS, _WHOLE_FACTS = f"{_CANDIDATES}, {_FACT_STEPS}", f"{_WHOLE_CANDIDATES}, {_FACT_STEPS}"


def _candidates(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The documents' candidates, if whole of all pairs, with what speaks for them."""
    held = corpus.document_index(spark, sf_dir)
    nodes, vectors = corpus.trail_notes(spark, sf_dir), _vectors(spark, sf_dir)[0]
    ranked = stored(discovery.ranked_terms(discovery.candidates(vectors, THRESHOLD, whole=whole), vectors), "ranked")
    told = held.sections().join(nodes.select("note_id", "path"), "note_id").select("section_id", "path", "heading", "line_start", "line_end", "text")
    passages = discovery.best_passages(ranked, held.terms(), told)
    return stored(trails.evidenced(ranked, passages, nodes, corpus.document_links(spark, sf_dir)), "candidates")


@query(f"WITH {_CANDIDATES}, {_NODES} SELECT * FROM cx")
def domain_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.crossings(corpus.document_links(spark, sf_dir), corpus.trail_notes(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT l, r, kind FROM kd")
def trail_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = corpus.trail_notes(spark, sf_dir), corpus.document_links(spark, sf_dir)
    return trails.kinds(_candidates(spark, sf_dir), nodes, edges, trails.crossings(edges, nodes))


@query(f"""WITH {_WHOLE_FACTS}, sc AS (SELECT kd.*, 0.4 * least(terms / 6, 1.0) + 0.3 + 0.2 * CAST(tagged AS INT) + 0.1 * least(m / 3, 1.0) AS evidence, greatest(x.c, y.c) AS c,
  0.15 * least(greatest(0, {_age_sql('older')}) / 365, 1.0) AS age FROM kd JOIN cen x ON x.note_id = l JOIN cen y ON y.note_id = r WHERE surprise >= 2)
SELECT l, r, kind, round(evidence, 6) AS evidence, round(0.3 * CAST(apart AS INT) + 0.25 * CASE WHEN NOT far THEN 0.0 WHEN rare THEN 1.0 ELSE 0.6 END + 0.25 * evidence + 0.1 * c + age, 6) AS score FROM sc WHERE evidence >= 0.25""")
def trail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trails.scored(_candidates(spark, sf_dir, whole=True), corpus.trail_notes(spark, sf_dir), corpus.document_links(spark, sf_dir), AS_OF)
    return found.select("l", "r", "kind", F.round("evidence", 6).alias("evidence"), F.round("score", 6).alias("score"))


@query(f"""WITH {_CANDIDATES}, {_NODES}, ce AS (SELECT l AS note_id FROM cand UNION ALL SELECT r FROM cand), cc AS (SELECT note_id, count(*) AS n FROM ce GROUP BY note_id),
dm AS (SELECT source_id AS note_id, count(DISTINCT domain) AS d FROM dl JOIN tn ON target_id = tn.note_id GROUP BY source_id),
z AS (SELECT tn.note_id, c, degree, coalesce(n, 0) AS n, coalesce(d, 0) AS d, greatest(0, {_age_sql('modified')}) AS slept, (epoch_us(modified) - epoch_us(created)) / 86400000000.0 AS span FROM tn JOIN cen USING (note_id) LEFT JOIN cc USING (note_id) LEFT JOIN dm USING (note_id)),
t AS (SELECT note_id, 'bridge' AS kind, 0.25 + 0.1 * c + 0.1 AS score FROM z WHERE d >= 2 UNION ALL SELECT note_id, 'island', 0.06 + 0.1 * c + 0.1 FROM z WHERE degree <= 1 AND n >= 2
UNION ALL SELECT note_id, 'dormant', 0.1 * c + 0.1 * least(1.0, 0.4 + least(slept / 365, 1.0)) FROM z WHERE slept >= 180 AND n >= 1
UNION ALL SELECT note_id, 'drift', 0.1 * c + 0.1 * least(1.0, 0.5 + 0.3 * least(span / 365, 1.0)) FROM z WHERE span >= 90 AND n >= 1)
SELECT note_id, kind, round(score, 6) AS score FROM t""")
def structural_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = discovery.candidates(_vectors(spark, sf_dir)[0], THRESHOLD)
    found = trails.structural(corpus.trail_notes(spark, sf_dir), corpus.document_links(spark, sf_dir), candidates, AS_OF)
    return found.select("note_id", "kind", F.round("score", 6).alias("score"))


@query()
def trail_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tour of the documents' graph, or why there is none. No SQL: each choice follows from those before; tests hold it against
    a plain loop."""
    found, remark = tour.tour(corpus.trail_notes(spark, sf_dir), corpus.document_links(spark, sf_dir), _candidates(spark, sf_dir, whole=True), AS_OF)
    rows = [(i, t.kind, t.l, t.r, round(score, 6), remark) for i, (t, score) in enumerate(found)]
    return spark.createDataFrame(rows or [(None, None, None, None, None, remark)], "place int, kind string, source_id long, target_id long, score double, remark string")
