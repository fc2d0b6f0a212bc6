"""The registered queries of the note engine, over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.functions.storage import ship
from corkboard.functions.text import STOPWORDS, excerpt, path_key, sanitised
from corkboard.operators import changes, discovery, export, graph, index, search, sections, trails
from corkboard.sources import corpus

QUERY, LIMIT, BUDGET, AS_OF = "tion ering onon erth ondethe inre thing", 10, 40000, "2026-01-01"
SHELF = "rack-cd onon tion"
THRESHOLD = 0.16
NOTE = 1_000_000_001  # a customer
NATION, OTHER_NATION = 103, 118
CLUB_MEMBER = 1_000_000_010

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# ---- SQL of the tables that queries start from ----------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _terms_sql(source: str) -> str:
    """terms(section_id, note_id, term, term_count) of sections(section_id, note_id, heading, text)."""
    return f"""
raw AS (SELECT section_id, note_id, replace(lower(unnest(regexp_extract_all(concat_ws(' ', heading, text), '[A-Za-z0-9][A-Za-z0-9_''’-]+'))), '’', '''') AS t FROM {source}),
terms AS (SELECT section_id, note_id, t AS term, count(*) AS term_count FROM raw WHERE length(t) > 2 AND t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+')
  AND length(regexp_replace(t, '[^0-9]', '', 'g')) < 4 AND NOT regexp_full_match(regexp_replace(t, '[-_]', '', 'g'), '[0-9a-f]{{8,}}') GROUP BY ALL)"""


_NOTES = """notes AS (SELECT d.doc_id AS note_id, d.doc_id AS section_id, source || '/doc_' || d.doc_id || '.md' AS relative_path,
  'Document ' || d.doc_id AS title, 'Shelf rack-' || translate(CAST(d.doc_id % 100 AS VARCHAR), '0123456789', 'bcdfghjklm') AS heading,
  CASE quality WHEN 1 THEN 'canonical' WHEN 0 THEN 'draft' END AS status, lang AS domain, text, make_timestamp((1577836800 + d.doc_id % 1500 * 86400 + d.doc_id * 7919 % 86400) * 1000000) AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _age_sql(since: str) -> str:
    return f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({since})) / 86400000000.0"


def _search_sql(limit: int, text: str = QUERY, whole: bool = False) -> str:
    capped = "" if whole else f" WHERE place <= {max(2000, 400 * limit)}"
    wanted = ", ".join(f"('{t}', {n})" for t, n in sorted(search.query_terms(text).items()))
    return f"""{_NOTES}, {_terms_sql("notes")},
q(term, times) AS (VALUES {wanted}),
found AS (SELECT t.*, times, row_number() OVER (ORDER BY term_count DESC, section_id, t.term) AS place FROM terms t JOIN q ON t.term = q.term),
df AS (SELECT term, count(DISTINCT note_id) AS df FROM found GROUP BY term),
n AS (SELECT count(*) AS n FROM notes),
ranked AS (SELECT section_id, sum((ln(term_count) + 1) * (ln((n + 1) / (df + 1)) + 1) * times) AS raw, min(place) AS place, string_agg(f.term, ' ' ORDER BY f.term) AS matched_terms
  FROM found f JOIN df ON f.term = df.term, n{capped} GROUP BY section_id),
top AS (SELECT *, row_number() OVER (ORDER BY round(raw, 9) DESC, place) AS rank FROM ranked QUALIFY rank <= {limit}),
hits AS (SELECT rank, t.section_id, note_id, round(raw * CASE WHEN status = 'canonical' THEN 1.1 ELSE 1.0 END, 6) AS score, matched_terms, relative_path, status, domain, heading, text, updated_at
  FROM top t JOIN notes USING (section_id))"""


# ---- retrieval ------------------------------------------------------------------------------------------------------


@query(f"WITH {_search_sql(LIMIT)} SELECT rank, note_id, score, matched_terms, relative_path || ':1-1' AS citation FROM hits")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top sections for a query, with citations."""
    hits = search.cited(search.search(corpus.document_index(spark, sf_dir), QUERY, LIMIT))
    return hits.select("rank", "note_id", "score", "matched_terms", "citation")


@query(f"WITH {_search_sql(40, SHELF)} SELECT rank, note_id, score, matched_terms, heading FROM hits")
def search_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for a word that only headings have, and others."""
    hits = search.search(corpus.document_index(spark, sf_dir), SHELF, 40)
    return hits.select("rank", "note_id", "score", "matched_terms", "heading")


_PACKET_STEPS = f"""first AS (SELECT rank, text FROM hits),
walk AS (SELECT CAST(1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, CAST(NULL AS VARCHAR) AS passage, false AS truncated
UNION ALL SELECT w.rank + 1, w.used + length(p.passage), w.kept + 1, p.passage, p.truncated FROM walk w JOIN first f ON f.rank = w.rank,
  LATERAL (SELECT length(f.text) > {BUDGET} - w.used AS truncated, CASE WHEN length(f.text) > {BUDGET} - w.used THEN regexp_replace(substr(f.text, 1, {BUDGET} - w.used - 1), '\\s+$', '') || '…' ELSE f.text END AS passage) p
  WHERE {BUDGET} - w.used > 0 AND (w.kept = 0 OR {BUDGET} - w.used >= 80) AND w.kept < {LIMIT}),
packet AS (SELECT h.rank, section_id, note_id, score, relative_path, truncated, CAST(length(passage) AS BIGINT) AS characters, passage FROM walk w JOIN hits h ON h.rank = w.rank - 1)"""
_PACKET = f"{_search_sql(2 * LIMIT)}, {_PACKET_STEPS}"


@query(f"WITH RECURSIVE {_search_sql(2 * LIMIT, whole=True)}, {_PACKET_STEPS} SELECT rank, section_id, score, relative_path, truncated, characters, sha256(passage) AS passage_sha256, relative_path || ':1-1' AS citation FROM packet")
def context_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited passages within a budget; the one at its end is cut."""
    packet = search.packet(corpus.document_index(spark, sf_dir), QUERY, LIMIT, BUDGET, whole=True)
    cited = search.cited(packet.withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1)))
    return cited.select("rank", "section_id", "score", "relative_path", "truncated", "characters", F.sha2("passage", 256).alias("passage_sha256"), "citation")


_DOC_LINKS = """dl AS (SELECT doc_id AS source_id, doc_id // 2 AS target_id, 'wikilink' AS kind, 2 AS line FROM documents WHERE doc_id % 3 = 0 AND doc_id // 2 <> doc_id AND doc_id // 2 IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, doc_id // 3, 'markdown_link', 1 FROM documents WHERE doc_id % 9 = 0 AND doc_id // 3 <> doc_id AND doc_id // 3 IN (SELECT doc_id FROM documents))"""


@query(f"""WITH RECURSIVE {_PACKET}, {_DOC_LINKS}, near AS (SELECT * FROM dl WHERE source_id IN (SELECT note_id FROM packet) OR target_id IN (SELECT note_id FROM packet))
SELECT source_id, target_id, kind, line, a.relative_path AS source_path, a.title AS source_title, b.relative_path AS target_path, b.title AS target_title, true AS is_verified, 1.0 AS score, count(*) OVER () AS total, count(*) OVER () > 200 AS truncated
FROM near JOIN notes a ON a.note_id = source_id JOIN notes b ON b.note_id = target_id ORDER BY source_id, line LIMIT 200""")
def packet_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at a packet's notes, with both notes and the number of all."""
    held = corpus.document_index(spark, sf_dir)
    packet = search.packet(held, QUERY, LIMIT, BUDGET)
    return graph.incident(graph.all_edges(corpus.document_links(spark, sf_dir)), packet, notes=held.notes()).drop("place")


@query(f"""WITH {_search_sql(8 * LIMIT)}, {_DOC_LINKS}, ends AS (SELECT source_id AS me FROM dl UNION ALL SELECT target_id FROM dl), deg AS (SELECT me, count(*) AS degree FROM ends GROUP BY me),
a AS (SELECT note_id, relative_path, score, coalesce(degree, 0) AS degree, greatest(0, {_age_sql('updated_at')}) AS age, max(score) OVER () AS most FROM hits LEFT JOIN deg ON me = note_id),
s AS (SELECT note_id, relative_path, age AS age_days, degree AS verified_degree, round(0.65 * score / most + 0.25 * least(1.0, age / 730) + 0.10 / (1 + degree), 6) AS resurface_score FROM a WHERE age >= 30)
SELECT * FROM s ORDER BY resurface_score DESC, note_id LIMIT {LIMIT}""")
def resurface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dormant notes that answer a query; those of few links first."""
    return search.resurface(corpus.document_index(spark, sf_dir), graph.degrees(corpus.document_links(spark, sf_dir)), QUERY, LIMIT, AS_OF)


@query(f"WITH {_NOTES}, {_terms_sql('notes')} SELECT term, count(DISTINCT note_id) AS df, CAST(sum(term_count) AS BIGINT) AS n FROM terms GROUP BY term")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.frequency(corpus.document_index(spark, sf_dir).postings())


@query(f"""WITH s AS (SELECT conv_id * 1000 + turn AS section_id, conv_id AS note_id, role AS heading, text FROM conversations), {_terms_sql("s")}
SELECT note_id, count(DISTINCT section_id) AS sections, count(DISTINCT term) AS terms, CAST(sum(term_count) AS BIGINT) AS occurrences FROM terms GROUP BY note_id""")
def conversation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of many sections: conversations and their turns."""
    t = search.terms(corpus.turns(spark, sf_dir))
    return t.groupBy("note_id").agg(F.count_distinct("section_id").alias("sections"), F.count_distinct("term").alias("terms"), F.sum("term_count").alias("occurrences"))


@query(f"""WITH {_NOTES}, {_terms_sql("notes")} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM terms) AS postings, (SELECT count(DISTINCT term) FROM terms) AS terms,
(SELECT CAST(sum(term_count) AS BIGINT) FROM terms) AS occurrences""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus.document_index(spark, sf_dir)
    by_term = held.postings().groupBy("term").agg(F.count("*").alias("p"), F.sum("term_count").alias("n"))
    t = by_term.agg(F.sum("p").alias("postings"), F.count("*").alias("terms"), F.sum("n").alias("occurrences"))
    return t.select(F.lit(held.n_notes()).alias("notes"), "postings", "terms", "occurrences")


@query("SELECT source || '/doc_' || doc_id || '.md' AS path, CASE WHEN length(t) > 280 THEN regexp_replace(substr(t, 1, 279), '\\s+$', '') || '…' ELSE t END AS summary FROM (SELECT *, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}\\x{200B}-\\x{200F}\\x{2028}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}]', '', 'g') AS t FROM documents)")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised excerpts."""
    return corpus.notes(spark, sf_dir).select(F.col("relative_path").alias("path"), excerpt(sanitised(F.col("text")), 280).alias("summary"))


# ---- discovery ------------------------------------------------------------------------------------------------------

#: After notes and terms.
_VECTOR_STEPS = """n AS (SELECT count(*) AS n FROM notes),
counts AS (SELECT note_id, term, sum(term_count) AS c FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
top AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY c DESC, term) AS k FROM counts QUALIFY k <= 80),
w AS (SELECT note_id, t.term, (ln(c) + 1) * (ln((n + 1) / (df + 1)) + 1) AS w FROM top t JOIN df ON t.term = df.term, n WHERE df BETWEEN 2 AND greatest(4, ceil(n / 5.0))),
v AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY note_id)) AS norm FROM w)"""
_BEST = """sides AS (SELECT l AS me, r AS other, * FROM scored UNION ALL SELECT r AS me, l AS other, * FROM scored),
cand AS (SELECT DISTINCT l, r, shared, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY round(score, 9) DESC, other DESC) AS k FROM sides) WHERE k <= 8)"""
_CANDIDATE_STEPS = f"""{_VECTOR_STEPS},
post AS (SELECT term, note_id, row_number() OVER (PARTITION BY term ORDER BY note_id) - 1 AS pos, count(*) OVER (PARTITION BY term) AS sz FROM v),
off AS (SELECT term, note_id, (pos + o) % sz AS at FROM (SELECT *, unnest(range(1, least(12, sz - 1) + 1)) AS o FROM post WHERE sz > 1)),
pairs AS (SELECT DISTINCT least(a.note_id, b.note_id) AS l, greatest(a.note_id, b.note_id) AS r FROM off a JOIN post b ON a.term = b.term AND a.at = b.pos WHERE a.note_id <> b.note_id),
scored AS (SELECT l, r, count(*) AS shared, sum(x.w * y.w) / max(x.norm * y.norm) AS score FROM pairs JOIN v x ON l = x.note_id JOIN v y ON r = y.note_id AND x.term = y.term GROUP BY l, r
  HAVING shared >= 2 AND round(score, 9) >= {THRESHOLD}),
{_BEST}"""
#: The same of all pairs.
_WHOLE_STEPS = f"""{_VECTOR_STEPS},
scored AS (SELECT x.note_id AS l, y.note_id AS r, count(*) AS shared, sum(x.w * y.w) / max(x.norm * y.norm) AS score FROM v x JOIN v y ON x.term = y.term AND x.note_id < y.note_id GROUP BY x.note_id, y.note_id
  HAVING shared >= 2 AND round(score, 9) >= {THRESHOLD}),
{_BEST}"""


_CANDIDATES = f"{_NOTES}, {_terms_sql('notes')}, {_CANDIDATE_STEPS}"
_WHOLE_CANDIDATES = f"{_NOTES}, {_terms_sql('notes')}, {_WHOLE_STEPS}"
_RANKED = """e AS (SELECT l, r, x.term, round(-x.w * y.w, 9) AS p FROM cand JOIN v x ON l = x.note_id JOIN v y ON r = y.note_id AND x.term = y.term),
k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY p, term) AS k FROM e)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = corpus.document_index(spark, sf_dir)
    return discovery.vectors(held.terms(), held.n_notes(), held.postings()), held.notes()


@query(f"WITH {_CANDIDATES} SELECT * FROM cand")
def discovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.candidates(_vectors(spark, sf_dir)[0], THRESHOLD)


@query(f"WITH {_WHOLE_CANDIDATES}, {_RANKED} SELECT l, r, string_agg(term, ' ' ORDER BY k) AS terms FROM k WHERE k <= 8 GROUP BY l, r")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = _vectors(spark, sf_dir)
    return discovery.shared_evidence(discovery.candidates(v, THRESHOLD, whole=True), v)


@query(f"""WITH {_NOTES}, {_terms_sql("notes")}, d AS (SELECT term, count(DISTINCT note_id) AS df FROM terms GROUP BY term), m AS (SELECT greatest(4, ceil(count(*) / 5.0)) AS most FROM notes)
SELECT count(*) AS total_terms, count(*) FILTER (df BETWEEN 2 AND most) AS usable_terms, count(*) FILTER (df < 2) AS too_rare, count(*) FILTER (df > most) AS too_common FROM d, m""")
def discovery_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus.document_index(spark, sf_dir)
    return discovery.diagnostics(held.postings(), held.n_notes())


@query(f"""WITH {_CANDIDATES}, {_DOC_LINKS}, e AS (SELECT l AS note_id FROM cand UNION ALL SELECT r FROM cand), c AS (SELECT note_id, count(*) AS candidates FROM e GROUP BY note_id HAVING count(*) >= 2),
ends AS (SELECT source_id AS me FROM dl UNION ALL SELECT target_id FROM dl), deg AS (SELECT me, count(*) AS degree FROM ends GROUP BY me)
SELECT note_id, candidates, coalesce(degree, 0) AS degree FROM c LEFT JOIN deg ON me = note_id WHERE coalesce(degree, 0) <= 1""")
def island_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, notes = _vectors(spark, sf_dir)
    return trails.islands(graph.degrees(corpus.document_links(spark, sf_dir)), discovery.candidates(v, THRESHOLD), notes)


@query(f"""WITH {_CANDIDATES}, d AS (SELECT note_id, {_age_sql('updated_at')} AS days FROM notes)
SELECT note_id, days, round(0.15 * least(days / 365, 1.0), 6) AS age_bonus FROM d WHERE days >= 180 AND note_id IN (SELECT l FROM cand UNION SELECT r FROM cand)""")
def dormant_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, notes = _vectors(spark, sf_dir)
    return trails.dormant(notes, discovery.candidates(v, THRESHOLD), AS_OF)


# ---- graph ----------------------------------------------------------------------------------------------------------

_NAMES = """placed AS (SELECT *, replace(n_name, ' ', '%20') AS n_link, replace(r_name, ' ', '%20') AS r_link FROM nation JOIN region ON n_regionkey = r_regionkey),
gb AS (SELECT CAST(r_regionkey AS BIGINT) AS note_id, 'regions/' || r_name || '.md' AS path, r_name AS title, 'region' AS domain, '# ' || r_name AS body, CASE WHEN r_regionkey = 2 THEN '---' || chr(10) || 'aliases: [日本, Far East]' || chr(10) || '---' || chr(10) ELSE '' END AS front FROM region
UNION ALL SELECT 100 + n_nationkey, 'nations/' || n_name || '.md', n_name, 'nation', '# ' || n_name || chr(10) || 'Part of [its region](regions/' || r_link || '.md)' || CASE WHEN n_nationkey % 2 = 0 THEN ' #segment/BUILDING' ELSE '' END
  || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) || 'Also [up](../regions/' || r_link || '.md)' ELSE '' END, '' FROM placed
UNION ALL SELECT 1000000 + s_suppkey, 'suppliers/' || s_name || '.md', s_name, 'supplier', '# ' || s_name || chr(10) || 'Based in [[' || n_name || '|home]]' || CASE WHEN s_suppkey % 7 = 0 THEN chr(10) || 'Once of [[Missing ' || s_suppkey || ']]' ELSE '' END
  || CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || 'By name [it](' || n_link || '.md)' ELSE '' END || CASE WHEN s_suppkey % 6 = 1 THEN chr(10) || 'See [[中文]]' ELSE '' END
  || CASE WHEN s_suppkey % 4 = 0 THEN chr(10) || '```' || chr(10) || '[[Nowhere]] #hidden' || chr(10) || '```' ELSE '' END,
  CASE WHEN s_suppkey % 3 = 0 THEN '---' || chr(10) || 'tags: [partner, ''Key Account'']' || chr(10) || 'aliases: Firm ' || s_suppkey || chr(10) || '---' || chr(10) ELSE '' END FROM supplier JOIN placed ON s_nationkey = n_nationkey
UNION ALL SELECT 1000000000 + c_custkey, 'customers/' || c_name || '.md', c_name, 'customer', '# ' || c_name || chr(10) || 'See [[' || n_name || ']] #segment/' || c_mktsegment
  || CASE WHEN c_custkey % 10 = 0 THEN chr(10) || 'In [[' || r_link || ']] #club/c' || c_custkey % 7 ELSE '' END || CASE WHEN c_custkey % 20 = 0 THEN chr(10) || 'Through [[Firm ' || 3 * (1 + c_custkey % 3) || ']]' ELSE '' END, '' FROM customer JOIN placed ON c_nationkey = n_nationkey),
g AS (SELECT note_id, path, title, domain, front || body AS text, body, length(front) - length(replace(front, chr(10), '')) AS o FROM gb)"""
#: What each link is by the rules: names and paths from the top resolve, a path that goes up out of the top doesn't, nor does a
#: name without Latin letters; in fences there are none.
_LINKS = f"""{_NAMES}, su AS (SELECT *, 1000000 + s_suppkey AS note_id, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END AS o, CAST(s_suppkey % 7 = 0 AS INT) AS m7, CAST(s_suppkey % 5 = 0 AS INT) AS m5 FROM supplier JOIN placed ON s_nationkey = n_nationkey),
cu AS (SELECT *, 1000000000 + c_custkey AS note_id FROM customer JOIN placed ON c_nationkey = n_nationkey),
lk AS (SELECT 100 + n_nationkey AS note_id, 2 AS line, 0 AS place, 'markdown_link' AS kind, 'regions/' || r_link || '.md' AS target, CAST(n_regionkey AS BIGINT) AS target_id, NULL AS reason FROM placed
UNION ALL SELECT 100 + n_nationkey, 3, 0, 'markdown_link', '../regions/' || r_link || '.md', NULL, 'path_outside_vault' FROM placed WHERE n_nationkey % 5 = 0
UNION ALL SELECT 100 + n_nationkey, 2, 1, 'tag', 'segment/BUILDING', NULL, NULL FROM placed WHERE n_nationkey % 2 = 0
UNION ALL SELECT note_id, 2, 0, 'tag', 'partner', NULL, NULL FROM su WHERE o > 0 UNION ALL SELECT note_id, 2, 1, 'tag', 'Key Account', NULL, NULL FROM su WHERE o > 0
UNION ALL SELECT note_id, o + 2, 0, 'wikilink', n_name, 100 + n_nationkey, NULL FROM su
UNION ALL SELECT note_id, o + 3, 0, 'wikilink', 'Missing ' || s_suppkey, NULL, 'not_found' FROM su WHERE m7 = 1
UNION ALL SELECT note_id, o + 3 + m7, 0, 'markdown_link', n_link || '.md', 100 + n_nationkey, NULL FROM su WHERE m5 = 1
UNION ALL SELECT note_id, o + 3 + m7 + m5, 0, 'wikilink', '中文', NULL, 'not_found' FROM su WHERE s_suppkey % 6 = 1
UNION ALL SELECT note_id, 2, 0, 'wikilink', n_name, 100 + n_nationkey, NULL FROM cu
UNION ALL SELECT note_id, 2, 1, 'tag', 'segment/' || c_mktsegment, NULL, NULL FROM cu
UNION ALL SELECT note_id, 3, 0, 'wikilink', r_link, n_regionkey, NULL FROM cu WHERE c_custkey % 10 = 0
UNION ALL SELECT note_id, 3, 1, 'tag', 'club/c' || c_custkey % 7, NULL, NULL FROM cu WHERE c_custkey % 10 = 0
UNION ALL SELECT note_id, 4, 0, 'wikilink', 'Firm ' || 3 * (1 + c_custkey % 3), 1000000 + 3 * (1 + c_custkey % 3), NULL FROM cu WHERE c_custkey % 20 = 0)"""
_EDGES = f"""{_LINKS}, e AS (SELECT note_id AS source_id, target_id, kind, min(line) AS line, arg_min(place, line) AS place, arg_min(target, line) AS target_text FROM lk WHERE target_id IS NOT NULL GROUP BY note_id, target_id, kind),
b AS (SELECT source_id AS me, target_id AS other, 'out' AS direction FROM e UNION ALL SELECT target_id, source_id, 'in' FROM e),
tg AS (SELECT DISTINCT note_id, lower(target) AS tag FROM lk WHERE kind = 'tag')"""


@query(f"WITH {_EDGES} SELECT source_id, target_id, kind, line, place FROM e")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed from Markdown and resolved; the SQL takes the foreign keys they were written from."""
    return graph.edges(corpus.linked_notes(spark, sf_dir)).drop("target_text", "source_text")


@query(f"WITH {_LINKS} SELECT note_id, path, line, kind, target, reason FROM lk JOIN g USING (note_id) WHERE reason IS NOT NULL")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unresolved(corpus.linked_notes(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT note_id, path, line, kind, target, reason, count(*) OVER () AS total FROM lk JOIN g USING (note_id) WHERE reason IS NOT NULL ORDER BY path, line LIMIT 10")
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unresolved links and the number of all."""
    return graph.doctor(corpus.linked_notes(spark, sf_dir), 10)


_LINKED_TERMS = f"{_EDGES}, sections AS (SELECT note_id AS section_id, note_id, title AS heading, substr(body, strpos(body, chr(10)) + 1) AS text FROM g WHERE domain <> 'region'), notes AS (SELECT note_id FROM g), {_terms_sql('sections')}"


@query(f"""WITH {_LINKED_TERMS}, {_CANDIDATE_STEPS} SELECT (SELECT count(*) FROM g) AS notes, (SELECT count(*) FROM sections) AS sections, (SELECT count(*) FROM e) AS verified_edges, (SELECT count(*) FROM cand) AS candidate_edges,
(SELECT count(*) FROM tg) AS note_tags, (SELECT count(*) FROM lk WHERE reason IS NOT NULL) AS unresolved_links""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As an index tells it that was told to discover candidates."""
    return corpus.linked_index(spark, sf_dir).discover(THRESHOLD).statistics().drop("version", "indexed_at")


@query(f"WITH {_LINKS} SELECT note_id, line, kind, target FROM lk")
def parse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links(corpus.linked_notes(spark, sf_dir)).select("note_id", "line", "kind", "target")


@query(f"""WITH {_LINKS}, t AS (SELECT DISTINCT target AS t FROM lk WHERE kind <> 'tag')
SELECT t, CASE WHEN t = '中文' THEN t ELSE lower(replace(regexp_replace(t, '[.]md$', ''), '%20', ' ')) END AS key FROM t""")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links name, and the keys by which it is looked up as a path."""
    found = corpus.linked_index(spark, sf_dir).live("links").filter("kind <> 'tag'")
    return found.select(F.col("target").alias("t")).distinct().withColumn("key", path_key(F.col("t")))


def _connections_sql(note: int, limit: int, tags: bool) -> str:
    fill = f"""UNION ALL SELECT 1 AS part, t.tag, t.n, y.path AS p, x.note_id, 'supporting', 'co_tag', false, round(1 / log2(n + 1), 6) FROM tg x JOIN tg o ON x.tag = o.tag AND o.note_id = {note} AND x.note_id <> {note}
      JOIN (SELECT tag, count(*) AS n FROM tg GROUP BY tag) t ON t.tag = x.tag JOIN g y ON y.note_id = x.note_id WHERE n <= 100""" if tags else ""
    return f"""WITH {_EDGES}, i AS (SELECT 0 AS part, lpad(CAST(source_id AS VARCHAR), 20, '0') || lpad(CAST(line AS VARCHAR), 9, '0') || lpad(CAST(place AS VARCHAR), 9, '0') || lpad(CAST(target_id AS VARCHAR), 20, '0') AS tag, 0 AS n, '' AS p,
      CASE WHEN source_id = {note} THEN target_id ELSE source_id END AS other, CASE WHEN source_id = {note} THEN 'outgoing' ELSE 'incoming' END AS direction, kind, true AS verified, 1.0 AS score FROM e WHERE source_id = {note} OR target_id = {note} {fill}),
    k AS (SELECT row_number() OVER (ORDER BY part, n, tag, p) AS place, *, count(*) OVER () AS total FROM i)
    SELECT place, other, path AS other_path, direction, kind, verified, CAST(score AS DOUBLE) AS score, total FROM k JOIN g ON other = g.note_id WHERE place <= {limit}"""


@query(_connections_sql(NATION, 20, False))
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a hub: the first of its edges and the number of all."""
    held = corpus.linked_index(spark, sf_dir)
    return graph.connections(graph.all_edges(held.edges()), held.notes(), NATION, 20)


@query(_connections_sql(CLUB_MEMBER, 15, True))
def connections_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a note of few edges: filled with notes of a common tag; the note is looked up by its name."""
    held = corpus.linked_index(spark, sf_dir)
    own = graph.resolve_note(held.notes(), "Customer#000000010", held.names())
    return graph.connections(graph.all_edges(held.edges()), held.notes(), own, 15, held.tags())


@query("""WITH t AS (SELECT p_partkey, lower(p_brand) AS tag, count(*) OVER (PARTITION BY p_brand) AS note_count FROM part)
SELECT b.tag, b.p_partkey AS other, b.note_count, round(1 / log2(b.note_count + 1), 6) AS score FROM t a JOIN t b ON a.tag = b.tag AND a.p_partkey <> b.p_partkey WHERE a.p_partkey = 1 AND b.note_count <= 100""")
def co_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts tagged with their brand; a brand of more than 100 parts tells nothing."""
    tags = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), F.lower("p_brand").alias("tag"))
    return graph.co_tags(tags, 1)


@query(f"WITH {_EDGES} SELECT tag, count(*) AS notes FROM tg GROUP BY tag")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.linked_index(spark, sf_dir).tags().groupBy("tag").agg(F.count("*").alias("notes"))


@query(f"WITH {_EDGES} SELECT me AS note_id, count(*) AS degree FROM b GROUP BY me")
def verified_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(corpus.linked_index(spark, sf_dir).edges())


_WALK = f"""{_EDGES}, ends AS (SELECT source_id AS me, target_id AS other, * FROM e UNION ALL SELECT target_id, source_id, * FROM e),
rk AS (SELECT me, other, kind, row_number() OVER (PARTITION BY me ORDER BY source_id, line, place, target_id) AS rank, count(*) OVER (PARTITION BY me) AS size FROM ends),
k AS (SELECT me, other, min(rank) AS rank, arg_min(kind, rank) AS kind FROM rk WHERE rank <= 1000 GROUP BY me, other),
w(note_id, hops) AS (SELECT CAST({NATION} AS BIGINT), 0 UNION SELECT other, hops + 1 FROM w JOIN k ON note_id = me WHERE hops < 6), far AS (SELECT note_id, min(hops) AS hops FROM w GROUP BY note_id)"""


@query(f"WITH RECURSIVE {_WALK} SELECT note_id, hops FROM far")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from a nation to what six hops reach."""
    return graph.reached(graph.all_edges(corpus.linked_index(spark, sf_dir).edges()), NATION).select("note_id", "hops")


#: Of the shortest ways, as lists of the ranks of edges, the first one; a hub that was looked at before it was met cuts the search.
_PATH = f"""{_WALK}, goal AS (SELECT hops FROM far WHERE note_id = {OTHER_NATION}),
on_way(note_id, hops) AS (SELECT CAST({OTHER_NATION} AS BIGINT), (SELECT hops FROM goal) UNION SELECT k.me, o.hops - 1 FROM on_way o JOIN k ON k.other = o.note_id JOIN far f ON f.note_id = k.me AND f.hops = o.hops - 1),
ways(note_id, hops, way, kinds, nodes) AS (SELECT CAST({NATION} AS BIGINT), 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), [CAST({NATION} AS BIGINT)]
  UNION ALL SELECT k.other, w.hops + 1, list_append(w.way, k.rank), list_append(w.kinds, k.kind), list_append(w.nodes, k.other) FROM ways w JOIN k ON k.me = w.note_id JOIN on_way o ON o.note_id = k.other AND o.hops = w.hops + 1),
best AS (SELECT * FROM ways WHERE note_id = {OTHER_NATION} ORDER BY way LIMIT 1),
firsts(note_id, hops, way) AS (SELECT CAST({NATION} AS BIGINT), 0, CAST([] AS BIGINT[]) UNION ALL SELECT * FROM (SELECT k.other AS note_id, w.hops + 1 AS hops, min(list_append(w.way, k.rank)) AS way FROM firsts w JOIN k ON k.me = w.note_id JOIN far f ON f.note_id = k.other AND f.hops = w.hops + 1 WHERE w.hops < (SELECT hops - 1 FROM goal) GROUP BY ALL)),
looked AS (SELECT f.note_id FROM firsts f, best b WHERE f.hops < b.hops - 1 OR (f.hops = b.hops - 1 AND f.way <= b.way[1:b.hops - 1]))"""


@query(f"""WITH RECURSIVE {_PATH} SELECT CAST(i AS INT) AS step, nodes[i] AS from_id, nodes[i + 1] AS to_id, kinds[i] AS kind, true AS verified, 1.0 AS score, true AS found, EXISTS (SELECT * FROM looked JOIN rk ON me = note_id WHERE size > 1000) AS search_truncated
FROM best, range(1, (SELECT hops + 1 FROM best)) t(i)""")
def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps from one nation to another."""
    return graph.path_between(graph.all_edges(corpus.linked_index(spark, sf_dir).edges()), NATION, OTHER_NATION)


@query(f"""WITH {_EDGES}, p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM e), m AS (SELECT p.a, p.b, count(DISTINCT x.other) AS n FROM p JOIN b x ON x.me = p.a JOIN b y ON y.me = p.b AND x.other = y.other GROUP BY ALL)
SELECT p.a, p.b, coalesce(n, 0) AS n FROM p LEFT JOIN m ON p.a = m.a AND p.b = m.b""")
def mutual_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutual_neighbours(corpus.linked_index(spark, sf_dir).edges())


@query(f"""WITH {_NAMES}, x AS (SELECT domain, sha256(path || ':' || sha256(text)) AS x FROM g), r AS (SELECT domain, substr(x, 1, 4) AS range, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY x)) AS d FROM x GROUP BY ALL)
SELECT domain, CAST(sum(n) AS BIGINT) AS notes, sha256(string_agg(d, chr(10) ORDER BY range)) AS digest FROM r GROUP BY domain""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.content_digest(corpus.linked_notes(spark, sf_dir))


@query(f"WITH {_EDGES}, d AS (SELECT me, count(*) AS degree FROM b GROUP BY me) SELECT note_id, path, domain, coalesce(degree, 0) AS degree, sha256(text) AS content_hash FROM g LEFT JOIN d ON note_id = me")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus.linked_index(spark, sf_dir)
    return held.notes().join(graph.degrees(held.edges()), "note_id", "left").select("note_id", "path", "domain", F.coalesce("degree", F.lit(0)).alias("degree"), "content_hash")


@query("""SELECT l_orderkey AS note_id, count(DISTINCT s_nationkey) AS domains, count(DISTINCT l_suppkey) AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY l_orderkey HAVING count(DISTINCT s_nationkey) >= 2""")
def bridge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes that link to their lines' suppliers, whose nations are the domains."""
    lines, suppliers = corpus.table(spark, sf_dir, "lineitem"), corpus.table(spark, sf_dir, "supplier")
    e = lines.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return graph.bridges(e, suppliers.select(F.col("s_suppkey").alias("note_id"), F.col("s_nationkey").alias("domain")))


@query(f"WITH {_EDGES}, d AS (SELECT count(*) AS degree FROM b GROUP BY me), s AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM d) SELECT degree AS value FROM s WHERE i = floor((n - 1) * 0.9)")
def degree_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.percentile(graph.degrees(corpus.linked_index(spark, sf_dir).edges()), "degree", 0.9)


@query(f"""WITH {_NAMES}, t AS (SELECT note_id, title AS heading, o, substr(body, strpos(body, chr(10)) + 1) AS text FROM g WHERE domain <> 'region')
SELECT note_id, 0 AS ordinal, heading, o + 2 AS line_start, o + 2 + length(text) - length(replace(text, chr(10), '')) AS line_end, text FROM t""")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their lines; the regions' headings have no text below and so no section."""
    return sections.sections(corpus.linked_notes(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT note_id, o + 1 AS line, 1 AS level, title AS text, '# ' || title AS source_text FROM g")
def heading_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.headings(corpus.linked_notes(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT note_id, line, kind, CASE WHEN line > g.o + 1 THEN 0 END AS ordinal FROM lk JOIN g USING (note_id)")
def covering_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each link and tag stands in."""
    notes = corpus.linked_notes(spark, sf_dir)
    return sections.covering(graph.links(notes).select("note_id", "line", "kind"), sections.sections(notes))


@query(f"""WITH {_EDGES}, d AS (SELECT me, count(*) AS degree FROM b GROUP BY me)
SELECT note_id, path, domain, coalesce(degree, 0) AS degree, CASE WHEN domain = 'region' THEN 0 ELSE 1 END AS section_count, sha256(text) AS content_hash, CASE WHEN domain <> 'region' THEN substr(body, strpos(body, chr(10)) + 1) END AS summary FROM g LEFT JOIN d ON note_id = me""")
def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = corpus.linked_notes(spark, sf_dir)
    return export.nodes(notes, graph.edges(notes), sections.sections(notes), True)


@query(f"""WITH {_EDGES}, p AS (SELECT DISTINCT source_id, target_id FROM e), nb AS (SELECT DISTINCT me, other FROM b),
m AS (SELECT source_id, target_id, count(*) AS n FROM p JOIN nb x ON x.me = source_id JOIN nb y ON y.me = target_id AND x.other = y.other GROUP BY ALL),
t AS (SELECT source_id, target_id, count(*) AS n FROM p JOIN tg x ON x.note_id = source_id JOIN tg y ON y.note_id = target_id AND x.tag = y.tag GROUP BY ALL)
SELECT p.source_id, p.target_id, CAST(least(coalesce(m.n, 0), 12) AS INT) AS mutual, coalesce(m.n, 0) AS mutual_total, CAST(least(coalesce(t.n, 0), 12) AS INT) AS shared_tags
FROM p LEFT JOIN m USING (source_id, target_id) LEFT JOIN t USING (source_id, target_id)""")
def export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notes and tags each edge's ends share; as many as are listed, and all."""
    notes = corpus.linked_notes(spark, sf_dir)
    out = export.edge_context(graph.edges(notes), graph.note_tags(notes))
    return out.select("source_id", "target_id", F.size("mutual").alias("mutual"), "mutual_total", F.size("shared_tags").alias("shared_tags"))


_GRAPH_IN = """n AS (SELECT o_orderkey AS position, 'c' || o_custkey AS id FROM orders), k AS (SELECT id, min(position) AS position FROM n GROUP BY id),
e AS (SELECT l_orderkey * 10 + l_linenumber AS position, 'p' || l_partkey AS id, 'c' || l_partkey AS source, 'c' || l_suppkey AS target FROM lineitem),
w AS (SELECT *, source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) AS whole FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS r FROM w WHERE whole)"""


def _graph_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as nodes and order lines as edges of a document whose ids repeat and whose ends are partly missing."""
    orders, lines = corpus.table(spark, sf_dir, "orders"), corpus.table(spark, sf_dir, "lineitem")
    nodes = orders.select(F.col("o_orderkey").alias("position"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    named = {"id": ("p", "l_partkey"), "source": ("c", "l_partkey"), "target": ("c", "l_suppkey")}
    edges = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), *[F.concat(F.lit(p), F.col(c).cast("string")).alias(n) for n, (p, c) in named.items()])
    return export.imported(nodes, edges)


@query(f"WITH {_GRAPH_IN} SELECT position, id, source, target FROM f WHERE r = 1")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_in(spark, sf_dir)[1]


@query(f"""WITH {_GRAPH_IN}, c AS (SELECT 'duplicate_node' AS reason, (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS n UNION ALL SELECT 'dangling_edge', count(*) FROM w WHERE NOT whole UNION ALL SELECT 'duplicate_edge', count(*) FROM f WHERE r > 1)
SELECT * FROM c WHERE n > 0""")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_in(spark, sf_dir)[2]


# ---- changes --------------------------------------------------------------------------------------------------------

_DIFF = """p AS (SELECT doc_id % 10 AS k, source || '/doc_' || doc_id || '.md' AS path, text FROM documents),
o AS (SELECT path, sha256(text) AS h FROM p WHERE k <> 3), n AS (SELECT CASE WHEN k = 7 THEN 'moved/' ELSE '' END || path AS path, sha256(text || CASE WHEN k = 5 THEN ' changed' ELSE '' END) AS h FROM p WHERE k <> 1),
c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS change, o.h AS old_hash, n.h AS new_hash FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h),
r AS (SELECT *, count(*) OVER (PARTITION BY old_hash) AS same FROM c WHERE change = 'removed'),
m AS (SELECT r.path AS old_path, a.path AS new_path, count(*) OVER (PARTITION BY r.path) AS candidates FROM r JOIN c a ON a.change = 'added' AND r.old_hash = a.new_hash WHERE same = 1)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*corpus.snapshots(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT * FROM c")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {_DIFF} SELECT * FROM m")
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.renames(_changes(spark, sf_dir))


@query("SELECT sha256(text) AS content_hash, count(*) AS paths, min(source || '/doc_' || doc_id || '.md') AS first_path FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.notes(spark, sf_dir)
    return changes.copies(n.select(F.col("relative_path").alias("path"), F.sha2("text", 256).alias("content_hash")))


@query(f"WITH {_DIFF} SELECT change, count(*) AS n FROM c GROUP BY change")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT 'vault' AS source, l_partkey || '.md' AS path, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ' ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS proposals FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def proposal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as proposals that edit a part's file."""
    edits = corpus.table(spark, sf_dir, "lineitem").select(F.lit("vault").alias("source"), F.concat(F.col("l_partkey").cast("string"), F.lit(".md")).alias("path"), F.col("l_suppkey").cast("string").alias("proposal_id"))
    return changes.conflicts(edits)


@query("SELECT CAST(user_id AS VARCHAR) AS source, 'u' || user_id % 5 AS path, arg_max(event_type, event_id) AS state FROM events GROUP BY ALL")
def latest_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return changes.latest(e.select(F.col("user_id").cast("string").alias("source"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("path"), F.col("event_type").alias("state"), F.col("event_id").alias("batch")))


@query(f"WITH {_EDGES} SELECT me AS note_id, direction, other FROM b WHERE me BETWEEN 100 AND 199 AND me % 3 = 0")
def references_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at nations whose id three divides, as if these had changed."""
    notes, edges = corpus.linked_notes(spark, sf_dir), corpus.linked_index(spark, sf_dir).edges()
    return changes.touched(edges, notes.filter("domain = 'nation' AND note_id % 3 = 0"))


@query("SELECT doc_id AS note_id, 1 AS line_start, 1 AS line_end, CASE WHEN doc_id % 10 = 1 THEN 'note_deleted' ELSE 'range_mismatch' END AS reason FROM documents WHERE doc_id % 10 IN (1, 5)")
def broken_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as cited sections, against notes that have gone or changed."""
    notes = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.element_at(F.split("text", "\r\n|\r|\n"), 1)
    cited = notes.select("note_id", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), first.alias("text"))
    now = notes.filter("note_id % 10 <> 1").withColumn("text", F.when(F.col("note_id") % 10 == 5, F.concat(F.lit("changed "), "text")).otherwise(F.col("text")))
    return changes.broken_citations(cited, now)


@query(f"WITH {_DIFF}, h AS (SELECT (SELECT count(*) FROM n) AS total, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS changed FROM c) SELECT added, removed, changed, total - added - changed AS unchanged FROM h")
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an export differs from the one before."""
    total = corpus.snapshots(spark, sf_dir)[1].count()
    c = _changes(spark, sf_dir).agg(*[F.count_if(F.col("change") == k).alias(name) for k, name in (("added", "added"), ("removed", "removed"), ("modified", "changed"))])
    return c.withColumn("unchanged", F.lit(total) - F.col("added") - F.col("changed"))


def _all() -> None:
    """Registers the queries of the other modules."""
    from corkboard.plans import change_queries, contract_queries, document_queries, trail_queries  # noqa: F401


def queries() -> dict:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
