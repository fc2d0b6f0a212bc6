"""The driver's tables as notes, sections, links and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.functions.storage import shared_path, small
from corkboard.operators import index
from corkboard.operators import sections as sectioning


#: Bytes of a label's row in a hash table, about.
LABEL_BYTES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes of one section: note_id, path, relative_path, title, heading (one of a hundred shelves), status, domain, text,
    updated_at (a time of day as well)."""
    labels = small(table(spark, sf_dir, "labels").select("doc_id", "quality"), LABEL_BYTES)  # else all texts would move, once a table of the index
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    shelf = F.translate((F.col("doc_id") % 100).cast("string"), "0123456789", "bcdfghjklm")
    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("doc_id") % 1500 * 86_400 + F.col("doc_id") * 7919 % 86_400)  # 2020-01-01
    named = docs.withColumn("path", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")))
    return named.select(
        F.col("doc_id").alias("note_id"), "path", F.col("path").alias("relative_path"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("Shelf rack-"), shelf).alias("heading"), F.when(F.col("quality") == 1, "canonical").when(F.col("quality") == 0, "draft").alias("status"),
        F.col("lang").alias("domain"), "text", at.alias("updated_at"),
    )


def sections(notes: DataFrame) -> DataFrame:
    """The one section of each of notes: section_id, note_id, heading, line_start, line_end, text."""
    one = F.lit(1)
    return notes.select(F.col("note_id").alias("section_id"), "note_id", "heading", one.alias("line_start"), one.alias("line_end"), "text")


_built: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, name: str, notes: DataFrame, sections: DataFrame) -> index.Index:
    """The index of an application's tables: built by whoever asks first, opened by others."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _built:
        try:
            return index.open_index(spark, _built[key])
        except ValueError:
            del _built[key]  # its folder has gone
    found = index.build(spark, shared_path(spark, f"index-{name}"), notes, sections)
    _built[key] = found.root
    return found


def document_index(spark: SparkSession, sf_dir: str) -> index.Index:
    found = notes(spark, sf_dir)
    return _index(spark, sf_dir, "documents", found.drop("heading"), sections(found))


def linked_index(spark: SparkSession, sf_dir: str) -> index.Index:
    found = linked_notes(spark, sf_dir)
    held = sectioning.sections(found).withColumn("section_id", F.col("note_id") * 16 + F.col("ordinal"))  # a note of these has few
    return _index(spark, sf_dir, "linked", found, held)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes, each turn a section: section_id, note_id, heading, line_start, line_end, text."""
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), F.col("conv_id").alias("note_id"), F.col("role").alias("heading"), (F.col("turn") + 1).alias("line_start"), (F.col("turn") + 1).alias("line_end"), "text")


def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as Markdown notes that link along foreign keys: note_id, path, title, domain,
    text. Customers and suppliers link nations by name, nations their region by path from the top; every tenth customer also
    links its region by an escaped name, every twentieth a supplier by its alias. Every third supplier has frontmatter with an alias
    and tags, every fourth a fence with what looks like a link and a tag, every fifth names its nation in a Markdown link without a
    folder, every sixth links a name without Latin letters, every seventh one that isn't there, and every fifth nation goes up out
    of the folder. One region has aliases, one of them without Latin letters. Customers have their segment as a tag, every tenth a
    club besides; every second nation one of the segments."""
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))

    def when(condition, *text):
        return F.when(condition, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])).otherwise("")

    def escaped(name: str):
        return F.regexp_replace(name, " ", "%20")

    def note(df: DataFrame, first: int, key: str, name: str, domain: str, *text, head=None) -> DataFrame:
        body = F.concat(F.lit("# ") if head is None else F.concat(head, F.lit("# ")), F.col(name), *[F.lit(t) if isinstance(t, str) else t for t in text])
        return df.select((first + F.col(key)).cast("long").alias("note_id"), F.concat(F.lit(f"{domain}s/"), name, F.lit(".md")).alias("path"), F.col(name).alias("title"), F.lit(domain).alias("domain"), body.alias("text"))

    at = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))  # 25 nations, by definition
    up = when(F.col("n_nationkey") % 5 == 0, "\nAlso [up](../regions/", escaped("r_name"), ".md)")
    r = note(region, 0, "r_regionkey", "r_name", "region", head=when(F.col("r_regionkey") == 2, "---\naliases: [日本, Far East]\n---\n"))
    n = note(at, 100, "n_nationkey", "n_name", "nation", "\nPart of [its region](regions/", escaped("r_name"), ".md)", when(F.col("n_nationkey") % 2 == 0, " #segment/BUILDING"), up)
    key = F.col("s_suppkey")
    more = [when(key % 7 == 0, "\nOnce of [[Missing ", key.cast("string"), "]]"), when(key % 5 == 0, "\nBy name [it](", escaped("n_name"), ".md)"), when(key % 6 == 1, "\nSee [[中文]]"), when(key % 4 == 0, "\n```\n[[Nowhere]] #hidden\n```")]
    front = when(key % 3 == 0, "---\ntags: [partner, 'Key Account']\naliases: Firm ", key.cast("string"), "\n---\n")
    s = note(supplier.join(at, F.col("s_nationkey") == F.col("n_nationkey")), 1_000_000, "s_suppkey", "s_name", "supplier", "\nBased in [[", F.col("n_name"), "|home]]", *more, head=front)
    key = F.col("c_custkey")
    more = [when(key % 10 == 0, "\nIn [[", escaped("r_name"), "]] #club/c", (key % 7).cast("string")), when(key % 20 == 0, "\nThrough [[Firm ", (3 * (1 + key % 3)).cast("string"), "]]")]
    c = note(customer.join(at, F.col("c_nationkey") == F.col("n_nationkey")), 1_000_000_000, "c_custkey", "c_name", "customer", "\nSee [[", F.col("n_name"), "]] #segment/", F.col("c_mktsegment"), *more)
    return r.unionByName(n).unionByName(s).unionByName(c)


def edited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content: binary) of the linked notes later on: every third nation and a region moved, one nation to two places, one
    gone; every fiftieth customer edited at its end, every eighth supplier at its beginning."""
    notes = linked_notes(spark, sf_dir)
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    placed = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).filter(k % 3 == 0)
    to = F.when(k % 6 == 0, F.concat(F.lit("lands/New "), "n_name", F.lit(".md"))).otherwise(F.concat(F.lit("lands/"), k.cast("string"), F.lit("/"), "r_name", F.lit(".md")))
    ways = F.when(k == 12, F.array(to, F.concat(F.lit("copies/"), "n_name", F.lit(".md")))).when(k == 18, F.array().cast("array<string>")).otherwise(F.array(to))
    moved = placed.select((100 + k).cast("long").alias("note_id"), ways.alias("ways"))
    area = region.filter("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("note_id"), F.array(F.concat(F.lit("areas/New "), "r_name", F.lit(".md"))).alias("ways"))
    met = notes.join(F.broadcast(moved.unionByName(area)), "note_id", "left")  # a few nations
    now = met.withColumn("path", F.explode(F.coalesce("ways", F.array("path"))))
    text = F.when((F.col("domain") == "customer") & (F.col("note_id") % 50 == 0), F.concat("text", F.lit("\nedited"))).when((F.col("domain") == "supplier") & (F.col("note_id") % 8 == 0), F.concat(F.lit("Moved\n"), "text")).otherwise(F.col("text"))
    return now.select("path", F.encode(text, "UTF-8").alias("content"))


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored edges among the documents: each whose id three divides links the one of half its id, by a wikilink, and each
    whose id nine divides that of a third, above it. source_id, target_id, kind, line."""
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct()
    out = [ids.filter(F.col("doc_id") % m == 0).select(F.col("doc_id").alias("source_id"), F.floor(F.col("doc_id") / d).alias("target_id"), F.lit(kind).alias("kind"), F.lit(line).alias("line")) for m, d, kind, line in ((3, 2, "wikilink", 2), (9, 3, "markdown_link", 1))]
    return out[0].unionByName(out[1]).filter("source_id <> target_id").join(ids.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "line")


def trail_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes of a graph document: note_id, title, path, tags (the source), domain, created_at, modified_at."""
    n = notes(spark, sf_dir)
    before = F.col("note_id") * 7 % 200 * 86_400 + F.col("note_id") * 104_729 % 86_400
    made = F.timestamp_seconds(F.unix_seconds("updated_at") - before)
    return n.select("note_id", "title", F.col("relative_path").alias("path"), F.array(F.element_at(F.split("relative_path", "/"), 1)).alias("tags"), "domain", made.alias("created_at"), F.col("updated_at").alias("modified_at"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots (path, content_hash) of the documents: by id, one in ten is new, changed, gone and renamed."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 10)
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    before = docs.filter("k <> 3").select(path.alias("path"), F.sha2("text", 256).alias("content_hash"))
    moved = F.when(F.col("k") == 7, F.concat(F.lit("moved/"), path)).otherwise(path)
    after = docs.filter("k <> 1").select(moved.alias("path"), F.sha2(F.when(F.col("k") == 5, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return before, after
