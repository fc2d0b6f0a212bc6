"""The stored index: notes, sections, postings and links in bucketed tables, versions told by manifests.

Postings are stored twice, bucketed and sorted by term, and a section's in one row, bucketed by note, so that a search reads the
buckets of its terms, frequencies need no shuffle, and discovery none to meet a note's. A version is a manifest that lists generations: the first has all notes, each later
one those that were new or had changed, by a digest of their columns, and the ids that it takes the place of. A reader leaves out
of a generation what later ones replace. What follows from all notes at once (which note a link means) is resolved anew for
each version from the links that are stored, without reading texts. A version is there when its manifest is; what a build that
failed has left is in no manifest.
"""

from __future__ import annotations

import functools
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.functions.storage import BROADCAST_BYTES, discard, stored
from corkboard.functions.text import name_key, path_key
from corkboard.operators import discovery, graph, search

KIND, SCHEMA = "corkboard-index", 2
#: Rows of a bucket's file, about, and the least and the most buckets. A bucket of more rows, as of a term that every section
#: has, is several files.
FILE_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 8, 4096
#: Bytes of a note's id in a set that is broadcast, about.
ID_BYTES = 32
#: Generations beyond which a refresh writes all notes anew.
MOST_GENERATIONS = 8

#: Tables of a generation: (column of the buckets, order within them, column by which a hot bucket is split).
TABLES = {
    "notes": ("note_id", ["note_id"], "note_id"), "sections": ("section_id", ["section_id"], "section_id"), "links": ("note_id", ["note_id", "line", "place"], "line"),
    "by_term": ("term", ["term", "section_id"], "section_id"), "by_note": ("note_id", ["note_id"], "section_id"), "names": ("note_id", ["note_id"], "note_id"),
}


class Index:
    """One version of an index. Answers a search as search.Tables does."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    @property
    def version(self) -> int:
        return self.manifest["version"]

    # ---- reading ----

    def _table(self, generation: dict, name: str) -> DataFrame:
        table = f"corkboard_{generation['id']}_{name}"
        if not self.spark.catalog.tableExists(table):
            by, order, _ = TABLES[name]
            self.spark.sql(f"CREATE TABLE {table} ({generation['tables'][name]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {self.manifest['buckets']} BUCKETS LOCATION '{self.root}/generations/{generation['id']}/{name}'")
        return self.spark.table(table)

    def live(self, name: str) -> DataFrame:
        """A table's rows of notes that no later generation replaces."""
        generations, out, dead, n = self.manifest["generations"], [], [], 0
        for g in reversed(generations):
            rows = self._table(g, name)
            if dead:
                gone = reduce(DataFrame.unionAll, dead).distinct()
                rows = rows.join(F.broadcast(gone) if n * ID_BYTES <= BROADCAST_BYTES else gone, "note_id", "left_anti")
            out.append(rows)
            if g["dead"]:
                dead.append(self.spark.read.schema("note_id long").parquet(f"{self.root}/generations/{g['id']}/dead"))
                n += g["dead"]
        return reduce(lambda a, b: a.unionByName(b), out[::-1])

    def n_notes(self) -> int:
        return self.manifest["statistics"]["notes"]

    def postings(self, of: list[str] | None = None) -> DataFrame:
        """(section_id, note_id, term, term_count), of some terms from their buckets alone."""
        rows = self.live("by_term") if of is None else self.live("by_term").filter(F.col("term").isin(of))
        return rows.select("section_id", "note_id", "term", "term_count")

    def terms(self) -> DataFrame:
        """The postings by note."""
        return self.packed().select("section_id", "note_id", F.inline("terms"))

    def packed(self) -> DataFrame:
        """(section_id, note_id, terms), the postings of a section in one row."""
        return self.live("by_note").select("section_id", "note_id", "terms")

    def sections(self, ids: list[int] | None = None) -> DataFrame:
        return self.live("sections") if ids is None else self.live("sections").filter(F.col("section_id").isin(ids))

    def notes(self, ids: list[int] | None = None) -> DataFrame:
        rows = self.live("notes").drop("row_digest")
        return rows if ids is None else rows.filter(F.col("note_id").isin(ids))

    def _resolved(self, name: str) -> DataFrame:
        known = self.manifest["resolved"].get(name)
        if known is None:
            raise ValueError(f"this version of the index has no {name}")
        return self.spark.read.schema(known["schema"]).parquet(f"{self.root}/resolved/{known['id']}")

    def edges(self) -> DataFrame:
        return self._resolved("edges")

    def unresolved(self) -> DataFrame:
        return self._resolved("unresolved")

    def tags(self) -> DataFrame:
        return self._resolved("tags")

    def names(self) -> DataFrame:
        return self._resolved("names")

    def candidates(self) -> DataFrame:
        return self._resolved("candidates")

    def statistics(self) -> DataFrame:
        """One row: version, indexed_at, notes, sections, verified_edges, candidate_edges, note_tags, unresolved_links, as counted
        when the version was written."""
        s = self.manifest["statistics"]
        names = ["notes", "sections", "verified_edges", "candidate_edges", "note_tags", "unresolved_links"]
        return self.spark.createDataFrame([(self.version, self.manifest["indexed_at"], *[s[n] for n in names])], f"version int, indexed_at string, {', '.join(f'{n} long' for n in names)}")

    # ---- writing ----

    def refresh(self, notes: DataFrame, sections: DataFrame) -> Index:
        """The version after notes and sections (of build) have taken the place of what the index has: only notes that are new or
        have changed are parsed and written. The same version if none has."""
        told = stored(_with_digest(notes), "index-now")
        before = self.live("notes").select("note_id", F.col("row_digest").alias("was"))
        met = stored(told.select("note_id", "row_digest").join(before, "note_id", "full_outer").filter(~F.col("row_digest").eqNullSafe(F.col("was"))), "index-changes")
        dead = met.filter("was IS NOT NULL").select("note_id")
        if met.isEmpty():
            return self
        if len(self.manifest["generations"]) >= MOST_GENERATIONS:
            return _commit(self.spark, self.root, self.manifest, [_generation(self.spark, self.root, notes, sections, self.manifest["buckets"], None)])
        changed = met.filter("row_digest IS NOT NULL").select("note_id")
        new = [df.join(changed, "note_id", "left_semi") for df in (notes, sections)]
        return _commit(self.spark, self.root, self.manifest, [*self.manifest["generations"], _generation(self.spark, self.root, *new, self.manifest["buckets"], dead)])

    def discover(self, threshold: float = 0.16, per_note: int = 8) -> Index:
        """The version that has candidate edges besides."""
        vectors = discovery.vectors(self.terms(), self.n_notes(), self.postings())
        return _commit(self.spark, self.root, self.manifest, self.manifest["generations"], discovery.candidates(vectors, threshold, per_note))


def build(spark: SparkSession, root: str, notes: DataFrame, sections: DataFrame, buckets: int | None = None) -> Index:
    """A new index in the folder root, which executors share: of notes (note_id, path, title, text and others) and their sections
    (section_id, note_id, heading, text and others). Ids must be distinct and none null. Null texts are empty. A folder that has
    an index already is refused."""
    if _versions(spark, root):
        raise ValueError(f"there is an index in {root} already: refresh it")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-sections.count() * 100 // FILE_ROWS)))  # of about a hundred terms a section
    manifest = {"kind": KIND, "schema": SCHEMA, "version": 0, "buckets": buckets}
    return _commit(spark, root, manifest, [_generation(spark, root, notes, sections, buckets, None)])


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Index:
    """The last version of the index in root, or one of it. ValueError if there is none, or it is of another kind or schema."""
    known = _versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no index in {root}" if not known else f"the index in {root} has no version {version}")
    return Index(spark, root, known[max(known) if version is None else version])


def _versions(spark: SparkSession, root: str) -> dict[int, dict]:
    """The manifests that were written whole, by version."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    out = {}
    for row in spark.read.option("wholetext", True).text(f"{root}/manifests").collect():  # a few lines a version
        try:
            m = json.loads(row[0])
        except ValueError:
            continue
        if m.get("kind") != KIND or m.get("schema") != SCHEMA:
            raise ValueError(f"{root} has an index of kind {m.get('kind')!r}, schema {m.get('schema')!r}, not {KIND!r}, {SCHEMA}")
        out[m["version"]] = m
    return out


def _with_digest(notes: DataFrame) -> DataFrame:
    """notes without their texts, with a digest of the text and one of all columns."""
    told = F.sha2(F.to_json(F.struct(*sorted(notes.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = notes.withColumn("row_digest", told)
    return (hashed if "content_hash" in notes.columns else hashed.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))).drop("text")


def _generation(spark: SparkSession, root: str, notes: DataFrame, sections: DataFrame, buckets: int, dead: DataFrame | None) -> dict:
    """Writes the tables of some notes, and the ids that they take the place of."""
    found = {"id": uuid.uuid4().hex, "tables": {}, "dead": 0}
    names = graph.bodies(notes).select("note_id", F.concat(F.array(name_key(F.col("title")), name_key(F.col("path"))), F.transform("b.aliases", name_key)).alias("keys"))
    tables = {"terms": search.packed(sections), "links": graph.links(notes), "notes": _with_digest(notes), "names": names}
    tables = dict(zip(tables, _together([functools.partial(stored, df, f"index-{name}") for name, df in tables.items()])))
    tables["by_note"] = tables.pop("terms")
    tables |= {"by_term": tables["by_note"].select("section_id", "note_id", F.inline("terms")), "sections": sections}

    def write(name: str) -> None:
        df, (by, order, spread) = tables[name], TABLES[name]
        table = f"corkboard_{found['id']}_{name}"
        _laid_out(df, by, spread, buckets).write.format("parquet").bucketBy(buckets, by).sortBy(*order).option("path", f"{root}/generations/{found['id']}/{name}").saveAsTable(table)

    few = ["links", "notes", "names"]
    _together([functools.partial(write, name) for name in few])
    found["tables"] = {name: _ddl(tables[name]) for name in TABLES}
    discard(spark, *[tables[name] for name in few])
    for name in ("by_term", "by_note", "sections"):  # one after the other: what each moves is as large as what it writes
        write(name)
        discard(spark, *([tables[name]] if name == "by_note" else []))
    if dead is not None:
        found["dead"] = dead.count()
        dead.write.parquet(f"{root}/generations/{found['id']}/dead")
    return found


def _together(jobs: list) -> list:
    """The results of jobs that need nothing of one another, which Spark runs side by side: none of them fills a cluster for long."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _laid_out(df: DataFrame, by: str, spread: str, buckets: int) -> DataFrame:
    """df with each bucket's rows in a partition of their own, in several where they are many."""
    bucket = F.pmod(F.hash(by), F.lit(buckets))  # as Spark numbers a table's buckets
    few = df.count() <= FILE_ROWS
    sizes = {} if few else dict(df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())  # a number a bucket
    parts = [max(1, -(-sizes.get(b, 0) // FILE_ROWS)) for b in range(buckets)]
    first = [sum(parts[:b]) for b in range(buckets)]
    numbers = F.from_json(F.lit(json.dumps([{"f": f, "p": p} for f, p in zip(first, parts)])), "array<struct<f: int, p: int>>")
    place = F.get(numbers, bucket)
    return df.repartitionById(sum(parts), (place["f"] + F.pmod(F.xxhash64(spread), place["p"])).cast("int"))


def _commit(spark: SparkSession, root: str, before: dict, generations: list[dict], candidates: DataFrame | None = None) -> Index:
    """Resolves links over the generations, counts, and writes the manifest of the next version. Of two writers at once the second
    one fails."""
    index = Index(spark, root, {**before, "generations": generations})
    if candidates is None:
        resolved = {}
        names = index.live("names").select("note_id", F.explode(F.array_distinct("keys")).alias("key")).filter("key <> ''")
        notes = index.live("notes")
        keys = stored(names.groupBy("key").agg(F.count_distinct("note_id").alias("n"), F.min("note_id").alias("id")), "index-keys")
        paths = notes.groupBy(path_key(F.col("path")).alias("key")).agg(F.max("note_id").alias("id"))
        links = index.live("links")
        told = stored(graph.resolve(links.filter("kind <> 'tag'"), keys, paths), "index-resolved")
        tables = {"names": keys, "edges": graph.edges_of(told), "unresolved": told.filter("reason IS NOT NULL").select("note_id", "path", "line", "kind", "target", "reason"), "tags": graph.tags_of(links)}
    else:
        resolved, tables = dict(before["resolved"]), {"candidates": candidates}
    index.manifest["resolved"] = resolved
    for name, df in tables.items():
        resolved[name] = {"id": f"{name}-{uuid.uuid4().hex}", "schema": _ddl(df)}
    _together([functools.partial(df.write.parquet, f"{root}/resolved/{resolved[name]['id']}") for name, df in tables.items()])
    counted = {"notes": index.live("notes").count, "sections": index.sections().count, "verified_edges": index.edges().count, "note_tags": index.tags().count, "unresolved_links": index.unresolved().count}
    held = before["statistics"] if candidates is not None else dict(zip(counted, _together(list(counted.values()))))
    index.manifest["statistics"] = {**held, "candidate_edges": 0 if candidates is None else index.candidates().count()}
    index.manifest["indexed_at"] = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
    index.manifest["version"] = before["version"] + 1
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/v{index.version:08d}.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(json.dumps(index.manifest).encode()))
    out.close()
    return index
