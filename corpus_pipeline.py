"""The corpus pipeline: quality, exact duplicates, near duplicates, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.llm import bpe, exactdedup, jaccard, mixing, quality
from corkboard.llm.common import batches_of, documents, id_remainder, ship, small, stored

#: Bytes of an encoding task's cache, about. Workers outlive their tasks, and other stages need the memory more.
CACHE_BYTES = 64 << 20
#: Rows of a batch of texts from which near duplicates' sketches are made.
ROWS_A_BATCH = 1_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on labelled rows whose id remainder isn't 2, doesn't reject. Null and
    empty texts are scored as any other, equal rows alike; rows that repeat a doc_id each by their own text. Columns named
    as the classifier's stay the input's. An empty table gives none; without labels of both classes all rows have one score."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.labelled(docs.filter(id_remainder("doc_id", 4) != 2), labels))
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), "text")
    return quality.score(packed, model).filter("predicted = 1").select("others.*", "text").select(*[f"`{c}`" for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space: the longest, then of the smallest doc_id.
    Null and empty texts are one group. Rows without doc_id stay, as nothing tells them apart, and rows that repeat a doc_id
    stay or go together. What goes is few ids, so texts don't move where these are few enough to broadcast."""
    ship(spark)
    return _without(docs, exactdedup.dedup(docs).filter(~F.col("kept")).select("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates: five words, 0.8 or more alike. Null and empty
    texts and rows without doc_id stay; rows that repeat a doc_id count as one document. An empty table gives none."""
    ship(spark)
    with batches_of(spark, ROWS_A_BATCH):
        found = jaccard.join(docs, width=5, percent=80)
    return _without(docs, found.filter("component_id <> doc_id").select("doc_id"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of smaller sources again, twice at most, towards equal weights. Rows are in
    the mix's order: epoch by epoch, sources' blocks of an epoch spread evenly among each other. Files are written and numbered
    in this order, which the next stage tells by their numbers. Null sources are one; rows without words go with each epoch. An empty table gives none."""
    ship(spark)
    mixed = mixing.mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source"), entropy=0.95, repeats=2.0)
    spread = F.xxhash64("source", "mix_epoch", "mix_block")  # a block's documents stay together
    return mixed.orderBy("mix_epoch", spread, "source", "mix_order").select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their number, their digest, the digest of the text that they decode to, the row's source, and
    mix_place, by which rows are in the order of the mix. Spark reads files by size, not by name, so a row's place is told by its
    file's number and its own number in that file, as the stage before wrote them; rows of no file are in the order they come in.
    Null and empty texts have no ids. An empty table gives none."""
    ship(spark)
    placed = docs.withColumn("mix_place", _place(docs))
    return bpe.round_trip(placed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True, ("source", "mix_place"), CACHE_BYTES)


def _place(docs: DataFrame) -> Column:
    """File number, number of the file's piece, and row number in one whole number."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    part, piece = (F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0)) for pattern in (r"part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(part, 42) + F.shiftleft(piece, 34) + F.col("_metadata.row_index")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(small(stored(gone.distinct(), "pipeline-gone")), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: The stages fit a model, join by sketches and tokenise: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all of documents: what the last one gives. Null ids, texts and sources, empty texts and
    repeated rows are as each stage says. An empty table gives none."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
