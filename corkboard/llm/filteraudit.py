"""How filters interact: a histogram of failure masks for each part, from which every order of the filters is told.

Each row has a mask of five bits, one for each filter it fails. What an order of the filters removes at each step depends on the
numbers of rows of each of the 32 masks alone, so the text is read once, and the 120 orders are enumerated from 32 cells a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.llm.common import stored

FILTERS = "ABCDE"


def masks(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of filters A to D: under 200 words; fewer distinct words than half; A-Z more than one in fifty code points;
    a symbol of #$%&*|."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for k, f in enumerate(failed):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part (the source; null is the empty one) by their mask of five bits, and of these
    the ones with a label of quality 1 and of toxic 1. Bit 16, E: the text is that of a row of a smaller doc_id. Null texts are
    empty ones. Rows without a doc_id aren't smaller than others nor have they smaller ones; rows that share the smallest doc_id of
    a text have none before them. Of labels that repeat a doc_id, a 1 holds.

    Rows move as a digest of 256 bits, which stands for the text, and a few numbers. A large group of copies is summed before it
    moves, and its smallest doc_id is found among the sums of its parts, not by a join back to its rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), masks(text).alias("mask"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))  # null ids needn't meet in one task
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = marks.filter("good OR toxic").withColumn("salt", F.lit(0).cast("long"))
    same = ["digest", "part", "mask", "good", "toxic"]
    met = rows.join(marks, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    each = met.groupBy("doc_id", "salt", *same).agg(F.count("*").alias("c"))
    groups = each.groupBy(*same).agg(F.sum("c").alias("n"), F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("at_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("without"))
    least = F.min("first").over(Window.partitionBy("digest"))  # a row for each part and label that has the text
    fresh = F.col("without") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    split = groups.withColumn("least", least).select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("late"), fresh.alias("n")), F.struct(F.lit(16).alias("late"), (F.col("n") - fresh).alias("n")))).alias("s")).filter("s.n > 0")
    n = F.col("s.n")
    return split.groupBy("part", (F.col("mask") + F.col("s.late")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all 120 orders and
    their five steps, from at most 32 cells a part. A row that fails m filters is removed by each of these in 120 / m orders."""
    plan = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            plan.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = listed.select("part", "cells", F.explode(F.expr(f"array({', '.join(plan)})")).alias("o")).select("part", "cells", "o.*")
    bit, before = F.col("bit"), F.col("before")

    def over(test, value=lambda c: c.n) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c.mask), value(c)).otherwise(F.lit(0).cast("long")))

    def here(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    return each.select(
        "part", "filter_order", "step", over(lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), over(here).alias("removed"),
        over(lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"), over(lambda m: m == bit).alias("unique_fails"),
        over(here, lambda c: c.good).alias("good_lost"), over(here, lambda c: c.toxic).alias("toxic_lost"),
        over(lambda m: m.bitwiseAND(bit) != 0, lambda c: c.n * (F.lit(120) / F.bit_count(c.mask)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """orders of the cells of docs (doc_id, text, source; others don't count) and labels (doc_id, quality, toxic). An empty table
    gives none."""
    return orders(stored(cells(docs, labels), "filter-cells"))
