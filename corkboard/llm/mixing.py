"""Mixing sources to target weights: temperature, bisected to a target, and budgeted block permutations.

Weights are the sources' token shares to a power, normalised. A budget of tokens then takes whole epochs of a source, each
document once, and of a last epoch as many blocks as fit. Blocks are hash buckets of a source's documents, a power of two of
them; each epoch of a source has a permutation of its blocks of its own, told by arithmetic on a block's number, and a block's
documents stay together in it. The last epoch is a prefix of its permutation; the block in which the budget ends is cut by
the order of its documents. All of it is told by a few numbers for each source, so choosing documents moves no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkboard.llm.common import small, stored

#: Tokens in a block, about; and the blocks of a source at most (as a power of two), beyond which blocks grow.
BLOCK_TOKENS = 1 << 18
MOST_BLOCK_BITS = 16
#: Bits of mix_order that tell a document's place in its block, below those that tell the block's.
PLACE_BITS = 40
#: Halvings of the interval of exponents.
HALVINGS = 50


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weights(totals: DataFrame, passes: float | None, entropy: float | None, repeats: float | None) -> DataFrame:
    """One row: the exponent, by bisection over an array of all sources' tokens. With an entropy (share of the greatest
    possible, log of the number of sources), the largest exponent in 0..1 whose weights reach it; with repeats, the
    smallest not below that at which no source is passed more often."""
    t, total, least, largest = (F.col(c) for c in ("t", "total", "least", "largest"))
    row = totals.filter("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    row = row.select("t", F.aggregate("t", F.lit(0.0), lambda s, x: s + x).alias("total"), F.get("t", F.lit(0)).alias("least"), F.get("t", F.size("t") - 1).alias("largest"))

    def norm(a: Column) -> Column:
        return F.aggregate(t, F.lit(0.0), lambda s, x: s + F.pow(x / total, a))

    def diverse(a: Column) -> Column:
        """Of weights share^a / norm, the entropy is log(norm) - a * sum(share^a * log(share)) / norm."""
        logs = F.aggregate(t, F.lit(0.0), lambda s, x: s + F.pow(x / total, a) * F.log(x / total))
        return F.log(norm(a)) - a * logs / norm(a) >= F.lit(entropy) * F.log(F.size(t).cast("double"))

    def seldom(a: Column) -> Column:
        """The smallest source is the one passed most often."""
        most = F.pow(largest / least, 1 - a) if passes is None else F.pow(least / total, a) / norm(a) * F.lit(passes) * total / least
        return most <= F.lit(repeats)

    def bisect(ok, low: Column, holds_below: bool) -> Column:
        """The end of the interval of exponents from low to 1 in which ok holds."""

        def halve(s: Column, _: Column) -> Column:
            middle = (s.lo + s.hi) / 2
            upper, lower = (F.struct(x.alias("lo"), y.alias("hi")) for x, y in ((middle, s.hi), (s.lo, middle)))
            return F.when(ok(middle), upper if holds_below else lower).otherwise(lower if holds_below else upper)

        last = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.alias("lo"), F.lit(1.0).alias("hi")), halve)
        return last.lo if holds_below else last.hi

    low = F.lit(1.0) if entropy is None and repeats is None else F.lit(0.0)
    if entropy is not None:
        low = bisect(diverse, F.lit(0.0), True)
    row = row.withColumn("exponent", low)
    if repeats is not None:  # at exponent 1 all sources are passed equally often; nothing lowers that further
        row = row.withColumn("exponent", F.when(seldom(F.col("exponent")), F.col("exponent")).otherwise(bisect(seldom, F.col("exponent"), False)))
    return row.select("exponent", "total", "largest", norm(F.col("exponent")).alias("norm"))


def plan(slim: DataFrame, passes: float | None, entropy: float | None, repeats: float | None, seed: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For each source of slim (source, tokens, h): tokens, weight, wanted tokens, whole epochs, and where its last epoch
    ends (order of a block, order of a document in it); as many rows as sources."""
    totals = stored(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    solved = _weights(totals, passes, entropy, repeats).first()
    exponent, total, largest, norm = solved["exponent"] or 0.0, solved["total"] or 1.0, solved["largest"] or 1.0, solved["norm"] or 1.0
    spend = passes * total if passes is not None else norm * total * (largest / total) ** (1 - exponent)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(exponent)) / norm).otherwise(0.0)
    wanted = totals.withColumn("exponent", F.lit(exponent)).withColumn("weight", share).withColumn("want", F.col("weight") * spend)
    often = F.col("want") / F.greatest("tokens", F.lit(1))
    wanted = wanted.withColumn("epochs", F.when(F.col("tokens") == 0, F.lit(0)).otherwise(F.floor(often + 1e-9)).cast("long"))
    wanted = wanted.withColumn("rest", F.greatest(F.lit(0.0), F.col("want") - F.col("epochs") * F.col("tokens")))
    bits = F.ceil(F.log2(F.greatest(F.col("tokens") / block_tokens, F.lit(1.0))))
    wanted = wanted.withColumn("bits", F.least(F.lit(MOST_BLOCK_BITS), bits).cast("int"))
    sources = stored(wanted.select("source", "tokens", "rows", "exponent", "weight", "want", "epochs", "rest", "bits"), "mix-plan")
    near = small(sources).select(F.col("source").alias("_source"), "rest", "bits", "epochs")
    block = permuted(seed, F.col("source"), F.col("epochs"), block_of(F.col("h"), F.col("bits")), F.col("bits"))  # its place in the last epoch
    placed = slim.join(near, F.col("source").eqNullSafe(F.col("_source"))).select("source", "tokens", "h", "rest", block.alias("block"))
    blocks = placed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy("block")  # 2**MOST_BLOCK_BITS rows at most
    ends = blocks.withColumn("through", F.sum("tokens").over(order)).filter((F.col("through") > F.col("rest")) & (F.col("through") - F.col("tokens") <= F.col("rest")))
    ends = stored(ends.select(F.col("source").alias("s"), F.col("block").alias("end_block"), (F.col("rest") - F.col("through") + F.col("tokens")).alias("left")), "mix-ends")
    last = placed.join(small(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("end_block")))
    rows = last.groupBy("s", "end_block", "left", "h").agg(F.sum("tokens").alias("tokens"))
    inner = Window.partitionBy("s").orderBy("h")  # the documents of one block
    cut = rows.withColumn("through", F.sum("tokens").over(inner)).filter(F.col("through") <= F.col("left")).groupBy("s").agg(F.max("h").alias("end_h"))
    same = F.col("source").eqNullSafe(F.col("s"))
    found = sources.join(ends.select("s", "end_block"), same, "left").drop("s").join(cut, same, "left").drop("s")
    return stored(found, "mix-cuts")


def _order(seed: int) -> Column:
    """A document's place in its block: a hash of what it is, so that equal rows stay together."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def block_of(h: Column, bits: Column) -> Column:
    """The number of a document's block, of 2**bits, from its hash's high bits."""
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(h, 1), F.lit(63) - bits)


def permuted(seed: int, source: Column, epoch: Column, block: Column, bits: Column) -> Column:
    """The block's place in the permutation of its source's 2**bits blocks for an epoch. Each step is one to one on numbers
    of so many bits: times an odd number, plus another; and XOR with the number's own high bits."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.floor((bits + 1) / 2).cast("int") + (bits == 0).cast("int")
    x = block
    for k in range(3):
        draw = F.xxhash64(F.lit(seed), F.lit(k), source, epoch)
        x = (x * draw.bitwiseAND(low).bitwiseOR(F.lit(1)) + F.shiftrightunsigned(draw, 20).bitwiseAND(low)).bitwiseAND(low)
        x = x.bitwiseXOR(F.call_function("shiftright", x, half))
    return x


def mix(docs: DataFrame, passes: float | None = None, entropy: float | None = None, repeats: float | None = None, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, each row as often as the mix takes it, with the columns mix_epoch (0, 1, 2 ...), mix_block (its block's place in
    that epoch's permutation of its source's blocks), mix_order (by which an epoch of a source is in order: by block, then
    by place in the block), mix_tokens and mix_weight added; columns of these names are replaced.

    passes: the budget of tokens, as a multiple of all documents' tokens; None for the least budget at which every document
    of the largest source, and so of every one, is taken at least once. A budget that no weights can spend within `repeats`
    passes of a source is a ValueError; where the entropy and the limit of repeats can't both be met, the limit is. Null
    sources are a source of their own. Blocks have about block_tokens, or more where a source would have more than
    2**MOST_BLOCK_BITS of them; their order is another one in each epoch, that of the documents in a block is the same. Rows without tokens go with each whole epoch, and a source without any is taken once.
    Equal rows are taken or left together. An empty table gives none."""
    if repeats is not None and repeats < (1 if passes is None else passes):
        raise ValueError("the budget takes some source more often than the limit of repeats allows, whatever the weights")
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_order", "mix_tokens", "mix_weight")]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("kept"), "source", words(F.col("text")).alias("tokens"), _order(seed).alias("h"))
    slim = stored(marked.select("source", "tokens", "h"), "mix-rows")
    cuts = small(plan(slim, passes, entropy, repeats, seed, block_tokens))
    cuts = cuts.select(F.col("source").alias("_source"), "weight", "epochs", "bits", F.col("tokens").alias("total"), "end_block", "end_h", "rest")
    found = marked.join(cuts, F.col("source").eqNullSafe(F.col("_source")))

    def place(epoch: Column) -> Column:
        return permuted(seed, F.col("source"), epoch, block_of(F.col("h"), F.col("bits")), F.col("bits"))

    last = place(F.col("epochs"))
    within = (last < F.col("end_block")) | ((last == F.col("end_block")) & (F.col("h") <= F.coalesce("end_h", F.lit(-(2**63)).cast("long"))))
    more = (F.col("rest") > 0.5) & (F.col("tokens") > 0) & (F.col("end_block").isNull() | within)
    whole = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.col("epochs"))
    times = (whole + F.coalesce(more, F.lit(False)).cast("long")).cast("int")
    found = found.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    found = found.withColumn("mix_block", place(F.col("mix_epoch").cast("long")))
    # by h within a block, lowest first, as the last epoch is cut: what it takes is a prefix of this order
    order = F.shiftleft(F.col("mix_block"), PLACE_BITS) + F.shiftrightunsigned(F.col("h"), 64 - PLACE_BITS).bitwiseXOR(F.lit(1 << (PLACE_BITS - 1)))
    return found.select("kept.*", "mix_epoch", "mix_block", order.alias("mix_order"), F.col("tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"))
