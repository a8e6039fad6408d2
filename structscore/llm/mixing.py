"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

Sizes are words.  A source's documents are shuffled by a hash, put in one line
and cut into blocks of equally many words (the last of a pass may be shorter).
The schedule has a slot for every block that a source gives: the k-th point of
the van der Corput sequence falls somewhere into the cumulative shares of the
sources, and the source that it falls into takes slot k, so that every stretch
of the schedule holds the sources nearly in their shares.  A source's slots,
ranked, are joined with its blocks, pass after pass.

The sequence serves a source a few slots too many or too few (as the logarithm
of the number of slots).  Slots beyond a source's need fall away, missing ones
stand at the end, and its last slot is cut, so that it gives its target in whole
words, rounded down.

All of it is DataFrame operations: ranks and running totals come from range
sorts with a total per partition, so a source that holds most rows is spread
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)

#: No source gives more than this many times its words.
MOST_PASSES = 3

#: Words of a block.
BLOCK_WORDS = 2048

#: Bits of a point of the sequence.
BITS = 62

WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], amount: Column, name: str, into: str) -> DataFrame:
    """`df` as a stored table with the sum of `amount` over all rows before each row in a total order.

    A range sort; each partition's total is added up once, and rows are summed
    within their partition.
    """
    part = "_part"
    line = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = line.groupBy(part).agg(F.sum(amount).alias("_total"))
    before = totals.select(part, F.coalesce(F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        line.withColumn(into, F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(before, part)  # a row per partition
        .withColumn(into, (F.col(into) + F.col("_before")).cast("long"))
        .drop(part, "_before")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target, position) of every source in `sizes` (source, size), position from 0.

    Sources by code point, null last, have the weights in turn and share all
    words by them.  A target stops at `most` times its source's words, and what
    is over goes to the others by weight until none is above: in order of
    most * words / weight, those stop at which the level of the rest is reached.
    """
    found = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = [F.col("source").isNull(), F.col("source")]
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = running(found, named, F.lit(1), "sources", "position").withColumn("weight", F.element_at(turn, (F.col("position") % len(weights) + 1).cast("int")))
    level = [F.col("source_size") / F.col("weight"), F.col("position")]
    ranked = running(ranked, level, F.col("weight"), "levels", "weight_before")
    ranked = running(ranked, level, F.col("source_size"), "levels", "size_before")
    all_weight, all_size = ranked.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    rest = ranked.select(
        "source", "source_size", "position", "weight",
        (F.lit(all_size) - most * F.col("size_before")).alias("left"), (F.lit(all_weight) - F.col("weight_before")).alias("left_weight"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    stops = wide("left") * wide("weight") >= most * wide("source_size") * wide("left_weight")
    rest = stored(rest.withColumn("stops", stops), "targets")
    first = rest.where(~F.col("stops")).agg(F.min(F.struct(F.col("source_size") / F.col("weight"), "position", "left", "left_weight"))).first()[0]
    share = F.col("weight") * F.lit(first.left / first.left_weight if first else 0.0)
    return rest.select("source", "source_size", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"), "position")


def van_der_corput(k: Column) -> Column:
    """The k-th point of the sequence in base 2, times 2^BITS: the low BITS bits of k, turned round."""
    x = k
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        low = x.bitwiseAND(F.lit(mask))
        high = F.shiftrightunsigned(x, step).bitwiseAND(F.lit(mask))
        x = F.shiftleft(low, step).bitwiseOR(high)
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - BITS)


def slot_needs(targets: DataFrame, block: int) -> DataFrame:
    """Targets with whole words to give, blocks of a pass, and slots needed."""
    size, words = F.col("source_size"), F.floor("target").cast("long")
    per_pass = F.ceil(size / block).cast("long")
    passes = F.expr("words div greatest(source_size, 1)")
    needs = targets.withColumn("words", words).withColumn("blocks", per_pass).withColumn("passes", passes)
    rest = F.col("words") - F.col("passes") * size
    return needs.withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil(rest / block)).cast("long")).where("slots > 0")


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source's position, rank, pass, block, words to take) for every slot of the mix.

    Slots count up without being gapless; `rank` numbers a source's slots from 0.
    """
    needs = stored(running(slot_needs(targets, block), [F.col("position")], F.col("slots"), "needs", "slots_before"), "needs")
    total = needs.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    spark = targets.sparkSession
    # boundaries of the shares among the points, exact in 38 digits
    starts = needs.select(
        F.expr(f"cast(slots_before as decimal(19,0)) * {1 << BITS}BD div {max(total, 1)}").alias("point"), F.lit(-1).cast("long").alias("slot"), "position"
    )
    points = spark.range(total).select(van_der_corput(F.col("id")).alias("point"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("position"))
    # each point takes the last source that starts at or before it: positions only grow along the line
    line = stored(points.unionByName(starts).repartitionByRange("point", "slot").withColumn("_part", F.spark_partition_id()), "points")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("_part").agg(F.max("position").alias("_last")).select("_part", F.max("_last").over(ahead).alias("_carried"))
    within = Window.partitionBy("_part").orderBy("point", "slot").rowsBetween(Window.unboundedPreceding, 0)
    owned = line.withColumn("owner", F.max("position").over(within)).join(carried, "_part")
    owned = owned.where("slot >= 0").select("slot", F.coalesce("owner", "_carried").alias("position"))
    # rank a source's slots: number all in order of source and slot, less those of the sources before
    numbered = running(owned, [F.col("position"), F.col("slot")], F.lit(1), "slots", "number")
    served = stored(numbered, "numbered")
    first = served.groupBy("position").agg(F.min("number").alias("first_number"), F.count("*").alias("n_served"))
    needs = stored(needs.join(first, "position", "left").fillna(0, ["first_number", "n_served"]), "needs")
    ranked = served.join(needs, "position").withColumn("rank", F.col("number") - F.col("first_number")).where("rank < slots")
    missing = needs.where("n_served < slots").withColumn("rank", F.explode(F.sequence("n_served", F.col("slots") - 1)))
    missing = missing.withColumn("slot", F.lit(total) + F.col("rank"))
    names = ["slot", "position", "rank", "source_size", "words", "blocks"]
    at = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    given = F.col("pass") * F.col("source_size") + F.col("block") * block
    return (
        ranked.select(names).unionByName(missing.select(names)).withColumns({"pass": at[0], "block": at[1]})
        .withColumn("take", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("words") - given).cast("long"))
        .select("slot", "position", "rank", "pass", "block", "take")
    )


def _placed(documents: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's numbers and where they start in its line; targets."""
    sizes = stored(documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights, most), "targets")
    shuffled = F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("source").isNull(), F.col("source"), F.col("shuffled"), F.col("doc_id"), F.col("size")]
    lined = running(sizes.withColumn("shuffled", shuffled), order, F.col("size"), "line", "at")
    before = stored(running(targets, [F.col("position")], F.col("source_size"), "starts", "source_at").withColumnRenamed("source", "named"), "starts")
    line = stored(lined.join(before, F.col("source").eqNullSafe(F.col("named"))).drop("named"), "lined")
    return line.withColumn("start", F.col("at") - F.col("source_at")), targets


def _joined(line: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """A row for each piece of a document in a block and each slot that takes words of it, or none."""
    last = F.expr(f"(start + size - 1) div {block}")
    pieces = line.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), last)))
    from_ = F.greatest(F.col("start"), F.col("block") * block)
    to = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumns({"piece": from_ - F.col("start"), "in_block": from_ - F.col("block") * block, "length": to - from_})
    joined = pieces.join(slots, ["position", "block"], "left")
    return joined.withColumn("length", F.greatest(F.least(F.col("length"), F.coalesce("take", F.lit(0)) - F.col("in_block")), F.lit(0)))


def mixed_pieces(documents: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """The mix itself: (slot, in_block, doc_id, source, first_word, length), in order of slot and in_block.

    Words of a document are counted from 0.  Nulls, ties and empty tables as in `mix_report`.
    """
    line, targets = _placed(documents, weights, most)
    joined = _joined(line, schedule(targets, block), block)
    return joined.where("length > 0").select("slot", "in_block", "doc_id", "source", F.col("piece").alias("first_word"), "length")


def mix_report(documents: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and `source`.

    A null text has no words; a null source is a source, the last one; rows with
    a null or repeated doc_id are documents each, equal ones are told apart by
    their place in the line.  A document without words takes none.  An empty
    table has no rows.  The order is by md5 of doc_id, so reruns agree.
    """
    line, targets = _placed(documents, weights, most)
    slots = schedule(targets, block)
    names = ["doc_id", "size", "source_size", "target", "source"]
    taken = _joined(line, slots, block).groupBy("at", *names).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("taken")).drop("at")
    return taken.unionByName(line.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))).select("doc_id", "size", "source_size", "target", "taken", "source")
