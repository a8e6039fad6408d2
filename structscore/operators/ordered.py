"""Work along a total order, whatever the size of a key.

A window per key puts all rows of the key into one task.  Here rows are range
partitioned by the whole order instead and stored with the number of their
partition; a window works inside a partition, and what one partition hands on to
the next ones (its last value, its sum) is a row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscore.shared import stored

PART = "_part"


def lined(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` in ranges of `order` (ascending, nulls first), stored, with PART."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "line")


def _window(order: list[str], ahead: bool) -> Window:
    turned = [F.desc(c) if ahead else F.asc(c) for c in order]
    return Window.partitionBy(PART).orderBy(*turned)


def with_seen(line: DataFrame, order: list[str], value: Column, into: str, ahead: bool = False, itself: bool = False) -> DataFrame:
    """The last `value` that isn't null in the rows before each row (`ahead`: the next one after it; `itself`: the row counts)."""
    at, found = F.struct(*order), F.col("_found")
    per_part = line.withColumn("_found", value).groupBy(PART)
    pick = F.min_by if ahead else F.max_by
    ends = per_part.agg(pick(found, F.when(found.isNotNull(), at)).alias("_end"))
    parts = Window.orderBy(F.desc(PART) if ahead else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(PART, F.last("_end", True).over(parts).alias("_carried"))  # a row per partition
    within = _window(order, ahead).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return line.withColumn(into, F.last(value, True).over(within)).join(F.broadcast(carried), PART).withColumn(into, F.coalesce(into, "_carried")).drop("_carried")


def with_total(line: DataFrame, order: list[str], amount: Column, into: str) -> DataFrame:
    """The sum of `amount` over all rows before each row; null amounts are zero."""
    ends = line.groupBy(PART).agg(F.sum(amount).alias("_end"))
    before = ends.select(PART, F.sum("_end").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = _window(order, False).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(into, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return line.withColumn(into, F.sum(amount).over(within)).join(F.broadcast(before), PART).withColumn(into, total).drop("_carried")


def _same(keys: list[str], of: str) -> Column:
    """Whether the row's keys are those in the struct `of`."""
    out = F.col(of).isNotNull()
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"{of}.{c}"))
    return out


def with_previous(line: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Columns `values` of the row before in the same key, null for a key's first row; `line` is by keys and order.

    Rows that are equal in keys and order have no order among them.
    """
    value = F.struct(*keys, *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    seen = with_seen(line, [*keys, *order], value, "_seen")
    return seen.withColumns({name: F.when(_same(keys, "_seen"), F.col(f"_seen._v{i}")) for i, name in enumerate(values)}).drop("_seen")


DIRECTIONS = ("nearest", "backward", "forward")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], position: str, tie: str, within: float | None = None, direction: str = "nearest") -> DataFrame:
    """Each row of `left`, and the row of `right` with its keys that is nearest in position.

    Adds `match` (the columns of `right` as a struct) and `distance`, both null
    where nothing matches.  `backward` takes the last at or before the position,
    `forward` the first at or after it.  Equally near ones: the lower position,
    then the lower `tie` column of `right`.  Matches further than `within` are
    none.  Rows without a position or with a null key match nothing.  Rows of
    `left` that repeat are each matched.  Positions are numbers.

    Both tables are laid in one line by keys and position; one pass forwards and
    one backwards find the neighbours.  No product of a key's rows is formed.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    at = [*keys, position]
    placed = right.dropna(subset=at)
    one = placed.groupBy(*at).agg(F.min_by(F.struct(*[F.col(c) for c in right.columns]), F.col(tie)).alias("match"))
    none = F.lit(None)
    rows = left.select(*at, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), none.cast(one.schema["match"].dataType).alias("match"))
    found = one.select(*at, F.lit(0).alias("_side"), none.cast(rows.schema["_row"].dataType).alias("_row"), "match")
    order = [*at, "_side"]
    line = lined(rows.unionByName(found), order)
    here = F.when(F.col("match").isNotNull(), F.struct(*at, "match"))
    line = with_seen(line, order, here, "_before")
    line = with_seen(line, order, here, "_after", ahead=True)
    gap = {s: F.when(_same(keys, s), F.abs(F.col(position) - F.col(f"{s}.{position}"))) for s in ("_before", "_after")}
    line = line.where("_side = 1").withColumns({"_gap" + s: g for s, g in gap.items()})
    before, after = F.col("_gap_before"), F.col("_gap_after")
    back = {"nearest": before.isNotNull() & (after.isNull() | (before <= after)), "backward": F.lit(True), "forward": F.coalesce(before == 0, F.lit(False))}[direction]
    line = line.withColumn("distance", F.when(back, before).otherwise(after))
    near = F.col("distance").isNotNull() if within is None else F.col("distance") <= within
    for c in keys:
        near = near & F.col(c).isNotNull()
    match = F.when(near, F.when(back, F.col("_before.match")).otherwise(F.col("_after.match")))
    return line.select("_row.*", match.alias("match"), F.when(near, F.col("distance")).alias("distance"))


def gap_clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """`rows` with the number of their cluster in their key, from 0: values in order, a gap above the tolerance starts a new one.

    Null values are a cluster of their own before the others, null keys are equal.
    """
    columns = rows.columns
    # equal values keep one order through all steps, else the row that starts a cluster may come after its equals
    order = [*keys, value, "_tie"]
    numbered = rows.withColumns({"_value": F.col(value), "_tie": F.monotonically_increasing_id()})
    line = with_previous(lined(numbered, order), keys, [value, "_tie"], {"_last": F.col("_value"), "_any": F.lit(1)})
    fresh = F.col("_any").isNull() | F.coalesce(F.col("_value") - F.col("_last") > tolerance, ~F.col("_value").eqNullSafe(F.col("_last")))
    line = with_total(stored(line.withColumn("_fresh", fresh.cast("long")), "gaps"), order, F.col("_fresh"), "_number")
    # a key's number less that of its first cluster
    line = stored(line.withColumn("_number", F.col("_number") + F.col("_fresh")), "numbers")
    first = F.when(F.col("_any").isNull(), F.col("_number"))
    line = with_seen(line, order, first, "_first", itself=True)
    return line.select(*columns, (F.col("_number") - F.col("_first")).alias(name))


def order_statistics(rows: DataFrame, keys: list[str], value: str, picks: dict[str, Column] | None = None) -> DataFrame:
    """For each key, the values at exact places of its sorted values, and their number `n`.

    `picks` gives places from 0 as expressions of `n`; by default those of a box
    drawn from sorted values: the least, n/4, n/2, 3n/4 (rounded down), the
    greatest.  Null values don't count; a key without values is left out.
    """
    n = F.col("n")
    picks = picks or {"least": F.lit(0), "lower": F.floor(n / 4), "middle": F.floor(n / 2), "upper": F.floor(3 * n / 4), "greatest": n - 1}
    order = [*keys, value]
    line = with_total(lined(rows.select(*order).where(F.col(value).isNotNull()), order), order, F.lit(1), "_number")
    line = stored(line.drop(PART), "numbered")
    sizes = line.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_number").alias("_first"))
    sizes = stored(sizes.withColumnsRenamed({c: f"_key_{c}" for c in keys}), "sizes")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    place = F.col("_number") - F.col("_first")
    ranked = line.join(sizes, on).withColumn("_place", place)
    wanted = F.lit(False)
    for p in picks.values():
        wanted = wanted | (F.col("_place") == p)
    found = ranked.where(wanted).groupBy(*keys, "n")
    return found.agg(*[F.max(F.when(F.col("_place") == p, F.col(value))).alias(name) for name, p in picks.items()])


def arithmetic_runs(rows: DataFrame, keys: list[str], order: str, value: str, tolerance: float) -> DataFrame:
    """Maximal runs of neighbours whose steps stay equal: keys, start (its order), n (values), first (value), step.

    A step may differ from the one before by `tolerance` at most; `step` is the
    run's first.  Neighbouring runs share the value between them.  Rows without a
    value are passed over; a key with one value has no run.  `order` is unique in
    a key.
    """
    at = [*keys, order]
    line = lined(rows.select(*keys, order, F.col(value).alias("_value")).where(F.col("_value").isNotNull()), at)
    line = stored(with_previous(line, keys, [order], {"_last": F.col("_value"), "_from": F.col(order)}).withColumn("_step", F.col("_value") - F.col("_last")), "steps")
    line = with_previous(line, keys, [order], {"_step_before": F.col("_step")})
    goes_on = F.coalesce(F.abs(F.col("_step") - F.col("_step_before")) <= tolerance, F.lit(False))
    line = stored(line.withColumn("_fresh", (~goes_on).cast("long")), "islands")
    line = with_total(line, at, F.col("_fresh"), "_run").withColumn("_run", F.col("_run") + F.col("_fresh"))
    runs = line.where(F.col("_step").isNotNull()).groupBy(*keys, "_run")
    first = F.struct("_from", "_last", "_step")
    found = runs.agg((F.count("*") + 1).alias("n"), F.min_by(first, F.col(order)).alias("_first"))
    return found.select(*keys, F.col("_first._from").alias("start"), "n", F.col("_first._last").alias("first"), F.col("_first._step").alias("step"))


def longest_runs(rows: DataFrame, keys: list[str], order: str, value: str, tolerance: float) -> DataFrame:
    """Each key's longest arithmetic run; of equally long ones the first."""
    runs = arithmetic_runs(rows, keys, order, value, tolerance)
    best = F.max_by(F.struct("start", "n", "first", "step"), F.struct("n", -F.col("start")))
    return runs.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def monotonic(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """For each key, whether its values in order only rise or only fall: keys and `monotonic`.

    A key with one row isn't, nor is one with a null among its values.
    """
    line = lined(rows.select(*keys, *order, F.col(value).alias("_value")), [*keys, *order])
    line = with_previous(line, keys, order, {"_last": F.col("_value"), "_any": F.lit(True)})
    steps = lambda up: F.bool_and(F.col("_any").isNull() | F.coalesce(up, F.lit(False)))
    one_way = steps(F.col("_value") > F.col("_last")) | steps(F.col("_value") < F.col("_last"))
    return line.groupBy(*keys).agg(((F.count("*") >= 2) & one_way).alias("monotonic"))


def run_lengths(rows: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """Neighbouring equal messages of a key as one, with how often it came; nulls are equal, `order` is unique in a key."""
    at = [*keys, order]
    line = with_previous(lined(rows.select(*at, message), at), keys, [order], {"_last": F.col(message), "_any": F.lit(1)})
    fresh = F.col("_any").isNull() | ~F.col(message).eqNullSafe(F.col("_last"))
    line = stored(line.withColumn("_fresh", fresh.cast("long")), "runs")
    runs = with_total(line, at, F.col("_fresh"), "_run").withColumn("_run", F.col("_run") + F.col("_fresh"))
    out = runs.groupBy(*keys, "_run").agg(F.min(order).alias(order), F.first(message).alias(message), F.count("*").alias("times"))
    text = F.when(F.col("times") > 1, F.concat(F.col(message), F.lit(" [Repeat x"), F.col("times").cast("string"), F.lit("]"))).otherwise(F.col(message))
    return out.select(*keys, order, text.alias(message), "times")
