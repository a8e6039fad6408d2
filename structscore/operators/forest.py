"""Trees given as (id, parent) tables of any size and depth, by pointer doubling.

Every row keeps a pointer to an ancestor and how far up it is.  In a round each
pointer is replaced by its target's pointer, so distances double: a tree of depth
d takes about log2(d) rounds, each a join over stored tables.  Rows whose pointer
is at a root are set aside.  What still moves when a round sets none aside goes
in circles.  All joins are sort-merge joins: stored ids and paths compress so well
that by the size of their files tables of any length would be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscore.shared import dropped, stored


def rooted(rows: DataFrame, name: str | None = None) -> DataFrame:
    """(id, depth, root) of every row below a root; with `name`, its column's values from the root down as `path`, too.

    A root has no parent, or one that is no row, or itself as parent.  Rows in
    circles, and below them, are left out, as are rows without an id.  Of rows
    that repeat an id the one with the smallest parent counts (then the smallest
    name).  An empty table has no rows.
    """
    kept = rows.select("id", "parent", *([F.col(name).alias("_name")] if name else [])).where(F.col("id").isNotNull())
    own = F.struct(F.col("parent").isNull(), "parent", *["_name"] * bool(name))
    once = stored(kept.groupBy("id").agg(F.min(own).alias("_own")).select("id", "_own.*"), "tree")
    known = once.select(F.col("id").alias("_known"))
    path = [F.array("_name").alias("path")] * bool(name)
    at_root = F.col("_known").isNull() | (F.col("parent") == F.col("id"))
    marked = once.join(known.hint("merge"), F.col("parent") == F.col("_known"), "left").select("id", "parent", at_root.alias("_root"), *path)
    # `up` is an ancestor, `depth` the way to it; `path` names what is below it, this row included
    up = F.when(F.col("_root"), F.col("id")).otherwise(F.col("parent"))
    depth = F.when(F.col("_root"), 0).otherwise(1).cast("long")
    first = stored(marked.select("id", up.alias("up"), depth.alias("depth"), "_root", *["path"] * bool(name)), "pointers")
    done = [first.where("_root")]
    moving = first.where("NOT _root")
    above = first
    while True:
        there = above.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("_root").alias("_top"), *[F.col("path").alias("_path")] * bool(name))
        joined = moving.join(there.hint("merge"), F.col("up") == F.col("_id"))
        longer = [F.concat("_path", "path").alias("path")] * bool(name)
        after = stored(joined.select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("_root"), *longer), "pointers")
        settled = after.where("_root")
        if settled.isEmpty():
            break
        done.append(settled)
        moving = after.where("NOT _root")
        above = reduce(DataFrame.unionByName, done, moving)
    dropped(after, once)
    return reduce(DataFrame.unionByName, done).select("id", "depth", F.col("up").alias("root"), *["path"] * bool(name))
