"""Equal values, long trees and long texts: what only larger tables show."""

from __future__ import annotations

from pyspark.sql import functions as F

from structscore import catalog
from structscore.functions import tables, text, trees
from structscore.operators import assignment, code, forest, ordered
from structscore.plans import scoring


def _broadcasts(spark, since: int) -> int:
    """Broadcasts in the plans of all executions from number `since` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    ids = [found.apply(i).executionId() for i in range(found.size())]
    names = []
    for i in ids[since:]:
        nodes = store.planGraph(i).allNodes()
        names += [nodes.apply(k).name() for k in range(nodes.size())]
    return sum(n == "BroadcastExchange" for n in names)


def test_equal_values_share_a_cluster(spark):
    """Rows that are equal get one number, whichever of them a step sees first."""
    rows = spark.range(6_000).select((F.col("id") % 5).alias("key"), (F.floor(F.col("id") / 5) % 40 * 5).alias("at"), "id").repartition(7, "id")
    # stored tables in many files come back in another order
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "47")
    try:
        found = ordered.gap_clusters(rows, ["key"], "at", 2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(found) == 6_000
    assert [r for r in found if r.cluster * 5 != r.at] == []


def test_a_forest_broadcasts_nothing(spark):
    """Neither ids nor paths go through the driver, however small their files are."""
    rows = spark.range(5_000).select("id", F.floor(F.col("id") / 5).alias("parent"), F.lit("x").alias("name"))
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    found = forest.rooted(rows, "name")
    assert found.count() == 5_000
    assert _broadcasts(spark, before) == 0


def test_outlines_of_many_lines(spark):
    """5,000 nodes over several folds: paths, children and chains as a plain reading has them; an empty outline has none."""
    depth = [0, *[1 + i * 7 % 3 if i % 50 else 1 for i in range(1, 5_000)]]
    depth = [d if not i else min(d, depth[i - 1] + 1) for i, d in enumerate(depth)]
    text = "\n".join("  " * d + f"- n{i}" for i, d in enumerate(depth))
    open_, up = [], []
    for i, d in enumerate(depth):
        open_ = [(e, j) for e, j in open_ if e < d]
        up.append([j for _, j in open_] + [i])
        open_.append((d, i))
    children = [0] * len(up)
    for p in up:
        if len(p) > 1:
            children[p[-2]] += 1
    made = scoring.settled(spark.createDataFrame([(0, text), (1, "")], "k int, text string").repartition(2), {"nodes": trees.outline(F.col("text"))})
    made = scoring.settled(made, {"children": trees.child_counts(F.col("nodes"))})
    renamed = F.transform("nodes", lambda n: F.struct(F.concat(n["name"], F.lit("x")).alias("name"), n["path"].alias("path")))
    rows = {r.k: r for r in made.select("k", "children", F.col("nodes.path").alias("up"), trees.merged_paths(renamed, F.col("children")).alias("merged")).collect()}
    assert rows[0].up == up and rows[0].children == children
    want = []
    for p in up:
        if children[p[-1]] != 1:
            names, single = [], False
            for j in p:
                names[len(names) - 1 if single else len(names) :] = [names[-1] + trees.CHAIN + f"n{j}x" if single else f"n{j}x"]
                single = children[j] == 1
            want.append(names)
    assert rows[0].merged == want
    assert rows[1].up == [] and rows[1].children == [] and rows[1].merged == []


def test_equal_lists_need_no_table_of_pairs():
    """20,000 paths against themselves and half of them; unequal lists are still paired at their likeness."""
    names = [["root", f"n{i}"] for i in range(20_000)]
    assert assignment._tree_sims(names, names[::-1], assignment.LIKENESS) == [1.0, 1.0, 1.0]
    assert assignment._tree_sims(names[::2], names, assignment.LIKENESS) == [0.5, 0.5, 0.5]
    assert assignment._tree_sims([["a"], ["abcd"]], [["a"], ["abce"]], assignment.LIKENESS) == [0.5, 0.5, 0.875]


def test_an_order_in_many_parts_is_few_pieces(spark):
    """Lines of an order that come from many parts share a text; a hot order is still cut."""
    lines = spark.range(4_000).select((F.col("id") % 1_000).alias("l_orderkey"), F.floor(F.col("id") / 1_000).alias("l_linenumber")).repartition(40)
    pieces = catalog._with_pieces(lines).groupBy(*catalog.PIECE).count().collect()
    assert sum(r["count"] for r in pieces) == 4_000
    # every order's four lines together, but for those that a range's end divides
    assert len(pieces) < 1_100


def test_entity_names_are_looked_up_in_short_maps(spark):
    assert max(map(len, tables._names_by_letter())) < 200
    names = list(tables._entity_names().items())
    df = spark.createDataFrame([(n, mark) for n, mark in names], "name string, mark string").repartition(2)
    told = tables.decoded_entities(F.concat(F.lit("x&"), "name", F.lit(";&1a;&_b;&~;&;")))
    assert [r for r in df.select("name", "mark", told.alias("t")).collect() if r.t != f"x{r.mark}&1a;&_b;&~;&;"] == []


def test_casts_are_not_tried_on_what_is_no_number(spark):
    """The plan tests a span's digits and a name's letters before it casts: a failed cast throws within, at many times the cost."""
    df = spark.createDataFrame([("line 1",), ("1,234.5",), ("12%",), ("1e5",), ("-7",), ("1 234",), ("12 34",), (".5",), ("x",), ("",)], "t string")
    assert [r.q for r in df.select(text.is_quantity(F.col("t")).alias("q")).collect()] == [False, True, True, False, True, True, False, True, False, False]
    plan = df.select(text.is_quantity(F.col("t")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("lower(") < plan.index("try_cast(")
    html = "<table><tr><td rowspan=2>a</td><td colspan='2'>b</td></tr><tr><td rowspan=x>c</td><td>d</td></tr></table>"
    assert df.limit(1).select(tables.html_table(F.lit(html)).alias("t")).first().t == [["a", "b", "b"], ["a", "c", "d"]]


def test_small_files_are_spread_over_tasks(spark):
    assert catalog.spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= 16


def test_code_with_many_constants_keeps_its_steps():
    """Constants count as steps, labels are found, also in letters of another form."""
    code_ = "names = ['a', 'b']\nv = [1, 2]\nplt.plot(names, v, {}='shown')"
    for word in ("label", "ｌabel"):
        assert code.table_of(code_.format(word)) == [["", "shown"], ["a", "1"], ["b", "2"]]
    assert code.table_of("names = ['a', 'b']\nv = [1, 2]\nw = [" + "0, " * 20_001 + "]") == [["", "v"], ["a", "1"], ["b", "2"]]


def test_no_code_is_no_table():
    assert code.table_of(None) == [] and code.table_of("") == []
