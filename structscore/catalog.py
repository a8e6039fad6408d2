"""Queries over the driver's tables, and the SQL that says what they must return.

The tables hold no chart text, so charts are written from relations, read back
and scored; the SQL states the outcome from the relations alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers, axes, graphs, json_tables, matching, pies, tables, text, trees
from .operators import ordered
from .operators.assignment import graph_similarity, tree_similarity
from .operators.code import code_table
from .operators.walks import graph_levels, json_levels
from .plans import judging, prompts, relations, report, resume, scoring

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as the session has for a shuffle, four a core at least: a small file holds many rows, and reading a text takes long."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def _markdown(header: str, rows, rule: str):
    return F.concat(F.lit(header + "\n" + rule + "\n"), F.array_join(rows, "\n"))


#: Lines that one text table holds at most.
TABLE_LINES = 100
PIECE = ["l_orderkey", "part", "run"]


def _with_pieces(lines: DataFrame) -> DataFrame:
    """Line items with PIECE: an order's lines in a range of orders, cut into runs of TABLE_LINES.

    An order lies in one range or two, in however many parts the lines come; only
    an order larger than a range is spread over more, as many as it fills.  No
    text holds more than one piece.
    """
    own = Window.partitionBy("l_orderkey", "part").orderBy("l_linenumber")
    ranged = lines.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("l_orderkey", "_at").drop("_at")
    return ranged.withColumn("part", F.spark_partition_id()).withColumn("run", F.floor((F.row_number().over(own) - 1) / TABLE_LINES))


def _body(rows):
    """A table's rows without its header, however many there are."""
    return F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))


def _orders_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown tables of each order: line number against quantity and extended price."""
    rows = _with_pieces(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")).select(
        *PIECE, "l_linenumber", F.concat_ws(" | ", F.concat(F.lit("| L"), F.col("l_linenumber")), F.col("l_quantity").cast("bigint"), F.concat(F.col("l_discount"), F.lit(" |"))).alias("line")
    )
    made = rows.groupBy(*PIECE).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))
    return made.select("l_orderkey", _markdown("| line | quantity | discount |", F.col("lines.line"), "|---|---|---|").alias("text"))


@query(
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(em), 6) AS em, round(avg(map_strict), 6) AS map_strict, round(avg(map_high), 6) AS map_high
    FROM (SELECT o.o_orderstatus, o.o_orderpriority, CASE WHEN l.hit = l.lines THEN 1.0 ELSE 0.0 END AS em,
                 (SELECT sum(CASE WHEN sim >= t THEN 0.1 ELSE 0 END) FROM (VALUES (0.5), (0.55), (0.6000000000000001), (0.6500000000000001),
                   (0.7000000000000002), (0.7500000000000002), (0.8000000000000003), (0.8500000000000003), (0.9000000000000004), (0.9500000000000004)) v(t)) AS map_strict,
                 1.0 AS map_high
          FROM (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_linenumber % 4 <> 0) AS hit,
                       (count(*) + count(*) FILTER (WHERE l_linenumber % 4 <> 0))::DOUBLE / (2 * count(*) + count(*) FILTER (WHERE l_linenumber % 4 = 0)) AS sim
                FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey) l
          JOIN orders o ON l.l_orderkey = o.o_orderkey)
    GROUP BY ALL
    """
)
def q01_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference tables per order against answers with every fourth quantity off by 8 percent; means by status and priority."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    value = lambda factor: F.concat_ws(
        " | ", F.concat(F.lit("| L"), F.col("l_linenumber")), (F.lit(100) * factor).cast("string"), F.concat(F.lit(50), F.lit(" |"))
    )
    off = F.when(F.col("l_linenumber") % 4 == 0, F.lit(1.08)).otherwise(F.lit(1.0))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", value(F.lit(1.0)).alias("ref"), value(off).alias("pred")))).alias("x"))
    head, rule = "| line | quantity | discount |", "|---|---|---|"
    charts = rows.select("l_orderkey", _markdown(head, F.col("x.pred"), rule).alias("prediction"), _markdown(head, F.col("x.ref"), rule).alias("reference"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    groups = ["o_orderstatus", "o_orderpriority"]
    # orders of a group with equal texts have one score: it is made once and counts for all of them
    alike = charts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*groups, "prediction", "reference").agg(F.count("*").alias("orders"))
    judged = scoring.score_tables(spread(alike)).select(*groups, "orders", "score.*")
    mean = lambda m: F.round(F.sum(F.col(m) * F.col("orders")) / F.sum("orders"), 6)
    return judged.groupBy(*groups).agg(F.sum("orders").alias("n"), *[mean(m).alias(m) for m in ("em", "map_strict", "map_high")])


@query(
    """
    SELECT l_orderkey, lower(least('L' || l_linenumber, name)) AS k0, lower(greatest('L' || l_linenumber, name)) AS k1, val AS num
    FROM (SELECT l_orderkey, l_linenumber, 'quantity' AS name, l_quantity AS val FROM lineitem
          UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem)
    """
)
def q02_triples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown tables read back to triples."""
    made = scoring.settled(_orders_as_tables(spark, sf_dir), {"rows": tables.markdown_table(F.col("text"))})
    made = scoring.settled(made, {"c": tables.header_keys(F.col("rows")), "n": tables.row_keys(F.col("rows"))})
    made = scoring.settled(made, {"ts": tables.triples(F.col("rows"), F.col("c"), F.col("n"))})
    return made.select("l_orderkey", F.explode("ts").alias("t")).select("l_orderkey", "t.k0", "t.k1", "t.num")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS strict,
           CASE WHEN o_orderkey % 3 IN (0, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS slight, 1.0::DOUBLE AS high FROM orders
    """
)
def q03_tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triple per order, exact, 4 or 8 percent off: similarity at three tolerances."""
    factor = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 1.04).otherwise(1.08)
    one = lambda v: F.array(F.struct(F.lit("total").alias("k0"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("k1"), v.alias("num"), F.lit(None).cast("string").alias("txt")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", one(F.col("o_totalprice") * factor).alias("pred"), one(F.col("o_totalprice")).alias("ref"))
    return orders.select("o_orderkey", *[matching.similarity(F.col("pred"), F.col("ref"), w, e).alias(n) for n, (w, e) in matching.TOLERANCES.items()])


@query(
    """
    SELECT event_id, sim, (SELECT count(*) FROM (VALUES (0.5), (0.55), (0.6000000000000001), (0.6500000000000001), (0.7000000000000002),
      (0.7500000000000002), (0.8000000000000003), (0.8500000000000003), (0.9000000000000004), (0.9500000000000004)) v(t) WHERE sim >= t)::BIGINT AS passed,
      CASE WHEN sim >= 0.75 THEN 1.0 ELSE 0.0 END::DOUBLE AS ap_75_strict
    FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS sim FROM events)
    """
)
def q04_map_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score vector of given similarities."""
    sims = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 101) / F.lit(100.0)).alias("sim"))
    made = sims.select("event_id", "sim", matching.scores({n: F.col("sim") for n in matching.TOLERANCES}).alias("s"))
    return made.select("event_id", "sim", F.round(F.col("s.map_strict") * 10).cast("bigint").alias("passed"), "s.ap_75_strict")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged rows: flags as model and task, ship mode by number as chart family."""
    score = F.struct(*[F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * (i + 1), 6)).alias(m) for i, m in enumerate(matching.METRICS)])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("task"),
        F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("source_jsonl"),
        F.concat(F.lit("c"), F.col("l_linenumber") % 4).alias("chart_type"),
        F.when(F.col("l_partkey") % 2 == 0, "scan").otherwise("print").alias("img_type"),
        F.when(F.col("l_partkey") % 5 != 0, "en").alias("lang_type"),
        score.alias("score"),
    )


_JUDGED_SQL = """
    WITH j AS (SELECT l_returnflag AS model, l_linestatus AS task, 'f' || (l_suppkey % 3) AS source_jsonl, 'c' || (l_linenumber % 4) AS chart_type,
                      CASE WHEN l_partkey % 2 = 0 THEN 'scan' ELSE 'print' END AS img_type, CASE WHEN l_partkey % 5 <> 0 THEN 'en' ELSE '未知' END AS lang_type,
                      l_discount AS em, l_discount * 4 AS map_high FROM lineitem WHERE l_linenumber <> 7)
"""


@query(
    _JUDGED_SQL
    + """
    SELECT model, task, chart_type, img_type, lang_type, grouping_id(model, task, chart_type, img_type, lang_type)::BIGINT AS "view",
           round(avg(em), 9) AS em, count(*) AS "count" FROM j
    GROUP BY GROUPING SETS ((model, task, chart_type, img_type, lang_type), (model, task, chart_type), (model, task, img_type), (model, task, lang_type),
                            (model, task, chart_type, img_type), (model, task, chart_type, lang_type))
    """
)
def q05_detail_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six views of every model and task from one bucket table."""
    out = report.detail(report.buckets(report.scored(_judged(spark, sf_dir))))
    return out.select("model", "task", "chart_type", "img_type", "lang_type", "view", F.round("em", 9).alias("em"), "count")


@query(
    _JUDGED_SQL
    + """
    SELECT model, coalesce(round(avg(em) FILTER (WHERE task = 'F'), 9), 0) AS "F_em", coalesce(round(avg(em) FILTER (WHERE task = 'O'), 9), 0) AS "O_em" FROM j GROUP BY model
    """
)
def q06_task_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models against tasks."""
    out = report.overview(report.buckets(report.scored(_judged(spark, sf_dir))), ["F", "O"])
    return out.select("model", F.round("F_em", 9).alias("F_em"), F.round("O_em", 9).alias("O_em"))


@query(
    _JUDGED_SQL
    + """
    SELECT model, round(avg(em), 9) AS em, count(*) AS "count", coalesce(round(avg(em) FILTER (WHERE source_jsonl = 'f0'), 9), 0) AS f0_em,
           coalesce(round(avg(em) FILTER (WHERE source_jsonl = 'f1'), 9), 0) AS f1_em FROM j WHERE task = 'O' GROUP BY model
    """
)
def q07_task_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task: models against all files and each file."""
    out = report.task_sheet(report.buckets(report.scored(_judged(spark, sf_dir))), "O", ["f0", "f1", "f2"])
    return out.select("model", F.round("em", 9).alias("em"), "count", F.round("f0_em", 9).alias("f0_em"), F.round("f1_em", 9).alias("f1_em"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END::INTEGER AS place FROM orders")
def q08_priority_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of a priority list."""
    return table(spark, sf_dir, "orders").select("o_orderkey", report.place(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).alias("place"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def q09_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    return resume.last_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q10_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are still to be done."""
    return resume.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def q11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows, replaced where new ones come."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return resume.upserted(old, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    """
    SELECT event_id, unnest(CASE event_type WHEN 'click' THEN ['SE_MERMAID', 'SE_D2'] WHEN 'view' THEN ['SE_MD'] ELSE ['SE_MD', 'SE_CSV', 'SE_JSON'] END) AS task FROM events
    """
)
def q12_task_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each sample by its chart type."""
    kind = F.when(F.col("event_type") == "click", answers.FLOW_CHART).when(F.col("event_type") == "view", answers.MIND_MAP).otherwise(F.col("event_type"))
    tasks = answers.tasks_of(kind, ["SE_MD", "SE_CSV", "SE_JSON"], ["SE_MD"], ["SE_MERMAID", "SE_D2"])
    return table(spark, sf_dir, "events").select("event_id", F.explode(tasks).alias("task"))


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END::INTEGER AS kept, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS open FROM events
    """
)
def q13_applicable_and_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that fit the chart, and tasks not done yet."""
    tasks = F.array(F.lit("SE_MD"), F.lit("SE_CSV"), F.lit("SE_MERMAID"))
    kind = F.when(F.col("event_type") == "click", answers.FLOW_CHART).otherwise(F.col("event_type"))
    done = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("SE_MD"), F.lit(1)))
    open_ = F.size(answers.pending(F.array(F.lit("SE_MD"), F.lit("SE_CSV")), done))
    return table(spark, sf_dir, "events").select("event_id", F.size(answers.applicable(tasks, kind)).alias("kept"), open_.alias("open"))


def _regions_as_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline per region: its nations, and their suppliers below them."""
    nations = table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    below = nations.join(suppliers, "n_nationkey", "left").groupBy("n_regionkey", "n_name").agg(F.array_sort(F.collect_list("s_name")).alias("s"))
    line = F.concat(F.lit("  - "), F.col("n_name"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("\n    - "), x)), ""))
    listed = below.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    made = regions.join(listed, "n_regionkey").select("r_name", F.concat(F.lit("- "), F.col("r_name"), F.lit("\n"), F.col("t")).alias("text"))
    made = scoring.settled(made, {"nodes": trees.outline(F.col("text"))})
    return scoring.settled(made, {"children": trees.child_counts(F.col("nodes"))})


@query(
    """
    SELECT r_name AS root, r_name AS path FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT r_name, r_name || '/' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, r_name || '/' || n_name || '/' || s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
    """
)
def q14_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines read back to paths."""
    made = _regions_as_outline(spark, sf_dir).select(F.col("r_name").alias("root"), F.explode(trees.paths(F.col("nodes"))).alias("p"))
    return made.select("root", F.array_join("p", "/").alias("path"))


@query(
    """
    WITH n AS (SELECT r_name, n_name, count(s_suppkey) AS k, min(s_name) AS sole FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
    named AS (SELECT *, CASE WHEN k = 1 THEN n_name || '——' || sole ELSE n_name END AS shown FROM n)
    SELECT r_name AS root, count(*) + 1 + sum(CASE WHEN k > 1 THEN k ELSE 0 END)::BIGINT AS n_paths, count(*) FILTER (WHERE k = 1) AS n_joined FROM named GROUP BY r_name
    """
)
def q15_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only children joined to their parents."""
    made = _regions_as_outline(spark, sf_dir)
    plain = F.transform("nodes", lambda n: F.struct(F.regexp_replace(n["name"], "[^A-Za-z0-9]", "").alias("name"), n["path"].alias("path")))
    made = scoring.settled(made, {"merged": trees.merged_paths(plain, F.col("children"))})
    joined = F.size(F.filter("merged", lambda p: F.element_at(p, -1).contains(trees.CHAIN)))
    return made.select(F.col("r_name").alias("root"), F.size("merged").cast("bigint").alias("n_paths"), joined.cast("bigint").alias("n_joined"))


@query("SELECT r_name AS root, 1.0::DOUBLE AS strict, 1.0::DOUBLE AS high FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def q16_tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree against itself in another order of nodes."""
    made = _regions_as_outline(spark, sf_dir).select("r_name", trees.paths(F.col("nodes")).alias("a"))
    return made.select("r_name", tree_similarity(F.col("a"), F.reverse("a")).alias("s")).select(F.col("r_name").alias("root"), "s.strict", "s.high")


def _regions_as_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph per region, from the region to its nations, in four notations."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    both = table(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_name", "ns")

    def listed(head: str, line, tail: str, between: str = "\n"):
        return F.concat(F.lit(head), F.array_join(F.transform("ns", line), between), F.lit(tail))

    q = F.lit('"')
    node = lambda i: F.concat(F.lit("n"), i)
    text_ = lambda s: F.concat(q, s, q)
    return both.select(
        "r_name",
        F.size("ns").alias("size"),
        listed("flowchart TD\n", lambda n, i: F.concat(F.lit("r["), text_(F.col("r_name")), F.lit("] -->|has| "), node(i), F.lit("["), text_(n), F.lit("]")), "").alias("mermaid"),
        F.concat(
            F.lit("digraph G {\n  r [label="), text_(F.col("r_name")), F.lit("];\n"),
            F.array_join(F.transform("ns", lambda n, i: F.concat(F.lit("  "), node(i), F.lit(" [label="), text_(n), F.lit("];\n  r -> "), node(i), F.lit(' [label="has"];'))), "\n"), F.lit("\n}"),
        ).alias("graphviz"),
        F.concat(F.lit("r: "), F.col("r_name"), F.lit("\n"), F.array_join(F.transform("ns", lambda n, i: F.concat(node(i), F.lit(": "), n, F.lit("\nr -> "), node(i), F.lit(": has"))), "\n")).alias("d2"),
        F.concat(
            F.lit('{"elements": {"nodes": [{"data": {"id": "r", "label": '), text_(F.col("r_name")), F.lit("}}, "),
            F.array_join(F.transform("ns", lambda n, i: F.concat(F.lit('{"data": {"id": "'), node(i), F.lit('", "label": '), text_(n), F.lit("}}"))), ", "), F.lit('], "edges": ['),
            F.array_join(F.transform("ns", lambda n, i: F.concat(F.lit('{"data": {"source": "r", "target": "'), node(i), F.lit('", "label": "has"}}'))), ", "), F.lit("]}}"),
        ).alias("cytoscape"),
    )


@query(
    """
    SELECT r_name AS root, dsl, count(*)::INTEGER + 1 AS n_nodes, count(*)::INTEGER AS n_edges, 'has' AS label, string_agg(n_name, ',' ORDER BY n_name) AS targets
    FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('mermaid'), ('graphviz'), ('d2'), ('cytoscape')) v(dsl) GROUP BY ALL
    """
)
def q17_graph_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph in four notations, read back to the same nodes and edges."""
    made = _regions_as_graphs(spark, sf_dir)
    parts = []
    for name, parse in graphs.PARSERS.items():
        one = scoring.settled(made.select("r_name", F.lit(name).alias("dsl"), F.col(name).alias("text")), {"g": parse(F.col("text"))})
        edges = graphs.labelled_edges(F.col("g"))
        parts.append(
            one.select(
                F.col("r_name").alias("root"),
                "dsl",
                F.size("g.nodes").alias("n_nodes"),
                F.size("g.edges").alias("n_edges"),
                F.array_join(F.array_distinct(F.transform("g.edges", lambda e: e["label"])), ",").alias("label"),
                F.array_join(F.array_sort(F.transform(edges, lambda e: e["dst"])), ",").alias("targets"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT r_name AS root, 1.0::DOUBLE AS strict, 1.0::DOUBLE AS slight FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def q18_graph_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph in one notation scored against another."""
    made = _regions_as_graphs(spark, sf_dir)
    made = scoring.settled(made, {"a": graphs.mermaid(F.col("mermaid")), "b": graphs.dot(F.col("graphviz"))})
    side = lambda g: F.struct(F.transform(g["nodes"], lambda n: n["label"]).alias("nodes"), graphs.labelled_edges(g).alias("edges"))
    made = scoring.settled(made, {"x": side(F.col("a")), "y": side(F.col("b"))})
    return made.select(F.col("r_name").alias("root"), graph_similarity(F.col("x"), F.col("y")).alias("s")).select("root", "s.strict", "s.slight")


@query(
    """
    SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM (
      SELECT user_id, value, sum(CASE WHEN value - prev > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS cluster
      FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY value) AS prev FROM events))
    GROUP BY ALL
    """
)
def q19_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-dimensional clusters: a gap above the tolerance starts a new one."""
    named = ordered.gap_clusters(table(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], "value", 2)
    return named.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(
    """
    SELECT p_partkey, round(CASE WHEN x < 1000 THEN 0 + (x - 900) * (10 - 0) / (1000 - 900) WHEN x < 1500 THEN 10 + (x - 1000) * (40 - 10) / (1500 - 1000)
      ELSE 40 + (x - 1500) * (100 - 40) / (2000 - 1500) END, 4) AS y FROM (SELECT p_partkey, p_retailprice::DOUBLE AS x FROM part)
    """
)
def q20_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise-linear axis: values between ticks, and beyond the last ones by the end pieces."""
    ticks = F.array(*[F.struct(F.lit(x).alias("at"), F.lit(y).alias("value")) for x, y in ((1500.0, 40.0), (900.0, 0.0), (2000.0, 100.0), (1000.0, 10.0), (900.0, 7.0))])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(axes.interpolated(F.col("p_retailprice"), ticks), 4).alias("y"))


@query(
    """
    SELECT s_suppkey, (SELECT arg_min(x, abs(x - s_acctbal)) FROM (VALUES (-500.0::DOUBLE), (2000.0), (6000.5), (9000.25)) v(x)) AS nearest FROM supplier
    """
)
def q21_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose position is nearest."""
    labels = F.array(*[F.lit(x) for x in (-500.0, 2000.0, 6000.5, 9000.25)])
    return table(spark, sf_dir, "supplier").select("s_suppkey", axes.nearest(F.col("s_acctbal"), labels).alias("nearest"))


@query(
    """
    SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1
    """
)
def q22_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value; the first seen wins ties."""
    return relations.modes(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    r"""
    SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '<\s*br\s*/?\s*>', ' ', 'gi'), '<[^>]*>', '', 'g'),
      '&copy;', chr(169)), '&middot;', chr(183)), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text FROM pages
    """
)
def q23_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of HTML fragments: breaks, tags, entities and space."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tables.html_text(F.col("html"))).alias("text"))


@query("SELECT c_custkey, c_name AS inside, CASE WHEN c_custkey % 2 = 0 THEN 'why ' || c_custkey ELSE '' END AS thinking FROM customer")
def q24_fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in tags with fenced code."""
    body = F.concat(F.lit("Here:\n```python\n"), F.col("c_name"), F.lit("\n```\nDone"))
    reply = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<think>\nwhy "), F.col("c_custkey"), F.lit("\n</think>\n<answer>\n"), body, F.lit("\n</answer>"))).otherwise(body)
    made = table(spark, sf_dir, "customer").select("c_custkey", answers.thinking_and_answer(reply).alias("r"))
    return made.select("c_custkey", answers.extracted(F.col("r.answer"), F.lit("SE_CODE")).alias("inside"), "r.thinking")


@query(
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '-Q1' WHEN 1 THEN p_name || '-中位数' WHEN 2 THEN p_name || '-最小值' ELSE p_name || ':(x)' END AS key FROM part
    """
)
def q25_normal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of statistics and full-width marks."""
    name = F.col("p_name")
    raw = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit("下四分位数(Q1)")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Median "), name))
        .when(F.col("p_partkey") % 4 == 2, F.concat(name, F.lit(" (Min)")))
        .otherwise(F.concat(F.lit("  "), name, F.lit("：（x）　")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_key(raw).alias("key"))


@query(r"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_orderkey::DOUBLE END AS num FROM orders")
def q26_number_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are numbers by Python's rules, and one that isn't."""
    raw = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("o_totalprice"), F.lit("　")))
        .when(F.col("o_orderkey") % 3 == 1, F.translate(F.col("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９"))
        .otherwise(F.concat(F.col("o_orderkey"), F.lit("d")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.python_float(raw).alias("num"))


@query("SELECT l_orderkey, 'L' || l_linenumber AS line, l_quantity::BIGINT::VARCHAR AS quantity FROM lineitem")
def q27_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables turned twice are as before."""
    made = scoring.settled(_orders_as_tables(spark, sf_dir), {"rows": tables.markdown_table(F.col("text"))})
    made = scoring.settled(made, {"turned": tables.transpose(F.col("rows"))})
    made = scoring.settled(made, {"back": tables.transpose(F.col("turned"))})
    return made.select("l_orderkey", F.explode(_body(F.col("back"))).alias("r")).select("l_orderkey", F.col("r")[0].alias("line"), F.col("r")[1].alias("quantity"))


@query("SELECT c_custkey, c_name || ', \"x\"' AS name, c_mktsegment AS segment FROM customer")
def q28_csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted comma-separated cells."""
    line = F.concat(F.lit('key,name,segment\n'), F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit(', ""x""",'), F.col("c_mktsegment"))
    made = scoring.settled(table(spark, sf_dir, "customer").select(line.alias("text")), {"t": tables.csv_table(F.col("text"))})
    row = F.col("t")[1]
    return made.select(row[0].cast("bigint").alias("c_custkey"), row[1].alias("name"), row[2].alias("segment"))


@query("SELECT l_orderkey, 'L' || l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status FROM lineitem")
def q29_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML rows read back."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("L"), F.col("l_linenumber"))), cell(F.col("l_returnflag")), cell(F.col("l_linestatus")), F.lit("</tr>"))
    lines = _with_pieces(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))
    rows = lines.groupBy(*PIECE).agg(F.array_join(F.collect_list(row), "").alias("b"))
    made = scoring.settled(rows.select("l_orderkey", F.concat(F.lit("<table>"), F.col("b"), F.lit("</table>")).alias("text")), {"t": tables.html_table(F.col("text"))})
    return made.select("l_orderkey", F.explode("t").alias("r")).select("l_orderkey", F.col("r")[0].alias("line"), F.col("r")[1].alias("flag"), F.col("r")[2].alias("status"))


@query(_JUDGED_SQL + "SELECT model, round(sum(m) / 8, 9) AS average FROM (SELECT model, chart_type, avg(map_high) AS m FROM j GROUP BY ALL) GROUP BY model")
def q30_family_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over eight families, missing ones as 0."""
    per_type = report.means(report.buckets(report.scored(_judged(spark, sf_dir))), ["model", "chart_type"])
    return report.family_average(per_type).select("model", F.round("average", 9).alias("average"))


@query(
    """
    SELECT conv_id, min(turn) AS turn, any_value(role) || CASE WHEN count(*) > 1 THEN ' [Repeat x' || count(*) || ']' ELSE '' END AS role, count(*) AS times FROM (
      SELECT *, sum(CASE WHEN role = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations))
    GROUP BY conv_id, run
    """
)
def q31_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring equal messages as one."""
    return ordered.run_lengths(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query(
    """
    SELECT l_returnflag AS model, round(avg(CASE WHEN l_linenumber <> 7 THEN l_discount END), 9) AS dropped,
           round(sum(CASE WHEN l_linenumber <> 7 THEN l_discount ELSE 0 END) / count(*), 9) AS zero_filled FROM lineitem GROUP BY ALL
    """
)
def q32_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without failed rows, and with these as 0."""
    rows = _judged(spark, sf_dir)
    kept = report.scored(rows).groupBy("model").agg(F.round(F.avg("em"), 9).alias("dropped"))
    filled = rows.groupBy("model").agg(F.round(F.avg(F.coalesce("score.em", F.lit(0.0))), 9).alias("zero_filled"))
    return kept.join(filled, "model")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 4 THEN 0 WHEN (n_nationkey // 4) < 4 THEN 1 ELSE 2 END::INTEGER AS depth FROM nation")
def q33_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every row of an id and parent table; parents stand four to one."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 4, F.floor(F.col("n_nationkey") / 4).cast("int")).alias("parent"))
    return relations.depths(rows)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no_infer' WHEN event_id % 5 = 1 THEN 'no_extract' WHEN event_id % 5 = 2 THEN 'no_reference' END AS error FROM events")
def q34_judgement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows get no score."""
    k = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "event_id", resume.judgement_error(k != 0, F.when(k != 1, "x"), F.lit(True), F.when(k != 2, "y")).alias("error")
    )


def in_six_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, reference, task, prediction): each region's graph in the notation of each graph task, with the Mermaid one."""
    made = _regions_as_graphs(spark, sf_dir)
    node = lambda i: F.concat(F.lit("n"), i)
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    listed = table(spark, sf_dir, "region").join(nations, "r_regionkey").select(F.col("r_name").alias("root"), "ns")
    diagrams = F.concat(
        F.lit('r = Action("'), F.col("root"), F.lit('")\n'),
        F.array_join(F.transform("ns", lambda n, i: F.concat(node(i), F.lit(' = Action("'), n, F.lit('")\nr >> Edge(label="has") >> '), node(i))), "\n"),
    )
    plantuml = F.concat(
        F.lit("@startuml\n:"), F.col("root"), F.lit(";\nfork\n"),
        F.array_join(F.transform("ns", lambda n: F.concat(F.lit("-> has;\n:"), n, F.lit(";"))), "\nfork again\n"), F.lit("\nend fork\n@enduml"),
    )
    made = made.join(listed, F.col("r_name") == F.col("root")).withColumns({"diagrams": diagrams, "plantuml": plantuml})
    forms = {"SE_MERMAID": "mermaid", "SE_GRAPHVIZ": "graphviz", "SE_D2": "d2", "SE_CYTOSCAPE": "cytoscape", "SE_DIAGRAMS": "diagrams", "SE_PLANTUML": "plantuml"}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).alias("prediction")) for t, c in forms.items()]))
    return made.select("root", F.col("mermaid").alias("reference"), each.alias("x")).select("root", "reference", "x.*")


@query(
    """
    SELECT r_name AS root, task, 1.0::DOUBLE AS em, NULL::VARCHAR AS error FROM region, (VALUES ('SE_MERMAID'), ('SE_GRAPHVIZ'), ('SE_D2'), ('SE_CYTOSCAPE'), ('SE_DIAGRAMS'), ('SE_PLANTUML')) v(task)
    WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    """
)
def q35_judged_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six notations of one graph judged against its Mermaid reference."""
    rows = in_six_notations(spark, sf_dir)
    return judging.score_graphs(rows).select("root", "task", "score.em", F.lit(None).cast("string").alias("error"))


@query("SELECT l_orderkey, 'L' || l_linenumber AS line, max(l_quantity)::BIGINT::VARCHAR AS quantity, max(l_discount) AS discount FROM lineitem GROUP BY l_orderkey, l_linenumber")
def q36_json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level JSON, a category per column, read back."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    items = lines.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / TABLE_LINES)).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))).alias("x"))
    entry = lambda v: F.array_join(F.transform("x", lambda x: F.concat(F.lit('"L'), x["l_linenumber"], F.lit('": '), v(x))), ", ")
    said = F.concat(F.lit('{"values": {"quantity": {'), entry(lambda x: x["l_quantity"].cast("bigint").cast("string")), F.lit('}, "discount": {'), entry(lambda x: x["l_discount"].cast("string")), F.lit("}}}"))
    made = scoring.settled(items.select("l_orderkey", said.alias("text")), {"v": json_tables.values(F.col("text"))})
    made = scoring.settled(made, {"t": json_tables.json_table(F.col("v"))})
    rows = made.select("l_orderkey", F.explode(_body(F.col("t"))).alias("r"))
    return rows.select("l_orderkey", F.col("r")[0].alias("line"), F.col("r")[1].alias("quantity"), F.col("r")[2].cast("double").alias("discount"))


@query("SELECT l_orderkey, 'L' || l_linenumber AS line, l_quantity AS quantity, l_discount AS discount FROM lineitem")
def q37_code_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in plotting code read back."""
    lines = _with_pieces(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))
    items = lines.groupBy(*PIECE).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))).alias("x"))
    listed = lambda name, v: F.concat(F.lit(name + " = ["), F.array_join(F.transform("x", v), ", "), F.lit("]\n"))
    said = F.concat(
        F.lit("import matplotlib.pyplot as plt\n"),
        listed("names", lambda x: F.concat(F.lit("'L"), x["l_linenumber"], F.lit("'"))),
        listed("quantity", lambda x: x["l_quantity"].cast("string")),
        listed("discount", lambda x: x["l_discount"].cast("string")),
        F.lit("plt.bar(names, quantity)\nplt.show()"),
    )
    made = items.select("l_orderkey", code_table(said).alias("t"))
    rows = made.select("l_orderkey", F.explode(_body(F.col("t"))).alias("r"))
    return rows.select("l_orderkey", F.col("r")[0].alias("line"), F.col("r")[1].cast("double").alias("quantity"), F.col("r")[2].cast("double").alias("discount"))


@query(
    """
    SELECT c_custkey, CASE c_custkey % 9 WHEN 7 THEN 'no_extract' WHEN 8 THEN 'unknown_task' END AS error,
           CASE c_custkey % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 WHEN 5 THEN 1.0 WHEN 6 THEN 0.0 END::DOUBLE AS em,
           CASE c_custkey % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.2 WHEN 5 THEN 1.0 WHEN 6 THEN 0.1 END::DOUBLE AS map_high
    FROM customer
    """
)
def q38_judge_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, outlines, flow charts and pies in one judgement: right, partly right, in another form, missing."""
    k, name = F.col("c_custkey") % 9, F.col("c_name")
    md = lambda a, b: F.concat(F.lit("|  | n |\n|---|---|\n| "), name, F.lit(f" | {a} |\n| all of them | {b} |"))
    listed = F.concat(F.lit("- "), name, F.lit("\n  - left side\n  - right side"))
    flow = lambda *steps: F.concat(F.lit("flowchart TD\n n0[\""), name, F.lit("\"]"), *[F.lit(f'\n n{i} --> n{i + 1}["{x}"]') for i, x in enumerate(steps)])
    shares = F.concat(F.lit("|  |  |\n|---|---|\n| "), name, F.lit(" | 28% |\n| rest | 72% |"))
    forms = [
        ("SE_MD", md(10, 20), md(10, 20)),
        # one of two values is right: a third of the union
        ("SE_MD", md(10, 35), md(10, 20)),
        ("SE_CSV", F.concat(F.lit("id,parent_id,name\n7,0,"), name, F.lit("\n8,7,left side\n9,7,right side")), listed),
        ("SE_JSON", F.concat(F.lit('{"name":"'), name, F.lit('","children":[{"name":"left side"},{"name":"right side"}]}')), listed),
        # two of three nodes and one of two edges: 0.6 / 2 + 0.4 * 2 / 3 passes two of ten thresholds
        ("SE_MERMAID", flow("check the order"), flow("check the order", "0123456789")),
        ("SE_MERMAID", F.concat(F.lit("step | n\n"), name, F.lit(" | 12\npack the goods | 3")), flow("pack the goods")),
        # two of three triples: 2 / 4
        ("SE_MD", F.concat(F.lit("pie\n\""), name, F.lit('\" : 28\n"rest" : 7\n"more" : 9')), F.concat(shares, F.lit("\n| more | 9% |"))),
        ("SE_MD", F.lit(""), md(1, 2)),
        ("SE_NONE", md(1, 2), md(1, 2)),
    ]
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) if isinstance(f[i], str) else f[i] for f in forms]), k.cast("int"))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(
        "c_custkey", pick(0).alias("task"), pick(1).alias("prediction"), pick(2).alias("reference"), F.when(k == 6, "饼图").otherwise("柱状图").alias("chart_type")
    )
    return judging.judge(rows).select("c_custkey", "error", "score.em", F.round("score.map_high", 6).alias("map_high"))


def _outline_text(entries) -> object:
    """Entries as lines that show their levels."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.repeat(F.lit(">"), e["level"]), e["name"])), "/")


@query(
    """
    SELECT o_orderkey, 'order ' || o_orderkey || '/' || string_agg((CASE WHEN n > 1 THEN '>' ELSE '' END) || 'line ' || l_linenumber, '/' ORDER BY l_linenumber) AS entries
    FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    GROUP BY o_orderkey
    """
)
def q39_pipe_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines answered as pipe tables: repeated first cells are parents, numbers are no nodes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    each = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    rows = F.transform("n", lambda n: F.concat(F.lit("order "), F.col("l_orderkey"), F.lit(" | line "), n, F.lit(" | 12.5%")))
    made = scoring.settled(each, {"t": F.concat(F.lit("Category | Item | Value\n"), F.array_join(rows, "\n"))})
    made = scoring.settled(made, {"e": trees.pipe_entries(F.col("t"))})
    return made.select(F.col("l_orderkey").alias("o_orderkey"), _outline_text(F.col("e")).alias("entries"))


@query(
    """
    WITH RECURSIVE t(id, path, depth) AS (
      SELECT n_nationkey, [n_nationkey], 0 FROM nation WHERE n_nationkey < 4
      UNION ALL SELECT n.n_nationkey, list_append(t.path, n.n_nationkey), t.depth + 1 FROM nation n JOIN t ON n.n_nationkey >= 4 AND n.n_nationkey // 4 = t.id)
    SELECT string_agg(repeat('>', depth) || n_name, '/' ORDER BY path) AS entries FROM t JOIN nation ON n_nationkey = id
    """
)
def q40_adjacency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in a comma-separated text, children in the order of their rows."""
    line = F.concat_ws(",", F.col("n_nationkey") + 1, F.when(F.col("n_nationkey") >= 4, F.floor(F.col("n_nationkey") / 4) + 1).otherwise(0), "n_name")
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("r"))
    made = scoring.settled(rows, {"t": F.concat(F.lit("id,parent_id,name\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"))})
    return scoring.settled(made, {"e": trees.adjacency_entries(F.col("t"))}).select(_outline_text(F.col("e")).alias("entries"))


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN -(o_custkey + 0.5) WHEN 3 THEN o_custkey + 0.25 WHEN 4 THEN NULL WHEN 5 THEN 1000000 + o_custkey % 1000
      ELSE NULL END::DOUBLE AS num FROM orders
    """
)
def q41_written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with currency, units, thousands, per cent and brackets."""
    n = F.col("o_custkey").cast("string")
    said = [
        F.concat(F.lit("$"), n), F.concat(n, F.lit("万元")), F.concat(F.lit("("), n, F.lit(".5)")), F.concat(F.lit("("), n, F.lit(".25%)、")), F.concat(F.lit("("), n, F.lit(")")),
        F.concat(F.lit("￥1,000,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")), F.concat(F.lit("no "), n),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", text.written_number(F.get(F.array(*said), (F.col("o_orderkey") % 7).cast("int"))).alias("num"))


@query("SELECT c_custkey, c_name || '=' || (c_custkey % 100) || '%;rest=' || (100 - c_custkey % 100) || '%' AS shares FROM customer")
def q42_pies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pies in four forms: a table, Mermaid, a grid of pairs, a column of pairs."""
    a, n = F.col("c_name"), F.col("c_custkey") % 100
    b = 100 - n
    md = lambda *rows: F.concat_ws("\n", F.lit("| x | y |\n|---|---|"), *rows)
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    pct = lambda x: F.concat(x.cast("string"), F.lit("%"))
    forms = [
        md(row(a, pct(n)), row(F.lit("rest"), pct(b))),
        F.concat(F.lit("```mermaid\npie showData\ntitle all\n\""), a, F.lit('\" : '), n.cast("string"), F.lit('\n"rest" : '), b.cast("string"), F.lit("\n```")),
        md(row(F.concat(a, F.lit(" "), pct(n)), F.concat(F.lit("rest("), pct(b), F.lit(")")))),
        md(row(F.concat(a, F.lit(", "), pct(n))), row(F.concat(F.lit("rest （"), pct(b), F.lit("）")))),
    ]
    made = scoring.settled(table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*forms), (F.col("c_custkey") % 4).cast("int")).alias("t")), {"rows": tables.any_table(F.col("t"))})
    made = scoring.settled(made, {"rows": pies.pie_rows(F.col("t"), F.col("rows"))})
    told = F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.concat_ws("=", r))
    return made.select("c_custkey", F.array_join(told, ";").alias("shares"))


@query(
    """
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || '>ship the goods>pay at once' WHEN 1 THEN s_name || ' ship the goods>pay at once 12 days' ELSE s_name || '>ship the goods' END AS steps,
           CASE s_suppkey % 3 WHEN 0 THEN 2 ELSE 1 END AS edges FROM supplier
    """
)
def q43_listed_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow charts answered as lists of nodes: a node per cell, per row, per line; repeated and numeric cells go."""
    name = F.col("s_name")
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 3)
    cells = F.concat(F.lit("Step | What\n"), name, F.lit(" | ship the goods | 12\n**pay<br>at once** | Ship the Goods | ok"))
    by_row = F.concat(F.lit("Step | What\n"), name, F.lit(" | ship the goods | 5%\npay at once | 12 days"))
    by_line = F.concat(F.lit("- "), name, F.lit("\n• ship the goods\n7"))
    read = F.when(F.col("k") == 0, graphs.listed_nodes(cells)).when(F.col("k") == 1, graphs.listed_nodes(by_row, "row")).otherwise(graphs.listed_nodes(by_line))
    made = scoring.settled(rows.select("s_suppkey", read.alias("names")), {"g": graphs.in_a_row(F.col("names"))})
    return made.select("s_suppkey", F.array_join(F.transform("g.nodes", lambda n: n["label"]), ">").alias("steps"), F.size("g.edges").alias("edges"))


@query("SELECT r_name AS root, dsl FROM region, (VALUES ('mermaid'), ('graphviz'), ('d2'), ('cytoscape')) v(dsl) WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def q44_notation_by_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which notation a text is in, told by its looks alone."""
    made = _regions_as_graphs(spark, sf_dir)
    each = made.select(F.col("r_name").alias("root"), F.explode(F.array(*[F.col(n) for n in graphs.PARSERS])).alias("text"))
    return each.select("root", graphs.notation(F.col("text")).alias("dsl"))


@query(
    """
    SELECT r_name AS root, r_name || '/' || string_agg('>' || n_name || '/>>key ' || n_nationkey, '/' ORDER BY n_name) AS entries, r_name || '/' || string_agg('>' || n_name, '/' ORDER BY n_name) AS walked
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
    """
)
def q45_json_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in JSON, and flow charts walked as outlines."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("n"))
    under = F.transform("n", lambda x: F.struct(x["n_name"].alias("name"), F.array(F.concat(F.lit("key "), x["n_nationkey"])).alias("children")))
    arrows = F.transform("n", lambda x: F.concat(F.lit('r["'), F.col("r_name"), F.lit('"] --> n'), x["n_nationkey"], F.lit('["'), x["n_name"], F.lit('"]')))
    made = scoring.settled(each, {"t": F.to_json(F.struct(F.col("r_name").alias("name"), under.alias("children"))), "m": F.concat(F.lit("flowchart TD\n"), F.array_join(arrows, "\n"))})
    made = scoring.settled(made, {"g": graphs.mermaid(F.col("m"))}).withColumns({"e": json_levels(F.col("t")), "w": graph_levels(F.col("g"))})
    return made.select(F.col("r_name").alias("root"), _outline_text(F.col("e")).alias("entries"), _outline_text(F.col("w")).alias("walked"))


@query(
    """
    SELECT l_orderkey, count(*) >= 2 AND (bool_and(coalesce(q > p, true)) OR bool_and(coalesce(q < p, true))) AS monotonic FROM (
      SELECT l_orderkey, l_quantity AS q, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem) GROUP BY l_orderkey
    """
)
def q46_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's quantities only rise or only fall, whatever the number of its lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ordered.monotonic(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")


@query(
    """
    SELECT c_custkey, task, category FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'logic' ELSE 'data' END AS category FROM customer),
      (VALUES ('SE_MD'), ('SE_JSON'), ('SE_MERMAID'), ('SE_D2')) v(task) WHERE (category = 'flowchart') = (task IN ('SE_MERMAID', 'SE_D2'))
    """
)
def q47_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sample is asked; pairs of task and category that can't be drop out."""
    kind = F.when(F.col("c_custkey") % 3 == 0, answers.FLOW_CHART).when(F.col("c_custkey") % 3 == 1, answers.MIND_MAP).otherwise("柱状图")
    samples = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("chart_type"))
    asked = prompts.asked(samples, ["SE_MD", "SE_JSON", "SE_MERMAID", "SE_D2"])
    return asked.filter(F.length("prompt") > 20).select("c_custkey", "task", "category")


@query("SELECT DISTINCT event_type AS task FROM events")
def q48_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task once."""
    return relations.tasks_in(table(spark, sf_dir, "events").select(F.col("event_type").alias("task")))


@query(
    """
    SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '<svg id="' || c_name || '"></svg>' WHEN 1 THEN 'flowchart TD' || chr(10) || ' a --> ' || c_name WHEN 2 THEN 'digraph { a -> ' || c_custkey || ' }'
      WHEN 3 THEN '@startuml' || chr(10) || ':' || c_name || ';' || chr(10) || '@enduml' WHEN 4 THEN 'a -> ' || c_name WHEN 5 THEN '{"elements": [' || c_custkey || ']}' WHEN 6 THEN 'x = ' || c_custkey
      WHEN 7 THEN '| ' || c_name || ' |' END AS found FROM customer
    """
)
def q49_extraction_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece each task asks for, out of fences, of a fence in another language, or bare; nothing in an empty answer."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    fence = lambda lang, body: F.concat(F.lit(f"So:\n```{lang}\n"), body, F.lit("\n```\nDone."))
    forms = [
        ("SE_SVG", F.concat(F.lit('Here <svg id="'), name, F.lit('"></svg> it is'))),
        ("SE_MERMAID", fence("mermaid", F.concat(F.lit("flowchart TD\n a --> "), name))),
        ("SE_GRAPHVIZ", fence("text", F.concat(F.lit("digraph { a -> "), key, F.lit(" }")))),
        ("SE_PLANTUML", F.concat(F.lit("see @startuml\n:"), name, F.lit(";\n@enduml there"))),
        ("SE_D2", fence("d2", F.concat(F.lit("a -> "), name))),
        ("SE_CYTOSCAPE", F.concat(F.lit('It is {"elements": ['), key, F.lit("]} as asked"))),
        ("SE_CODE", fence("py", F.concat(F.lit("x = "), key))),
        ("SE_MD", F.concat(F.lit("  | "), name, F.lit(" |\n"))),
        ("SE_JSON", F.lit("  ")),
    ]
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) if isinstance(f[i], str) else f[i] for f in forms]), (F.col("c_custkey") % 9).cast("int"))
    made = scoring.settled(table(spark, sf_dir, "customer"), {"task": pick(0), "answer": pick(1)})
    return made.select("c_custkey", answers.extracted(F.col("answer"), F.col("task")).alias("found"))


@query(
    """
    SELECT s_suppkey, round(CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 / 3.0 ELSE 0 END::DOUBLE, 6) AS strict,
           round(CASE s_suppkey % 4 WHEN 0 THEN ((n - 1) / n + 2 * (n + 15) / (n + 16)) / 3 WHEN 1 THEN 1 WHEN 2 THEN 2 / 3.0 ELSE 0 END::DOUBLE, 6) AS high
    FROM (SELECT s_suppkey, length(s_name)::DOUBLE AS n FROM supplier)
    """
)
def q50_tree_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines scored at their likeness: a name off by a letter, equal ones, two of three paths, none."""
    root = F.concat(F.lit("- "), F.col("s_name"))
    ref = F.concat(root, F.lit("\n  - alpha branch\n  - gamma branch"))
    off = F.concat(F.lit("- "), F.regexp_replace("s_name", "^.", "x"), F.lit("\n  - alpha branch\n  - gamma branch"))
    k = F.col("s_suppkey") % 4
    pred = F.when(k == 0, off).when(k == 1, F.concat(root, F.lit("\n  - gamma branch\n  - alpha branch"))).when(k == 2, F.concat(root, F.lit("\n  - alpha branch"))).otherwise(F.lit(""))
    made = scoring.settled(table(spark, sf_dir, "supplier"), {"p": trees.outline(pred), "r": trees.outline(ref)})
    made = made.select("s_suppkey", tree_similarity(trees.paths(F.col("p")), trees.paths(F.col("r"))).alias("s"))
    return made.select("s_suppkey", F.round("s.strict", 6).alias("strict"), F.round("s.high", 6).alias("high"))



@query(
    """
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'SE_MERMAID' WHEN 1 THEN 'SE_MD' ELSE 'SE_JSON,SE_MD' END AS asked,
           CASE c_custkey % 3 WHEN 0 THEN 'SE_MERMAID' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'SE_MD' END ELSE CASE WHEN c_custkey % 2 = 0 THEN 'SE_JSON' ELSE 'SE_JSON,SE_MD' END END AS pending,
           CASE c_custkey % 3 WHEN 0 THEN 'SE_D2' ELSE 'SE_CSV' END AS applicable FROM customer
    """
)
def q51_tasks_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a sample by its chart, those of them not done yet, and those of a list that its chart allows."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, answers.FLOW_CHART).when(k % 3 == 1, answers.MIND_MAP).otherwise("折线图")
    done = F.when(k % 2 == 0, F.create_map(F.lit("SE_MD"), F.lit("x"), F.lit("SE_SVG"), F.lit("y")))
    made = scoring.settled(table(spark, sf_dir, "customer"), {"kind": kind, "asked": answers.tasks_of(kind, ["SE_JSON", "SE_MD"], ["SE_MD"], ["SE_MERMAID"]), "done": done})
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    allowed = answers.applicable(F.array(F.lit("SE_CSV"), F.lit("SE_D2")), F.col("kind"))
    return made.select("c_custkey", listed(F.col("asked")).alias("asked"), listed(answers.pending(F.col("asked"), F.col("done"))).alias("pending"), listed(allowed).alias("applicable"))


@query(
    """
    SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '||' WHEN 1 THEN '||' WHEN 2 THEN '|a|b' WHEN 3 THEN '|a|b' WHEN 4 THEN '|' ELSE 'x|a|b' END AS pred_header,
           CASE n_nationkey % 6 WHEN 0 THEN '||' WHEN 1 THEN '||' WHEN 4 THEN '|' WHEN 5 THEN 'y|a|b' ELSE '|a|b' END AS ref_header,
           n_name || CASE n_nationkey % 6 WHEN 4 THEN '|1' ELSE '|1|2' END AS pred_row FROM nation
    """
)
def q52_aligned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers blanked on either side, a column too many at the front, headers of two columns, and tables left alone."""
    name = F.col("n_name")
    md = lambda header, *rows: F.concat(F.lit(f"{header}\n|{'---|' * (header.count('|') - 1)}\n"), F.concat_ws("\n", *rows))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(c) if isinstance(c, str) else c for c in cells]), F.lit(" |"))
    three = (row(name, "1", "2"), row("total", "3", "4"))
    two = (row(name, "1"), row("total", "3"))
    pairs = [
        (md("| x | a | b |", *three), md("|  |  |  |", *three)),
        (md("|  |  |  |", *three), md("| x | a | b |", *three)),
        (md("| kind |  | a | b |", row("k", *[name, "1", "2"]), row("k", "total", "3", "4")), md("|  | a | b |", *three)),
        (md("|  |  | a | b |", row("1", *[name, "1", "2"]), row("2", "total", "3", "4")), md("|  | a | b |", *three)),
        (md("| x | a |", *two), md("| y | b |", *two)),
        (md("| x | a | b |", *three), md("| y | a | b |", *three)),
    ]
    pick = lambda i: F.get(F.array(*[p[i] for p in pairs]), (F.col("n_nationkey") % 6).cast("int"))
    made = scoring.parsed(table(spark, sf_dir, "nation").select("n_nationkey", pick(0).alias("p"), pick(1).alias("r")), "p", "r")
    made = scoring.settled(made, {"t": tables.aligned(F.col("pred_rows"), F.col("ref_rows"))})
    line = lambda side, i: F.array_join(F.get(F.col(f"t.{side}"), F.lit(i)), "|")
    return made.select("n_nationkey", line("pred", 0).alias("pred_header"), line("ref", 0).alias("ref_header"), line("pred", 1).alias("pred_row"))



def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
