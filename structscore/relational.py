"""Queries for work along an order, trees of any depth, results kept as VARIANT, code and notations; they register with the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import in_six_notations, query, spread, table
from .functions import graphs, tables, text, trees
from .operators import forest, ordered
from .operators.code import code_table
from .plans import distinct, judging, results, scoring
from .sessions import install
from .shared import scratch
from .sources import jsonl, versioned


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events with their time in microseconds as `at`."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows if kind is None else rows.where(F.col("event_type") == kind)


_NEAREST = """
    WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = '{left}'),
    v AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = '{right}'),
    near AS (
      SELECT p.event_id, v.event_id AS near_id, abs(p.at - v.at) AS distance FROM p JOIN v ON p.user_id = v.user_id AND {where}
      QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.at - v.at), v.at, v.event_id) = 1)
    SELECT p.event_id, near_id, distance FROM p LEFT JOIN near ON p.event_id = near.event_id {within}
"""


def _near(spark: SparkSession, sf_dir: str, left: str, right: str, direction: str, within: float | None = None) -> DataFrame:
    columns = ["event_id", "user_id", "at"]
    asking, asked = (_events(spark, sf_dir, kind).select(columns) for kind in (left, right))
    found = ordered.nearest_join(asking, asked, ["user_id"], "at", "event_id", within, direction)
    return found.select("event_id", F.col("match.event_id").alias("near_id"), "distance")


@query(_NEAREST.format(left="purchase", right="view", where="true", within="AND distance <= 86400000000"))
def q53_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's nearest view, a day away at most."""
    return _near(spark, sf_dir, "purchase", "view", "nearest", 86_400_000_000)


@query(_NEAREST.format(left="click", right="view", where="v.at <= p.at", within=""))
def q54_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's last view at or before it."""
    return _near(spark, sf_dir, "click", "view", "backward")


@query(_NEAREST.format(left="view", right="purchase", where="v.at >= p.at", within=""))
def q55_event_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with its user's first purchase at or after it."""
    return _near(spark, sf_dir, "view", "purchase", "forward")


@query(
    """
    SELECT o_orderkey AS id, row_number() OVER w - 1 AS depth, first_value(o_orderkey) OVER w AS root FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
    """
)
def q56_order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tree, each below its customer's order before: depth and root of every one."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    line = ordered.lined(orders, ["o_custkey", "id"])
    rows = ordered.with_previous(line, ["o_custkey"], ["id"], {"parent": F.col("id")})
    return forest.rooted(rows.select("id", "parent"))


@query(
    """
    WITH RECURSIVE t AS (
      SELECT o_orderkey AS id, 0::BIGINT AS depth, o_orderpriority AS path FROM orders WHERE o_orderkey // 5 NOT IN (SELECT o_orderkey FROM orders) OR o_orderkey = 0
      UNION ALL SELECT o.o_orderkey, depth + 1, path || ' / ' || o_orderpriority FROM orders o JOIN t ON o.o_orderkey // 5 = t.id AND o.o_orderkey <> 0)
    SELECT id, depth, path FROM t
    """
)
def q57_order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tree of five children a row: the priorities from the root down to every one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 5).alias("parent"), "o_orderpriority")
    return forest.rooted(rows, "o_orderpriority").select("id", "depth", F.array_join("path", " / ").alias("path"))


@query(
    """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, max(value) FILTER (i = 0) AS least, max(value) FILTER (i = n // 4) AS lower, max(value) FILTER (i = n // 2) AS middle,
           max(value) FILTER (i = 3 * n // 4) AS upper, max(value) FILTER (i = n - 1) AS greatest FROM r GROUP BY ALL
    """
)
def q58_box_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five values that a box is drawn from, for each kind of event."""
    return ordered.order_statistics(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


@query(
    """
    WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER w AS step, lag(event_id) OVER w AS from_id, lag(value) OVER w AS from_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    f AS (SELECT *, CASE WHEN abs(step - lag(step) OVER (PARTITION BY user_id ORDER BY event_id)) <= 4 THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f),
    runs AS (SELECT user_id, run, min(from_id) AS start, count(*) + 1 AS n, arg_min(from_value, event_id) AS first, arg_min(step, event_id) AS step FROM g WHERE step IS NOT NULL GROUP BY user_id, run)
    SELECT user_id, start, n, first, round(step, 9) AS step FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) = 1
    """
)
def q59_longest_progressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of values with nearly equal steps."""
    runs = ordered.longest_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 4)
    return runs.withColumn("step", F.round("step", 9))


@query(
    """
    WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey % 8 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (5, 6) THEN NULL ELSE 'SE_MD' END AS task,
           CASE k WHEN 0 THEN '| ' || p || ' |' WHEN 1 THEN p WHEN 2 THEN '' WHEN 3 THEN 'said ' || p WHEN 4 THEN '' WHEN 7 THEN p END AS prediction,
           CASE k WHEN 2 THEN 'no_extract' WHEN 4 THEN 'no_extract' WHEN 5 THEN 'bad_results' WHEN 6 THEN 'bad_results' WHEN 7 THEN 'late' END AS error FROM o
    UNION ALL SELECT o_orderkey, 'SE_CSV', 'a,b', NULL FROM o WHERE k = 0
    """
)
def q60_variant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as VARIANT: extracts that are objects, texts, lists, missing or null, with an error, and texts that are no results."""
    p = F.col("o_orderpriority")

    def said(extract: str, more: str = "") -> Column:
        return F.replace(F.lit('{"SE_MD": {"answer": "said P"' + extract + "}" + more + "}"), F.lit("P"), p)

    shapes = [
        said(', "extract": {"extracted_table": "| P |"}', ', "SE_CSV": {"answer": "x", "extract": "a,b"}'), said(', "extract": "P"'), said(', "extract": ["P"]'),
        said(', "extract": null'), F.lit('{"SE_MD": {"extract": {"other": 1}}}'), F.lit('{"SE_MD": '), F.lit('["SE_MD"]'), said(', "extract": {"extracted_table": "P"}, "error": "late"'),
    ]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*shapes), (F.col("o_orderkey") % 8).cast("int")).alias("infer_results"))
    return results.task_results(rows).select("o_orderkey", "task", "prediction", "error")


_VIEWS = [["event_type", "day"], ["event_type"], ["day"], []]


@query(
    """
    SELECT event_type, day, GROUPING(event_type, day)::BIGINT AS view, count(*) AS count, count(DISTINCT user_id) AS exact, true AS near
    FROM (SELECT *, strftime(ts, '%d') AS day FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())
    """
)
def q61_distinct_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in every view of a report: exactly, and whether merged sketches come within five per cent or one."""
    rows = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "dd").alias("day"), "user_id")
    exact = distinct.exact_views(rows, _VIEWS, "user_id")
    about = distinct.estimated_views(distinct.sketched_buckets(rows, ["event_type", "day"], "user_id"), _VIEWS)
    about = about.select("view", *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in ("event_type", "day")], "about").withColumnRenamed("view", "_view")
    same = (F.col("view") == F.col("_view")) & (F.coalesce("event_type", F.lit("")) == F.col("_event_type")) & (F.coalesce("day", F.lit("")) == F.col("_day"))
    near = F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return exact.join(about, same, "left").select("event_type", "day", "view", "count", "exact", F.coalesce(near, F.lit(False)).alias("near"))


@query(
    """
    SELECT p_partkey, 'caf' || chr(233) || ' ' || p_name || ' ' || chr(8211) || ' ' || chr(165) || p_size || ' &unknown; & ' || chr(8364) || ' ' || chr(97 + p_size % 26) || chr(128512) || chr(65533) || ' a&b' AS cell,
           chr(233) || p_size AS other FROM part
    """
)
def q62_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an HTML table with entities by name, in decimal and hexadecimal, by Windows numbers, and unknown ones."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    letter = F.concat(F.lit("&#"), 97 + F.col("p_size") % 26, F.lit(";"))
    cell = F.concat(F.lit("caf&eacute; "), "p_name", F.lit(" &#8211; &yen;"), "p_size", F.lit(" &unknown; &amp; &#128; "), letter, F.lit("&#x1F600;&#xD800; a&b"))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr><tr><td>"), cell, F.lit("</td><td>&#XE9;"), "p_size", F.lit("</td></tr></table>"))
    row = F.get(tables.html_table(html), F.lit(1))
    return part.select("p_partkey", row.alias("r")).select("p_partkey", F.get("r", F.lit(0)).alias("cell"), F.get("r", F.lit(1)).alias("other"))


@query(
    """
    SELECT p_partkey, 'row ' || i AS line, (i * p_size + 0.5)::DOUBLE AS value, ((i * p_size + 0.5) * 2)::DOUBLE AS twice FROM (SELECT p_partkey, p_size, unnest(range(1, 2 + p_size % 4)) AS i FROM part)
    """
)
def q63_computed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plotting code whose lists are computed: ranges, arithmetic, comprehensions with a condition, names in texts; some of it cut off."""
    size = F.col("p_size").cast("string")
    n = (F.col("p_size") % 4 + 2).cast("string")
    code = F.concat(
        F.lit("import numpy as np\nstep = "), size, F.lit("\nnames = [f'row {i}' for i in range(1, "), n, F.lit(")]\nvalue = [i * step + 0.5 for i in list(range("), n, F.lit(")) if i > 0]\n"),
        F.when(F.col("p_partkey") % 2 == 0, "twice = [v * 4 / 2 for v in value]\nplt.bar(names, value)").otherwise("twice = [v + v for v in value"),
    )
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", code_table(code).alias("t"))
    each = rows.select("p_partkey", F.explode(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))).alias("r"))
    return each.select("p_partkey", F.col("r")[0].alias("line"), F.col("r")[1].cast("double").alias("value"), F.col("r")[2].cast("double").alias("twice"))


@query("SELECT r_name AS root, k::BIGINT AS k, CASE k WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS em FROM region, range(3) v(k) WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def q64_code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow charts answered as code with a list of edges: with labels beside it, with names as ends, and with other ends."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    rows = table(spark, sf_dir, "region").join(nations, "r_regionkey").select(F.col("r_name").alias("root"), "ns")
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    listed = lambda head, item: F.concat(F.lit(head), F.array_join(F.transform("ns", item), ", "))
    id_ = lambda i: F.concat(F.lit("'n"), i, F.lit("'"))
    flow = F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("ns", lambda n, i: F.concat(F.lit("r["), F.col("root"), F.lit("] -->|has| n"), i, F.lit("["), n, F.lit("]"))), "\n"))
    said = [
        F.concat(listed("edges = [", lambda n, i: F.concat(F.lit("('r', "), id_(i), F.lit(", 'has')"))), F.lit("]\n"), F.lit("labels = {'r': '"), F.col("root"), F.lit("', "), listed("", lambda n, i: F.concat(id_(i), F.lit(": "), quoted(n))), F.lit("}")),
        F.concat(F.lit("root = "), quoted(F.col("root")), listed("\nlinks = [(root, n, 'has') for n in [", lambda n, i: quoted(n)), F.lit("]]")),
        F.lit("edges = [('a', 'b')]"),
    ]
    each = rows.select("root", flow.alias("reference"), F.posexplode(F.array(*said)).alias("k", "prediction"))
    judged = judging.score_graphs(each.withColumn("task", F.lit("SE_CODE")))
    return judged.select("root", F.col("k").cast("long").alias("k"), "score.em")


@query(
    """
    SELECT r_name AS root, notation, string_agg(n_name, ',' ORDER BY n_name) AS targets, count(*) AS edges
    FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('mermaid'), ('graphviz'), ('d2'), ('cytoscape'), ('diagrams'), ('plantuml')) v(notation) GROUP BY ALL
    """
)
def q65_graphs_without_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six notations of one graph without a task: each is told by its looks and read to the same graph."""
    rows = judging.read_graphs(in_six_notations(spark, sf_dir).select("root", "prediction"), "prediction")
    labels = F.transform("graph.nodes", lambda n: n["label"])
    targets = F.array_join(F.array_sort(F.array_except(labels, F.array("root"))), ",")
    return rows.select("root", "notation", targets.alias("targets"), F.size("graph.edges").cast("long").alias("edges"))


@query(
    """
    SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS map_strict,
           round(CASE WHEN o_orderkey % 3 IN (0, 1) THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS map_slight, 1.0::DOUBLE AS map_high FROM orders
    """
)
def q66_sql_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of q03 in SQL alone, by the session's functions and its table of tolerances."""
    install(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("_q66_orders")
    return spark.sql(
        """
        WITH said AS (
          SELECT o_orderkey, concat('total', 'x', o_orderkey) AS name, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 1.04D ELSE 1.08D END AS value, o_totalprice AS meant FROM _q66_orders),
        found AS (
          SELECT s.o_orderkey, t.name, CAST(near_name(s.name, s.name, t.edits) AND near_number(s.value, s.meant, t.error) AS BIGINT) AS found,
                 CAST(s.value = s.meant AS BIGINT) AS exact, CASE WHEN s.value = s.meant THEN 1L ELSE 2L END AS both
          FROM (SELECT *, explode(array('strict', 'slight', 'high')) AS tolerance FROM said) s JOIN tolerances t ON t.name = s.tolerance)
        SELECT o_orderkey, round(max(averaged(overlap(found, exact * found, both))) FILTER (WHERE name = 'strict'), 6) AS map_strict,
               round(max(averaged(overlap(found, exact * found, both))) FILTER (WHERE name = 'slight'), 6) AS map_slight,
               round(max(averaged(overlap(found, exact * found, both))) FILTER (WHERE name = 'high'), 6) AS map_high
        FROM found GROUP BY o_orderkey
        """
    )


@query("SELECT 'model-' || (c_custkey % 3) AS model, c_custkey::VARCHAR AS img_path, CASE c_mktsegment WHEN 'BUILDING' THEN '打印' ELSE c_mktsegment END AS img_type FROM customer WHERE c_custkey % 7 <> 0")
def q67_folders_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in a folder for each model, read tolerantly: broken lines and report folders are left out, scenes renamed."""
    said = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("img_path"), F.when(F.col("c_mktsegment") == "BUILDING", "电子印刷").otherwise(F.col("c_mktsegment")).alias("img_type")))
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("model-"), F.col("c_custkey") % 3).alias("folder"), F.when(F.col("c_custkey") % 7 == 0, F.substring(said, 1, 20)).otherwise(said).alias("value"))
    path = scratch(spark, "models")
    lines.unionByName(lines.where("folder = 'model-0'").withColumn("folder", F.lit("_reports"))).write.partitionBy("folder").text(path)
    # partition folders are named folder=...; the readers look one folder deep for *.jsonl
    read = jsonl.tolerant(spark, f"{path}/folder=*/*.txt", T.StructType([T.StructField(c, T.StringType()) for c in ("img_path", "img_type")]))
    named = read.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), "folder=([^/]+)/", 1)).replace(jsonl.SCENES, subset=["img_type"])
    return named.where(~F.col("model").rlike("^[._]")).select("model", "img_path", "img_type")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def q68_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after three commits, each of which replaces what it names."""
    path = scratch(spark, "versions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for rows in (orders, orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new")), orders.where("o_orderkey % 5 = 0").withColumn("status", F.lit("again"))):
        versioned.upsert(rows, path, ["o_orderkey"], ["status"], 8)
    return versioned.read(spark, path)


@query("SELECT s_suppkey, s_name || ' x' || translate((s_suppkey % 100)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' kg m²' AS plain FROM supplier")
def q69_plain_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in names as plain text: dollar signs and text commands go, powers are raised."""
    said = F.concat(F.col("s_name"), F.lit(" $ x^{"), F.col("s_suppkey") % 100, F.lit("} $  \\mathrm{kg} m^2"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.plain_formula(said).alias("plain"))


def _triples(*keys: Column) -> Column:
    """Triples of a name and the column v, valued by place."""
    return F.array(*[tables.triple(k, F.lit("v"), F.lit(str(i))) for i, k in enumerate(keys)])


def _told(triples: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(triples, lambda t: F.concat_ws("|", t["k0"], t["k1"]))), ";")


@query(
    """
    WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k, lower(s_name) AS n, 'v' AS v FROM supplier),
    keys AS (
      SELECT s_suppkey, unnest(CASE k WHEN 0 THEN [n || '-q1', n || '-q3'] WHEN 1 THEN [n || '-sales', n || ' b-sales'] WHEN 2 THEN ['all-' || n, 'all-b ' || n] ELSE [n] END) AS name, v FROM s)
    SELECT s_suppkey, string_agg(least(name, v) || '|' || greatest(name, v), ';' ORDER BY least(name, v) || '|' || greatest(name, v)) AS keys FROM keys GROUP BY s_suppkey
    """
)
def q70_keys_brought_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a prediction brought in line with its reference: a box's subject, a shared ending, a shared beginning, outliers that nobody asked for."""
    n = F.lower("s_name")
    second = F.concat(n, F.lit(" b"))
    with_ = lambda a, b: (F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a]), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in b]))
    boxes, ends, begins = with_((n, "-q1"), (n, "-q3")), with_((n, "-sales"), (second, "-sales")), with_(("all-", n), ("all-b ", n))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", n.alias("n"), second.alias("b"), (F.col("s_suppkey") % 4).alias("k"), *[_triples(*x).alias(name) for name, x in (("box", boxes), ("end", ends), ("begin", begins))])
    bare, both = _triples(F.lit("-q1"), F.lit("-q3")), _triples(F.col("n"), F.col("b"))
    names = {"end": F.array(F.concat("n", F.lit("-sales")), F.concat("b", F.lit("-sales"))), "begin": F.array(F.concat(F.lit("all-"), "n"), F.concat(F.lit("all-b "), "n"))}
    front = F.concat(F.lit("b "), "n")
    said = {"end": (both, F.array("n", "b")), "begin": (_triples(F.col("n"), front), F.array(F.col("n"), front))}
    shared = {c: tables.with_shared(*said[c], x, tables.shared_length(x, c == "end"), c == "end") for c, x in names.items()}
    made = (
        F.when(F.col("k") == 0, tables.with_subject(bare, tables.box_subjects(F.col("box"))))
        .when(F.col("k") == 1, shared["end"])
        .when(F.col("k") == 2, shared["begin"])
        .otherwise(tables.without_optional(_triples(F.col("n"), F.lit("outlier 1"), F.lit("离散点")), _triples(F.col("n"))))
    )
    return rows.select("s_suppkey", _told(made).alias("keys"))


@query("SELECT c_custkey, c_name || '/>' || c_mktsegment || '/>>' || c_nationkey || ' x/>next' AS entries FROM customer")
def q71_plain_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as plain lines: indents tell levels; bullets, numbers, rules and tags are no part of names."""
    said = F.concat(F.lit("1. "), "c_name", F.lit("\n---\n  * "), "c_mktsegment", F.lit("\n\n      (x)\n      - "), "c_nationkey", F.lit(" x\n<br>\n  二、next"))
    made = scoring.settled(table(spark, sf_dir, "customer").select("c_custkey", F.replace(said, F.lit("\n      (x)"), F.lit("")).alias("t")), {"e": trees.text_entries(F.col("t"))})
    shown = F.array_join(F.transform("e", lambda e: F.concat(F.repeat(F.lit(">"), e["level"]), e["name"])), "/")
    return made.select("c_custkey", shown.alias("entries"))


@query(
    """
    SELECT s_suppkey, '{"nodes":["' || s_name || '","pay ' || s_nationkey || '"],"edges":[["' || s_name || '","pay ' || s_nationkey || '","then"]]}' AS told FROM supplier
    """
)
def q72_graphs_as_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph as a report shows it: labels of nodes and edges as JSON."""
    flow = F.concat(F.lit('flowchart TD\n a["'), "s_name", F.lit('"] -->|then| b["pay '), "s_nationkey", F.lit('"]'))
    made = scoring.settled(table(spark, sf_dir, "supplier").select("s_suppkey", flow.alias("t")), {"g": graphs.mermaid(F.col("t"))})
    return made.select("s_suppkey", graphs.told(F.col("g")).alias("told"))
