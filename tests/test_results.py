"""Entities, results as VARIANT, sketches: against Python's own library and plain counting."""

from __future__ import annotations

import html

from pyspark.sql import functions as F

from structscore.functions import tables, text
from structscore.plans import distinct, results


def test_entities_are_those_of_html(spark):
    said = ["&eacute;&Eacute;&yen;", "&#8211;&#x2013;&#X1F600;", "&#128;&#150;&#129;", "&#0;&#xD800;&#1114112;&#99999999999999999999;", "a & b && &; &#; &#x; &#xZZ; &#1a;", "&nope;&amp;lt;", "", "plain", "&NotEqualTilde;&hellip;&Aopf;", "x&lt;y&gt;z&#65"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(tables.decoded_entities(F.col("t"))).collect()]
    # a number without its semicolon, and digits that stop early, stay as they are here
    want = [html.unescape(t) for t in said]
    want[4], want[9] = said[4], "x<y>z&#65"
    assert got == want


def test_results_of_every_shape(spark):
    rows = [
        ("a", '{"T": {"answer": "x", "extract": {"extracted_table": "t"}}, "U": {"answer": "y"}, "V": "text", "W": {"extract": 12}}'),
        ("b", "{}"), ("c", None), ("d", ""), ("e", "[1]"), ("f", '{"T": {"answer": null, "extract": null, "error": "E"}}'), ("g", '{"T": {"extract": {"extracted_table": null}}}'),
    ]
    df = spark.createDataFrame([(i, r, "k") for i, r in rows], "id string, r string, key string")
    got = {tuple(r) for r in results.task_results(df, "r").collect()}
    assert got == {
        ("a", "k", "T", "x", "t", None), ("a", "k", "U", "y", "y", None), ("a", "k", "V", None, "", "no_extract"), ("a", "k", "W", None, "", "no_extract"),
        ("d", "k", None, None, None, "bad_results"), ("e", "k", None, None, None, "bad_results"), ("f", "k", "T", None, "", "E"), ("g", "k", "T", None, "", "no_extract"),
    }
    assert results.task_results(df.limit(0), "r").count() == 0


def test_sketches_come_near(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE id % 50021 END").alias("v"))
    sets = [["a", "b"], ["a"], ["b"], []]
    exact = {(r.view, r.a, r.b): (r["count"], r.exact) for r in distinct.exact_views(rows, sets, "v").collect()}
    about = {(r.view, r.a, r.b): (r["count"], r.about) for r in distinct.estimated_views(distinct.sketched_buckets(rows, ["a", "b"], "v"), sets).collect()}
    assert exact.keys() == about.keys() and len(exact) == 21 + 3 + 7 + 1
    for k, (n, e) in exact.items():
        assert about[k][0] == n and abs(about[k][1] - e) <= 0.06 * e


def test_lists_that_only_rise_or_fall(spark):
    said = {("1", "2,000", "3000"): True, ("5%", "4.5%", "-1%"): True, ("1", "1"): False, ("1",): False, ("1", "x", "3"): False, ("1", "3", "2"): False, (): False}
    df = spark.createDataFrame([(list(k),) for k in said], "v array<string>")
    assert {tuple(r.v): r.m for r in df.select("v", text.strictly_monotonic(F.col("v")).alias("m")).collect()} == said
