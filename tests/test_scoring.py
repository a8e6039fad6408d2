"""Table scores: values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from structscore.functions import matching, tables, text
from structscore.plans import scoring


def md(*rows):
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])


HTML = '<table><tr><th>n</th><th colspan=2>v</th></tr><tr><td rowspan="2">a</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4&lt;</td></tr></table>'

CASES = {
    "headless reference": (md(["类别", "得分"], ["财富", "8"], ["家庭", "6"]), md(["", ""], ["财富", "8"], ["家庭", "6"]), 1.0, 1.0),
    "comma separated": ("类别,得分\n财富,8\n家庭,6", md(["", ""], ["财富", "8"], ["家庭", "6"]), 1.0, 1.0),
    "negative reference fits any": (md(["k", "x", "y"], ["a", "500", "1"]), md(["k", "x", "y"], ["a", "-3", "1"]), 1.0, 1.0),
    "zero fits zero only": (md(["", "A", "B"], ["r", "0.001", "2"]), md(["", "A", "B"], ["r", "0", "2"]), 1 / 3, 1 / 3),
    "named first column": (md(["Year", "n", "A", "B"], ["x", "2013", "1", "2"]), md(["", "A", "B"], ["2013", "1", "2"]), 1.0, 1.0),
    "running number": (md(["", "Y", "A"], ["1", "2013", "1"], ["2", "2014", "3"]), md(["", "A"], ["2013", "1"], ["2014", "3"]), 1.0, 1.0),
    "box subject": (md(["n", "-最小值", "-Q1"], ["g", "1", "2"]), md(["n", "工资-最小值", "工资-Q1"], ["g", "1", "2"]), 1.0, 1.0),
    "shared ending": (md(["", "MSFT", "V"], ["2010", "1", "2"]), md(["", "MSFT-Return", "V-Return"], ["2010", "1", "2"]), 1.0, 1.0),
    "shared beginning": (md(["", "10m", "5m"], ["2010", "1", "2"]), md(["", "Level-10m", "Level-5m"], ["2010", "1", "2"]), 1.0, 1.0),
    "turned": (md(["", "q", "a"], ["x", "1", "2"], ["y", "4", "5"], ["z", "7", "8"]), md(["", "x", "y", "z"], ["q", "1", "4", "7"], ["a", "2", "5", "8"]), 1.0, 1.0),
    "outliers not in reference": (md(["", "A", "outlier"], ["r", "1", "9"], ["s", "2", "9"]), md(["", "A", "B"], ["r", "1", "3"], ["s", "2", "4"]), 0.5, 0.5),
    "html": (HTML, HTML, 1.0, 1.0),
    "four percent off": (md(["", "A", "B"], ["r", "104", "2"]), md(["", "A", "B"], ["r", "100", "2"]), 1 / 3, 1.0),
    "no prediction": (None, md(["", "A"], ["r", "1"]), 0.0, 0.0),
    "both empty": ("", "", 0.0, 0.0),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, p, r) for k, (p, r, _, _) in CASES.items()], "name string, prediction string, reference string")
    got = {r.name: (r.sim_strict, r.sim_high, r.score) for r in scoring.score_tables(df).collect()}
    for name, (_, _, strict, high) in CASES.items():
        assert got[name][:2] == (pytest.approx(strict), pytest.approx(high)), name
        s = got[name][2]
        assert s.map_strict <= s.map_slight <= s.map_high and s.em <= s.map_strict + 1e-15
        if strict == 1:
            assert s.em == 1.0 and s.map_strict == 0.9999999999999999


def test_permuted_rows_and_columns_score_the_same(spark):
    ref = md(["", "A", "B", "C"], ["r", "1", "2", "x"], ["s", "4", "5", "y"])
    pred = md(["", "C", "A", "B"], ["s", "y", "4", "5"], ["r", "x", "1", "2"])
    df = spark.createDataFrame([(pred, ref)], "prediction string, reference string")
    assert scoring.score_tables(df).first().score.em == 1.0


def test_two_predictions_may_fit_one_reference(spark):
    t = "array<struct<k0:string,k1:string,num:double,txt:string>>"
    df = spark.createDataFrame([([("", "ab", 1.0, None), ("", "ac", 1.0, None)], [("", "aa", 1.0, None)])], f"p {t}, r {t}")
    assert df.select(matching.similarity(F.col("p"), F.col("r"), 2, 0.05)).first()[0] == 2.0
    assert df.select(matching.similarity(F.col("p"), F.col("r"), 0, 0.0)).first()[0] == 0.0


def test_thresholds_drift(spark):
    df = spark.createDataFrame([(1.0,), (0.6,), (0.75,), (0.5,), (0.0,)], "s double")
    got = [r[0] for r in df.select(matching.averaged(F.col("s"))).collect()]
    assert got == [0.9999999999999999, 0.2, 0.5, 0.1, 0.0]


KEYS = {
    "下四分位数(Q1)": "-Q1",
    "工资下四分位数(Q1)": "工资-Q1",
    "len (Min)": "len-最小值",
    "第一四分位数-配送时长(分钟)": "配送时长(分钟)-Q1",
    "最小值-工资": "工资-最小值",
    "salary-Q1": "salary-Q1",
    "$ m^{2} $": "m²",
    "$ \\text{元}/m^{2} $": "元/m²",
    "a：b（c）": "a:b(c)",
    "工资Min": "工资Min",
    "  plain\u3000": "plain",
    "": "",
}


def test_keys(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "k string")
    assert {r.k: r.v for r in df.select("k", text.normal_key(F.col("k")).alias("v")).collect()} == KEYS


def test_numbers(spark):
    said = ["1_000", "１２", "12d", "1e5", "-3.50", " 7 ", "1,234", ".5", "5.", "0x1", "inf", "-Infinity", "", "_1", "1__0", "1e-5", "123456789.25"]

    def python(s):
        try:
            return float(s)
        except ValueError:
            return None

    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.python_float(F.col("s")).alias("v"))
    rows = df.select("s", "v", text.python_repr(F.col("v")).alias("r")).collect()
    assert {r.s: r.v for r in rows} == {s: python(s) for s in said}
    for r in rows:
        if r.v is not None and 1e-4 <= abs(r.v) < 1e16:
            assert r.r == str(r.v)


def test_table_forms(spark):
    want = [["n", "v"], ["a", "1"], ["b", ""]]
    forms = {
        "markdown": (tables.markdown_table, "| n | v |\n|:--|--:|\n| a | 1 |\n| b |  |"),
        "csv": (tables.csv_table, 'n,v\n"a",1\nb,'),
        "html": (tables.html_table, "<table><tr><th>n</th><th>v</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td></td></tr></table>"),
    }
    for name, (form, said) in forms.items():
        got = spark.createDataFrame([(said,)], "t string").select(form(F.col("t"))).first()[0]
        assert got == want, name


def test_orders_with_equal_texts_are_scored_once(spark, tmp_path, monkeypatch):
    """q01's scoring gets a row per group and pair of texts, however many orders share them; means count every order."""
    from structscore import catalog

    orders = [(i, "FO"[i % 2], "1-URGENT") for i in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i, n) for i, _, _ in orders for n in range(1, 6 if i < 100 else 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, score = [], scoring.score_tables
    monkeypatch.setattr(catalog.scoring, "score_tables", lambda df, *a, **k: (seen.append(df.count()), score(df, *a, **k))[1])
    out = {r.o_orderstatus: r for r in catalog.q01_table_scores(spark, str(tmp_path)).collect()}
    assert seen == [4]
    assert {k: (r.n, r.em, r.map_high) for k, r in out.items()} == {"F": (200, 0.75, 1.0), "O": (200, 0.75, 1.0)}


def test_texts_of_a_small_file_are_judged_in_many_tasks(spark, tmp_path, monkeypatch):
    """q38's rows are dealt before they are judged: customers come in one small file."""
    from structscore import catalog

    spark.range(200).selectExpr("id AS c_custkey", "'Customer' || id AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    monkeypatch.setattr(catalog.judging, "judge", lambda rows: (seen.append(rows.rdd.getNumPartitions()), rows.selectExpr("*", "NULL AS error", "named_struct('em', 1.0, 'map_high', 1.0) AS score"))[1])
    assert catalog.q38_judge_all_forms(spark, str(tmp_path)).count() == 200
    assert seen[0] >= 4 * spark.sparkContext.defaultParallelism
