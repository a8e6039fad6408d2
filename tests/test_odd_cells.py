"""CSV cells with line ends, and HTML rows that are empty or short."""

from __future__ import annotations

from pyspark.sql import functions as F

from structscore.functions import tables


def test_line_ends_in_quoted_cells(spark):
    said = {'k,v\n"a\nb",1\nc,"x ""y""\n, z"': [["k", "v"], ["a\nb", "1"], ["c", 'x "y"\n, z']], "k,v\n\na,1\n": [["k", "v"], ["a", "1"]], 'a,5"\nb,6': [["a", '5"'], ["b", "6"]]}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.x for r in df.select("t", tables.csv_table(F.col("t")).alias("x")).collect()} == said


def test_empty_and_short_html_rows(spark):
    t = "<table><tr><td>a</td><td>b</td></tr><tr><td></td><td> </td></tr><tr><td>c</td></tr></table>"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(tables.html_table(F.col("t"))).first()[0] == [["a", "b"], ["c", ""]]
