"""An order with very many lines comes back whole from every query that writes orders as tables."""

from __future__ import annotations

from collections import Counter

import pytest

from structscore import catalog


@pytest.fixture(scope="module")
def lines():
    rows = [(1, i + 1, float(i % 50), (i % 11) / 100, "N", "O") for i in range(1500)] + [(2, i % 7 + 1, 5.0, 0.05, "R", "F") for i in range(1200)]
    return rows + [(3, 1, 2.0, 0.01, "A", "F")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, lines):
    path = tmp_path_factory.mktemp("hot")
    kind = "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kind).coalesce(2).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


WANT = {
    "q02_triples_roundtrip": lambda k, n, q, d, f, s: [(k, *map(str.lower, sorted((f"L{n}", name))), v) for name, v in (("quantity", q), ("discount", d))],
    "q27_transpose": lambda k, n, q, d, f, s: [(k, f"L{n}", str(int(q)))],
    "q29_html_tables": lambda k, n, q, d, f, s: [(k, f"L{n}", f, s)],
    "q37_code_tables": lambda k, n, q, d, f, s: [(k, f"L{n}", q, d)],
}


@pytest.mark.parametrize("name", WANT)
def test_every_line_of_a_hot_order(spark, folder, lines, name):
    got = Counter(tuple(r) for r in catalog.queries()[name](spark, folder).collect())
    assert got == Counter(x for row in lines for x in WANT[name](*row))


def test_every_line_number_of_a_hot_order(spark, folder, lines):
    most: dict = {}
    for k, n, q, d, _, _ in lines:
        a, b = most.get((k, f"L{n}"), (0.0, 0.0))
        most[k, f"L{n}"] = (max(a, q), max(b, d))
    want = Counter((*key, str(int(q)), d) for key, (q, d) in most.items())
    assert Counter(tuple(r) for r in catalog.queries()["q36_json_tables"](spark, folder).collect()) == want


def test_pieces_of_a_hot_order_are_bounded(spark, folder):
    made = catalog._with_pieces(catalog.table(spark, folder, "lineitem")).groupBy(*catalog.PIECE).count()
    assert max(r["count"] for r in made.collect()) <= catalog.TABLE_LINES
