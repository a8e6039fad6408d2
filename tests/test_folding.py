"""Values told from code against what Python gives, cut-off code, and bounds that hold."""

from __future__ import annotations

import ast

import pytest

from structscore.operators import code, folding

TOLD = [
    "[i * 2 for i in range(5)]", "[x / 3 for x in [1, 2, 3] if x != 2]", "{k: v + 1 for k, v in zip(['a', 'b'], [1, 2])}", "sum(v for v in (1, 2, 3))",
    "list(range(1, 10, 3)) + [7] * 3", "[1, 2, 3][1:] + sorted([3, 1])", "{'a': [1, 2]}['a'][-1]", "-3 ** 2 // 2 % 5", "f'Q{2 + 1} {0.5:.2f}'",
    "max(1, 2) if 1 < 2 <= 2 else 0", "[i for i, x in enumerate('abc')]", "round(2.675, 2)", "not 1", "'ab' * 2", "list(reversed([1, 2]))",
]


@pytest.mark.parametrize("text", TOLD)
def test_equals_python(text):
    assert folding.values_of(ast.parse(f"x = {text}")) == {"x": eval(text)}


@pytest.mark.parametrize(
    "text",
    ["open('x')", "[i for i in range(10**9)]", "[0] * 10**9", "10 ** 10 ** 10", "'a' * 10**8", "[[j for j in range(9999)] for i in range(9999)]", "x", "[1][5]", "1 / 0", "().__class__", "lambda: 1", "[i for i in [1] for j in [2]]", "1 + 'a'", "exec('1')"],
)
def test_has_no_value(text):
    assert folding.values_of(ast.parse(f"y = {text}")) == {}


def test_names_are_given_in_order():
    assert folding.values_of(ast.parse("a = 1\na += 2\nb, (c, d) = a, [4, 5]\ne = f = c\ng: int = d\na = unknown()\nh = [a]\nfor i in []: pass")) == {"b": 3, "c": 4, "d": 5, "e": 4, "f": 4, "g": 5}


def test_code_that_was_cut_off():
    assert folding.values_of(folding.parsed("a = 1\nb = [1, 2, (3, 4")) == {"a": 1, "b": [1, 2, (3, 4)]}
    assert folding.values_of(folding.parsed("a = {'k': [1, 2], 'l': [3, 'x")) == {"a": {"k": [1, 2], "l": [3]}}
    assert folding.parsed("a = ]") is None and folding.parsed("a b") is None and folding.parsed("'") is None
    assert folding.values_of(folding.parsed("")) == folding.values_of(folding.parsed(None)) == {}
    assert code.table_of("names = ['a', 'b']\nv = [1, 2") == [["", "v"], ["a", "1"], ["b", "2"]]


def test_edge_lists():
    assert code.edge_list_of("a=[('x','y')]\nmy_edges=[(1,2),(2,3,'l')]") == {"nodes": [{"id": i, "label": i} for i in "123"], "edges": [{"src": "1", "dst": "2", "label": ""}, {"src": "2", "dst": "3", "label": "l"}]}
    assert code.edge_list_of("edges=[('x','y')]\nnodes=[('x','X'),('y','Y')]")["nodes"] == [{"id": "x", "label": "X"}, {"id": "y", "label": "Y"}]
    assert code.edge_list_of("edges = 3") == code.edge_list_of("x = [") == code.edge_list_of(None) == {"nodes": [], "edges": []}
