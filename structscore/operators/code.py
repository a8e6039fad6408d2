"""Charts written as Python: literal tables, and graphs in the diagrams notation.

Only the standard library's syntax tree is read; nothing is run.  These
helpers have no expression in Spark and go through Arrow batches.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import parsed, values_of

TABLE = "array<array<string>>"
GRAPH = "struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<src:string,dst:string,label:string>>>"


def _text(value: object) -> str:
    return f"{value:g}" if isinstance(value, float) and value == int(value) and abs(value) < 1e15 else str(value)


def table_of(code: str | None) -> list[list[str]]:
    """A dict of equal lists, or lists of labels and numbers of one length; else no rows.

    Column names are the dict's keys, or the labels of plot calls in order.
    Values may be computed (see `folding`), and the code may be cut off.
    """
    tree = parsed(code)
    if tree is None:
        return []
    found = values_of(tree)
    shown: list[str] = []
    # names in code that isn't ASCII may be written in other forms of their letters
    for node in ast.walk(tree) if code and ("label" in code or not code.isascii()) else ():
        if isinstance(node, ast.Call):
            shown += [k.value.value for k in node.keywords if k.arg == "label" and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str)]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for value in found.values():
        if isinstance(value, dict) and value and all(isinstance(v, (list, tuple)) for v in value.values()) and len({len(v) for v in value.values()}) == 1:
            names, columns = [str(k) for k in value], [list(v) for v in value.values()]
            if all(map(number, columns[0])):  # rows have no names of their own: a list of names may stand beside
                labels = next((v for v in found.values() if isinstance(v, (list, tuple)) and len(v) == len(columns[0]) and all(isinstance(x, str) for x in v)), None)
                if labels:
                    names, columns = ["", *names], [list(labels), *columns]
            return [names, *[[_text(x) for x in row] for row in zip(*columns, strict=True)]]
    lists = {k: list(v) for k, v in found.items() if isinstance(v, (list, tuple)) and v}
    labels = next((v for v in lists.values() if all(isinstance(x, str) for x in v)), None)
    numbers = {k: v for k, v in lists.items() if all(map(number, v)) and (labels is None or len(v) == len(labels))}
    if labels is None or not numbers:
        return []
    names = shown if len(shown) == len(numbers) else list(numbers)
    return [["", *names], *[[label, *map(_text, row)] for label, *row in zip(labels, *numbers.values(), strict=True)]]


def diagram_of(code: str | None) -> dict:
    """Nodes are names bound to calls with a text; `>>`, `<<` and `-` join them, Edge(label=...) names the join."""
    nodes: dict[str, str] = {}
    edges: list[dict] = []
    tree = parsed(code)

    def label_of(call: ast.Call) -> str:
        given = [a for a in call.args if isinstance(a, ast.Constant)] + [k.value for k in call.keywords if k.arg == "label" and isinstance(k.value, ast.Constant)]
        return str(given[0].value) if given else ""

    def ends(x: ast.AST) -> list[str] | None:
        """Node ids of an operand; None for an edge's label."""
        if isinstance(x, ast.Name):
            nodes.setdefault(x.id, x.id)
            return [x.id]
        if isinstance(x, (ast.List, ast.Tuple)):
            return [i for e in x.elts for i in ends(e) or []]
        if isinstance(x, ast.Call):
            if isinstance(x.func, ast.Name) and x.func.id == "Edge":
                return None
            name = label_of(x)
            nodes.setdefault(name, name)
            return [name]
        return []

    def join(x: ast.AST) -> tuple[list[str], str, str]:
        """What a chain ends in, and the label and direction that wait for its next node."""
        if not isinstance(x, ast.BinOp):
            return ends(x) or [], "", ""
        left, label, way = join(x.left)
        here = {ast.RShift: ">>", ast.LShift: "<<", ast.Sub: "-"}.get(type(x.op), ">>")
        right = ends(x.right) if not isinstance(x.right, ast.BinOp) else join(x.right)[0]
        if right is None:
            return left, label_of(x.right), here
        for a in left:
            for b in right:
                edges.append({"src": b, "dst": a, "label": label} if (way or here) == "<<" else {"src": a, "dst": b, "label": label})
        return right, "", ""

    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call):
            nodes[node.targets[0].id] = label_of(node.value) or node.targets[0].id
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.BinOp):
            join(node.value)
    return {"nodes": [{"id": k, "label": v} for k, v in nodes.items()], "edges": edges}


def _edge_of(x: object) -> tuple[str, str, str] | None:
    """(from, to, label) of a pair or triple of texts or numbers."""
    fits = isinstance(x, (list, tuple)) and len(x) in (2, 3) and all(isinstance(v, (str, int, float)) for v in x)
    return (str(x[0]), str(x[1]), str(x[2]) if len(x) == 3 else "") if fits else None


def edge_list_of(code: str | None) -> dict:
    """The graph in code that holds a list of its edges: pairs, or triples with a label, of names.

    The longest such list counts, a variable with edge in its name before others.
    A dict of texts or a list of pairs (name, text) beside it that names all ends
    tells the nodes' labels.
    """
    tree = parsed(code)
    found = values_of(tree) if tree else {}
    lists = {}
    for name, value in found.items():
        edges = [_edge_of(x) for x in value] if isinstance(value, (list, tuple)) else []
        if edges and all(edges):
            lists[name] = edges
    if not lists:
        return {"nodes": [], "edges": []}
    chosen = max(lists, key=lambda n: ("edge" in n.lower(), len(lists[n])))
    ends = list(dict.fromkeys(v for a, b, _ in lists[chosen] for v in (a, b)))
    labels: dict[str, str] = {}
    for name, value in found.items():
        pairs = list(value.items()) if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else []
        if name != chosen and pairs and all(isinstance(p, (list, tuple)) and len(p) == 2 and isinstance(p[1], str) for p in pairs):
            told = {str(a): b for a, b in pairs}
            if set(ends) <= set(told):
                labels = told
    return {"nodes": [{"id": v, "label": labels.get(v, v)} for v in ends], "edges": [{"src": a, "dst": b, "label": c} for a, b, c in lists[chosen]]}


def _arrow(kind: str, of, type_: pa.DataType):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([of(t) for t in texts.to_pylist()], type_)

    return run


_NODE = pa.struct([("id", pa.string()), ("label", pa.string())])
_EDGE = pa.struct([("src", pa.string()), ("dst", pa.string()), ("label", pa.string())])


def code_table(code: Column) -> Column:
    return _arrow(TABLE, table_of, pa.list_(pa.list_(pa.string())))(code)


def code_graph(code: Column) -> Column:
    return _arrow(GRAPH, diagram_of, pa.struct([("nodes", pa.list_(_NODE)), ("edges", pa.list_(_EDGE))]))(code)


def code_edges(code: Column) -> Column:
    return _arrow(GRAPH, edge_list_of, pa.struct([("nodes", pa.list_(_NODE)), ("edges", pa.list_(_EDGE))]))(code)
