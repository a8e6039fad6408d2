"""Trees and graphs walked in order to outline entries, where the depth has no bound that an expression could name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = "array<struct<level:int,name:string>>"
_ENTRIES = pa.list_(pa.struct([("level", pa.int32()), ("name", pa.string())]))


def json_entries(text: str | None) -> list[dict]:
    """Entries of a JSON tree: objects with name and children, or keys over what they hold; nothing if it isn't JSON."""
    try:
        held = [(0, json.loads(text or ""))]
    except (ValueError, RecursionError):
        return []
    out = []
    while held:  # a stack, so that no depth is too deep
        level, x = held.pop()
        if isinstance(x, dict) and "name" in x:
            out.append({"level": level, "name": str(x["name"]).strip()})
            under = x.get("children")
            if isinstance(under, dict):
                under = [{"name": k, "children": v} for k, v in under.items()]
            inner = [(level + 1, c) for c in under] if isinstance(under, list) else []
        elif isinstance(x, dict):
            inner = [part for k, v in x.items() for part in ((level, {"name": k}), (level + 1, v))]
        elif isinstance(x, list):
            inner = [(level, c) for c in x]
        else:
            inner = []
            if x is not None and str(x).strip():
                out.append({"level": level, "name": str(x).strip()})
        held += reversed(inner)
    return out


def graph_entries(graph: dict | None) -> list[dict]:
    """Entries of a graph walked depth first from the nodes that no edge leads to; a node is told once."""
    nodes = {n["id"]: n["label"] for n in graph["nodes"]} if graph else {}
    below: dict[str, list[str]] = {}
    for e in graph["edges"] if graph else ():
        below.setdefault(e["src"], []).append(e["dst"])
    led_to = {d for own in below.values() for d in own}
    starts = [n for n in nodes if n not in led_to] or list(nodes)[:1]
    out, seen = [], set()
    for start in [*starts, *nodes]:  # nodes that only stand in circles come last
        held = [(0, start)]
        while held:
            level, n = held.pop()
            if n not in seen:
                seen.add(n)
                out.append({"level": level, "name": nodes.get(n, n)})
                held += [(level + 1, c) for c in reversed(below.get(n, []))]
    return out


def _arrow(of):
    @F.arrow_udf(ENTRIES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([of(v) for v in values.to_pylist()], _ENTRIES)

    return run


def json_levels(text: Column) -> Column:
    return _arrow(json_entries)(text)


def graph_levels(graph: Column) -> Column:
    return _arrow(graph_entries)(graph)
