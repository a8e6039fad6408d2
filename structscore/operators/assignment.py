"""Best pairing of two lists by string likeness, for trees and graphs.

The likeness is 1 - edits / (both lengths), where an edit inserts or deletes.
Spark has no such distance and no assignment, so this part is an Arrow-batched
function; it gets two lists of one row and returns three numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Likeness from which a pair counts, per tolerance.
LIKENESS = (1.0, 0.85, 0.6)
LOOSE_LIKENESS = (0.95, 0.75, 0.5)

SIMS = "struct<strict:double,slight:double,high:double>"


def ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:  # bit-parallel rows of the subsequence table
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost: shortest augmenting paths (Crouse 2016), rows in order, lowest column first."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        far, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, low, end = r, 0.0, -1
        rows = [r]
        while end < 0:
            d = low + c[i] - u[i] - v
            better = ~done & (d < far)
            far[better], via[better] = d[better], i
            open_ = np.where(done, np.inf, far)
            j = int(open_.argmin())
            low = open_[j]
            done[j] = True
            if owner[j] < 0:
                end = j
            else:
                i = int(owner[j])
                rows.append(i)
        u[r] += low
        for i in rows[1:]:
            u[i] += low - far[np.flatnonzero(owner == i)[0]]
        v[done] -= low - far[done]
        j = end
        while True:
            i = int(via[j])
            owner[j], nxt = i, int(np.flatnonzero(owner == i)[0]) if i != r else -1
            if i == r:
                break
            j = nxt
    pairs = sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)
    return [(j, i) for i, j in pairs] if turned else pairs


def paired(left: list, right: list, likeness, same=None) -> list[float] | None:
    """Likeness of each pair of the best pairing; None where both lists are empty.

    `same` gives what is equal in two items only if their likeness is 1.  Where
    one list holds all of the other, pairs of equal items cost nothing, so every
    best pairing costs nothing, and no table of all pairs is needed.
    """
    if not left and not right:
        return None
    if not left or not right:
        return []
    fewer, more = sorted((left, right), key=len)
    if same is not None and not Counter(map(same, fewer)) - Counter(map(same, more)):
        return [1.0] * len(fewer)
    table = np.array([[likeness(a, b) for b in right] for a in left])
    return [float(table[i, j]) for i, j in assign(1 - table)]


def _sums(pairs: list[float] | None, size: int, limits: tuple[float, ...]) -> list[float]:
    if pairs is None:
        return [1.0] * len(limits)
    return [sum(x for x in pairs if x >= t) / size for t in limits]


def _edge_key(a: dict) -> tuple[str, str, str]:
    return a["src"].lower(), a["dst"].lower(), (a["label"] or "").lower()


def _edge_likeness(a: dict, b: dict) -> float:
    ends = ratio(a["src"].lower(), b["src"].lower()) + ratio(a["dst"].lower(), b["dst"].lower())
    told = 1.0 if not a["label"] and not b["label"] else ratio(a["label"].lower(), b["label"].lower())
    return (ends + told) / 3


def _tree_sims(left: list, right: list, limits: tuple[float, ...]) -> list[float]:
    a, b = [" -> ".join(p).lower() for p in left], [" -> ".join(p).lower() for p in right]
    return _sums(paired(a, b, ratio, str), max(len(a), len(b)), limits)


def _graph_sims(left: dict, right: dict, limits: tuple[float, ...]) -> list[float]:
    """0.6 of the edges' score and 0.4 of the nodes'; an empty graph scores 0; without edges on both sides nodes alone."""
    if not left["nodes"] or not right["nodes"]:
        return [0.0] * len(limits)
    nodes = _sums(paired([x.lower() for x in left["nodes"]], [x.lower() for x in right["nodes"]], ratio, str), max(len(left["nodes"]), len(right["nodes"])), limits)
    if not left["edges"] and not right["edges"]:
        return nodes
    edges = _sums(paired(left["edges"], right["edges"], _edge_likeness, _edge_key), max(len(left["edges"]), len(right["edges"])), limits)
    return [0.6 * e + 0.4 * n for e, n in zip(edges, nodes, strict=True)]


def _arrow(sims, limits: tuple[float, ...]):
    @F.arrow_udf(SIMS)
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
            rows = [(None,) * 3 if a is None or b is None else sims(a, b, limits) for a, b in pairs]
            columns = [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            absent = pa.array([r[0] is None for r in rows], pa.bool_())
            yield pa.StructArray.from_arrays(columns, names=["strict", "slight", "high"], mask=absent)

    return score


def tree_similarity(pred_paths: Column, ref_paths: Column, loose: bool = False) -> Column:
    """struct<strict, slight, high> of two lists of paths, null where one is; the pairing is made once for all three."""
    return _arrow(_tree_sims, LOOSE_LIKENESS if loose else LIKENESS)(pred_paths, ref_paths)


def graph_similarity(pred: Column, ref: Column, loose: bool = False) -> Column:
    """struct<strict, slight, high> of two struct<nodes: labels, edges: labelled edges>, null where one is."""
    return _arrow(_graph_sims, LOOSE_LIKENESS if loose else LIKENESS)(pred, ref)
