"""Vector codes (product quantisation) by filtering Lloyd.

Vectors of whole numbers are cut into four parts.  Every block of vectors keeps
a kd-tree for each part position, whose nodes hold bounding box, sum and count.
In a round the entries of a codebook go down the tree together: the entry
nearest to a box's middle throws out each entry that is no nearer at any corner
of the box, and where one entry is left the whole subtree is its, by the sum and
count that the node holds.  Trees are built once and stored in the shared folder;
a round reads them, and each task sends one row of sums per used entry.

Codebooks are 4 x 256 entries, whatever the input; only they pass the driver.
All numbers are 64-bit integers, so there is no rounding anywhere.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Vectors of a block; points of a leaf; (node, entry) pairs looked at together.
BLOCK = 8192
LEAF = 8
PAIRS = 1 << 16

Tree = dict[str, np.ndarray]


def largest_component(width: int) -> int:
    """Components stop at this size, so that a squared distance over `width` of them fits 64 bits."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def build_tree(points: np.ndarray) -> Tree:
    """The kd-tree of a block's parts (n x width): halves along the widest side, level by level.

    `order` sorts points so that a node's are `start` to `stop`; children of a
    node are `child` and `child` + 1, none where it is 0.
    """
    order = np.arange(len(points))
    start, stop, child, lo, hi, total = [0], [len(points)], [0], [], [], []
    node = 0
    while node < len(start):
        own = points[order[start[node] : stop[node]]]
        low, high = own.min(0), own.max(0)
        lo.append(low)
        hi.append(high)
        total.append(own.sum(0))
        if len(own) > LEAF and (high > low).any():
            half = len(own) // 2
            turned = np.argpartition(own[:, np.argmax(high - low)], half)
            order[start[node] : stop[node]] = order[start[node] : stop[node]][turned]
            child[node] = len(start)
            start += [start[node], start[node] + half]
            stop += [start[node] + half, stop[node]]
            child += [0, 0]
        node += 1
    return {"order": order, "start": np.array(start), "stop": np.array(stop), "child": np.array(child), "lo": np.array(lo), "hi": np.array(hi), "sum": np.array(total), "points": points[order]}


def _nearest(owner: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """For runs of equal `owner`: where the least distance is; of equal ones the lower entry, as entries ascend in a run."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    at = np.flatnonzero(distance == np.minimum.reduceat(distance, first)[run])
    return at[np.append(True, run[at][1:] != run[at][:-1])]


def _survivors(tree: Tree, owner: np.ndarray, entry: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which (node, entry) pairs stay: entries that may be nearest to some point in the node's box."""
    lo, hi, z = tree["lo"][owner], tree["hi"][owner], book[entry]
    best = _nearest(owner, entry, ((2 * z - lo - hi) ** 2).sum(1))
    run = np.cumsum(np.append(0, owner[1:] != owner[:-1]))
    chosen = entry[best][run]
    top = book[chosen]
    corner = np.where(z > top, hi, lo)  # the corner that favours z most
    further = ((z - top) * (z + top - 2 * corner)).sum(1)
    return (further < 0) | ((further == 0) & (entry <= chosen))


def assign(tree: Tree, book: np.ndarray, sums: np.ndarray | None = None, counts: np.ndarray | None = None, codes: np.ndarray | None = None) -> None:
    """Give every point of a tree its nearest entry (ties: the lower), whole subtrees where the boxes allow.

    Adds to `sums` and `counts` by entry, or writes `codes` in the order of the tree's points.
    """

    def give(nodes: np.ndarray, entries: np.ndarray) -> None:
        if sums is not None:
            np.add.at(sums, entries, tree["sum"][nodes])
            np.add.at(counts, entries, (tree["stop"] - tree["start"])[nodes])
        else:
            n = (tree["stop"] - tree["start"])[nodes]
            codes[_spread(tree["start"][nodes], n)] = np.repeat(entries, n)

    waiting = [(np.zeros(len(book), np.int64), np.arange(len(book)))]
    while waiting:
        owner, entry = waiting.pop()
        stay = _survivors(tree, owner, entry, book)
        owner, entry = owner[stay], entry[stay]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        many = np.diff(np.append(first, len(owner)))
        alone = first[many == 1]
        give(owner[alone], entry[alone])
        rest = np.repeat(many > 1, many)
        owner, entry = owner[rest], entry[rest]
        leaf = tree["child"][owner] == 0
        if leaf.any():
            nodes, z = owner[leaf], entry[leaf]
            starts, n = tree["start"][nodes], (tree["stop"] - tree["start"])[nodes]
            at, of = _spread(starts, n), np.repeat(z, n)
            turn = np.lexsort((of, at))
            at, of = at[turn], of[turn]
            best = _nearest(at, of, ((tree["points"][at] - book[of]) ** 2).sum(1))
            if sums is not None:
                np.add.at(sums, of[best], tree["points"][at[best]])
                np.add.at(counts, of[best], 1)
            else:
                codes[at[best]] = of[best]
        owner, entry = owner[~leaf], entry[~leaf]
        # both children take the entries that stayed, a bounded number of pairs at a time
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        while len(cuts):
            upto = max(int(np.searchsorted(cuts, cuts[0] + PAIRS)), 1)
            to = cuts[upto] if upto < len(cuts) else len(owner)
            o, e = tree["child"][owner[cuts[0] : to]], entry[cuts[0] : to]
            waiting.append((np.concatenate((o, o + 1)), np.concatenate((e, e))))
            turn = np.argsort(waiting[-1][0], kind="stable")
            waiting[-1] = waiting[-1][0][turn], waiting[-1][1][turn]
            cuts = cuts[upto:]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at `starts`."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def _packed(tree: Tree) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _unpacked(raw: bytes) -> Tree:
    return dict(np.load(io.BytesIO(raw)))


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, label, whole): rows whose vector has finite components only, as whole numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: v.cast("double") * SCALE)
    kept = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", "label", scaled.alias("scaled"))


def _whole(scaled: Column, width: int) -> Column:
    most = largest_component(width)
    return F.transform(scaled, lambda v: F.floor(F.greatest(F.least(v, F.lit(float(most))), F.lit(float(-most)))).cast("long"))


def _forest(rows: DataFrame, width: int) -> DataFrame:
    """A row for each block of vectors: ids and labels in order, and the trees of its parts."""
    ids = T.StructType([rows.schema["vec_id"], rows.schema["label"]])
    out = T.StructType([T.StructField("rows", T.ArrayType(ids))] + [T.StructField(f"tree{k}", T.BinaryType()) for k in range(PARTS)])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        named = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("vec_id", "label")], ["vec_id", "label"])
        points = table.column("whole").combine_chunks().flatten().to_numpy().reshape(len(table), width * PARTS)
        trees = [_packed(build_tree(np.ascontiguousarray(points[:, k * width : (k + 1) * width]))) for k in range(PARTS)]
        lists = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), named)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([t], pa.binary()) for t in trees)], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(run, out)


def _round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: means of what each entry was given, rounded down; unused entries stay."""
    width = books[0].shape[1]
    names = [f"s{i}" for i in range(width)]
    columns = ["part", "entry", "n", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for k, book in enumerate(books):
                for raw in batch.column(f"tree{k}"):
                    assign(_unpacked(raw.as_py()), book, sums[k], counts[k])
        for k in range(PARTS):
            used = np.flatnonzero(counts[k])
            if len(used):
                numbers = [np.full(len(used), k), used, counts[k][used], *sums[k][used].T]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in numbers], names=columns)

    sent = forest.select(*[f"tree{k}" for k in range(PARTS)]).mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))
    total = sent.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names]])
    after = [b.copy() for b in books]
    for row in total.collect():  # at most 4 x 256 rows
        after[row.part][row.entry] = [int(row[c]) // int(row.n) for c in names]
    return after


def _coded(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    fields = forest.schema["rows"].dataType.elementType.fields
    out = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                named = batch.column("rows").slice(i, 1).flatten()
                found = np.zeros((len(named), PARTS), np.uint8)
                error = np.zeros(len(named), np.int64)
                for k, book in enumerate(books):
                    tree = _unpacked(batch.column(f"tree{k}")[i].as_py())
                    codes = np.zeros(len(named), np.int64)
                    assign(tree, book, codes=codes)
                    found[tree["order"], k] = codes
                    error[tree["order"]] += ((tree["points"] - book[codes]) ** 2).sum(1)
                text = pa.array([bytes(x).hex() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([named.field(0), named.field(1), text, pa.array(error)], names=out.names)

    return forest.mapInArrow(run, out)


def vector_codes(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (entries x width, one a part).

    Rows with a null vector, or null or non-finite components, are dropped, as
    are rows whose vector is not as long as that of the smallest kept vec_id, or
    whose length four doesn't divide.  Codebooks start as the parts of the 256
    smallest vec_ids (null last; equal ids by their vectors), fewer where there
    are fewer rows.  Repeated rows count each.  Components beyond
    `largest_component` (about 2^28 for parts of 16) count as that.
    """
    kept = _kept(vectors, vector).where(F.size("scaled") % PARTS == 0)
    ascending = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("scaled")]
    first = kept.select(F.size("scaled").alias("n"), "vec_id", "scaled").orderBy(*ascending).limit(1).collect()
    width = first[0].n // PARTS if first else 0
    rows = kept.where(F.size("scaled") == width * PARTS).withColumn("whole", _whole(F.col("scaled"), width))
    start = [r.whole for r in rows.orderBy(*ascending).limit(ENTRIES).select("whole").collect()]
    whole = np.array(start, np.int64).reshape(len(start), width * PARTS)
    books = [np.ascontiguousarray(whole[:, k * width : (k + 1) * width]) for k in range(PARTS)]
    forest = stored(_forest(rows.select("vec_id", "label", "whole"), width), "forest")
    for _ in range(rounds if first else 0):
        books = _round(forest, books)
    return _coded(forest, books), books


def codes_report(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of every kept row.

    Nulls, ties, odd vectors and repeated rows as in `vector_codes`; null labels
    are equal; an empty table has no rows.
    """
    coded, books = vector_codes(vectors, vector)
    coded = stored(coded, "codes")
    numbers = ",".join(str(x) for b in books for x in b.ravel().tolist())
    by_label = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
