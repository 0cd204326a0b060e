"""Nearest points, exactly: a tree of boxes over a bounded number of points, searched for many rows at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Points of a leaf, rows searched together, rows of a leaf's table of distances.
LEAF, TOGETHER, ROWS = 64, 65_536, 4_096
_trees: dict[str, tuple] = {}


def grow(points: np.ndarray) -> tuple:
    """(low corner, high corner, points of a leaf, children), split at the median of the widest side."""
    lo, hi = points.min(0), points.max(0)
    if len(points) <= LEAF:
        return lo, hi, points, ()
    side, half = int(np.argmax(hi - lo)), len(points) // 2
    order = np.argpartition(points[:, side], half)
    return lo, hi, None, (grow(points[order[:half]]), grow(points[order[half:]]))


def squares(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(points)))
    for k in range(q.shape[1]):
        out += (points[None, :, k] - q[:, None, k]) ** 2
    return out


def beside(node: tuple, q: np.ndarray) -> np.ndarray:
    """Squared distances to the node's box: no point in it is nearer."""
    return (np.maximum(np.maximum(node[0] - q, q - node[1]), 0.0) ** 2).sum(1)


def search(node: tuple, q: np.ndarray, rows: np.ndarray, best: np.ndarray) -> None:
    """Lowers best[rows] to the squared distances of q[rows] to the node's points."""
    if not len(rows):
        return
    if node[2] is not None:
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            best[some] = np.minimum(best[some], squares(q[some], node[2]).min(1))
        return
    a, b = node[3]
    to_a, to_b = beside(a, q[rows]), beside(b, q[rows])
    first = to_a <= to_b
    for here, near, far, gap in ((first, a, b, to_b), (~first, b, a, to_a)):
        some, gap = rows[here], gap[here]
        # a margin for what the two sums round differently
        search(near, q, some[(to_a if near is a else to_b)[here] <= best[some] * (1 + 1e-12)], best)
        search(far, q, some[gap <= best[some] * (1 + 1e-12)], best)


def closer(shared: object, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of (key, columns..., distance) with the distance lowered to that of the nearest of the broadcast points."""
    token = uuid.uuid4().hex

    def lowered(t: pa.Table, tree: tuple | None) -> Iterator[pa.RecordBatch]:
        q = np.column_stack([t.column(c).to_numpy() for c in columns])
        old = t.column("distance").to_numpy().astype(float)
        fine = ~np.isnan(q).any(1)
        best = np.full(len(q), np.inf)
        if tree is not None:
            search(tree, q, np.flatnonzero(fine), best)
        new = np.where(fine & (tree is not None), np.sqrt(best), np.nan)
        at = t.schema.get_field_index("distance")
        yield from t.set_column(at, t.schema.field(at), pa.array(np.fmin(old, new))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _trees:
            points = shared.value[~np.isnan(shared.value).any(1)]
            _trees.clear()
            _trees[token] = (grow(points) if len(points) else None,)
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TOGETHER:
                yield from lowered(pa.Table.from_batches(held), _trees[token][0])
                held = []
        if held:
            yield from lowered(pa.Table.from_batches(held), _trees[token][0])

    return run
