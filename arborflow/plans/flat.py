"""A forest as flat arrays, walked level by level by many rows at once."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from arborflow.plans.trainer import Forest
from arborflow.plans.tree import RT_EPS

#: Cells of values and of walks that a task holds at once (32 MB each).
CELLS = 1 << 22


@dataclasses.dataclass(frozen=True)
class FlatForest:
    """All nodes of all trees in a row; a leaf is its own child, so rows may walk on past it."""

    roots: np.ndarray  # rounds x classes
    feature: np.ndarray  # place among `used`
    cut: np.ndarray
    right: np.ndarray  # where missing values go
    child: np.ndarray  # left one; the right one is next to it
    leaf: np.ndarray
    weight: np.ndarray
    nid: np.ndarray
    used: np.ndarray
    depth: int

    @classmethod
    def of(cls, forest: Forest) -> FlatForest:
        used = np.array(used_features(forest), np.int64)
        place = {int(f): k for k, f in enumerate(used)}
        nodes: list[tuple] = []
        roots, depth = [], 0
        for tree in (t for trees in forest.trees for t in trees):
            roots.append(len(nodes))
            todo, at = [0], {0: len(nodes)}
            nodes.append(())
            while todo:
                nid = todo.pop()
                x = tree.nodes[nid]
                if x.is_leaf:
                    nodes[at[nid]] = (0, 0.0, False, at[nid], True, x.weight, nid)
                    continue
                depth = max(depth, (nid + 1).bit_length())
                at[2 * nid + 1], at[2 * nid + 2] = len(nodes), len(nodes) + 1
                nodes += [(), ()]
                todo += [2 * nid + 1, 2 * nid + 2]
                nodes[at[nid]] = (0 if x.passes else place[x.fid], np.inf if x.passes else x.cut, x.default_right and not x.passes, at[2 * nid + 1], False, 0.0, nid)
        columns = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0)] * 7
        kinds = (np.int64, float, bool, np.int64, bool, float, np.int64)
        classes = len(forest.trees[0]) if forest.trees else forest.params.classes
        return cls(np.array(roots, np.int64).reshape(-1, classes), *(c.astype(k) for c, k in zip(columns, kinds)), used, depth)

    def goes_right(self, values: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether rows (of values: rows x used) go right at nodes."""
        v = values[row, self.feature[at]] if len(self.used) else np.full(at.shape, np.nan)
        return np.where(np.isnan(v), self.right[at], v - self.cut[at] >= -RT_EPS)

    def walk(self, n: int, goes_right) -> np.ndarray:
        """The leaf's place of n rows in each tree, rows x trees; goes_right(row, at) tells the way."""
        at = np.tile(self.roots.reshape(-1), (n, 1))
        row = np.arange(n)[:, None]
        for _ in range(self.depth):
            at = np.where(self.leaf[at], at, self.child[at] + goes_right(row, at))
        return at

    def margins(self, at: np.ndarray, rate: float) -> np.ndarray:
        """rows x classes, added in order of rounds as the CASE form does."""
        rounds, classes = self.roots.shape
        at, total = at.reshape(-1, rounds, classes), np.zeros((len(at), classes))
        for r in range(rounds):
            total += rate * self.weight[at[:, r]]
        return total

    def blocks(self, batch: pa.RecordBatch, column: str, shift: int = 0) -> Iterator[np.ndarray]:
        """Values of the used features, nan where absent, for a block of rows at a time; of a feature's several entries the last counts. shift: what the column's feature numbers lack."""
        lists = batch.column(column)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        cells = lists.values
        if column == "x":
            index, value = None, cells
        else:
            index, value = cells.field("fid").to_numpy(zero_copy_only=False), cells.field("val")
        value = value.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
        size = max(1, CELLS // max(1, len(self.used), self.roots.size))
        for lo in range(0, batch.num_rows, size):
            hi = min(batch.num_rows, lo + size)
            part = slice(offsets[lo], offsets[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            fid = shift + (np.arange(offsets[lo], offsets[hi]) - offsets[lo:hi][row] if index is None else index[part].astype(np.int64))
            out = np.full((hi - lo, len(self.used)), np.nan)
            place = np.searchsorted(self.used, fid)
            known = np.flatnonzero(place < len(self.used))
            known = known[self.used[place[known]] == fid[known]]
            out[row[known], place[known]] = value[part][known]
            yield out


def used_features(forest: Forest) -> list[int]:
    return sorted({x.fid for trees in forest.trees for t in trees for x in t.nodes.values() if not x.is_leaf and not x.passes})


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column, a 3-dimensional array as lists of lists."""
    out = pa.array(values.reshape(-1), kind)
    for n, m in ((int(np.prod(values.shape[: k + 1])), values.shape[k + 1]) for k in reversed(range(values.ndim - 1))):
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), out)
    return out
