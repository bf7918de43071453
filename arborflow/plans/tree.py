"""Tree state on the driver: at most 2^(depth+1) - 1 nodes, children of i at 2 i + 1 and 2 i + 2."""

from __future__ import annotations

import dataclasses
import heapq
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborflow.operators.histogram import UNIT

RT_EPS = 1e-6


@dataclasses.dataclass
class Node:
    nid: int
    g: int
    h: int
    n: int = 0
    weight: float = 0.0
    gain: float = 0.0
    fid: int = -1
    bid: int = -1
    cut: float = 0.0
    default_right: bool = False
    is_leaf: bool = True
    is_pruned: bool = False
    passes: bool = False  # hands all rows on to the left child


def leaf_weight(g: float, h: float, reg_lambda: float) -> float:
    """-G / (H + lambda), from millionths; 0 where there is nothing to divide by."""
    total = h / UNIT + reg_lambda
    return -(g / UNIT) / total if total else 0.0


class Tree:
    def __init__(self, g: int, h: int, reg_lambda: float, n: int = 0):
        self.reg_lambda = reg_lambda
        self.nodes: dict[int, Node] = {0: Node(0, g, h, n, leaf_weight(g, h, reg_lambda))}

    def level(self, k: int) -> list[Node]:
        return [self.nodes[i] for i in range(2**k - 1, 2 ** (k + 1) - 1) if i in self.nodes and not self.nodes[i].is_pruned]

    def split(self, nid: int, fid: int, bid: int, cut: float, gain: float, default_right: bool, rg: int, rh: int, mg: int = 0, mh: int = 0) -> bool:
        """Split a leaf if the gain exceeds RT_EPS; the children's sums follow from the right one's. Returns whether it did."""
        node = self.nodes[nid]
        if not gain > RT_EPS:
            return False
        if default_right:
            rg, rh = rg + mg, rh + mh
        node.gain, node.fid, node.bid, node.cut, node.default_right, node.is_leaf = gain, fid, bid, cut, default_right, False
        for i, g, h in ((2 * nid + 1, node.g - rg, node.h - rh), (2 * nid + 2, rg, rh)):
            self.nodes[i] = Node(i, g, h, 0, leaf_weight(g, h, self.reg_lambda))
        return True

    def pass_on(self, nid: int, fid: int) -> None:
        """Make a leaf hand all its rows on to its left child, where a predefined structure names a feature that no row here has."""
        node = self.nodes[nid]
        node.fid, node.is_leaf, node.passes = fid, False, True
        self.nodes[2 * nid + 1] = Node(2 * nid + 1, node.g, node.h, node.n, node.weight)
        self.nodes[2 * nid + 2] = Node(2 * nid + 2, 0, 0, 0, leaf_weight(0, 0, self.reg_lambda))

    def prune(self, gamma: float) -> int:
        """Bottom-up: a split of two leaves whose gain is under gamma becomes a leaf. Returns how many did."""
        count = 0
        for nid in sorted(self.nodes, reverse=True):
            node = self.nodes[nid]
            if not node.is_leaf and not node.is_pruned:
                kids = [self.nodes[2 * nid + 1], self.nodes[2 * nid + 2]]
                if all(k.is_leaf for k in kids) and node.gain < gamma:
                    node.is_leaf, node.passes = True, False
                    for k in kids:
                        k.is_pruned = True
                    count += 1
        return count

    def compact_ids(self) -> dict[int, int]:
        """Consecutive ids of the nodes that are left, in order of nid."""
        return {nid: k for k, nid in enumerate(sorted(i for i, x in self.nodes.items() if not x.is_pruned))}

    def leaves(self) -> list[Node]:
        return [x for x in self.nodes.values() if x.is_leaf and not x.is_pruned]

    def fold(self, go_right: Callable[[Node], str], leaf: Callable[[Node], str], nid: int = 0) -> str:
        """SQL of one nested CASE: go_right(node) conditions, leaf(node) values. Text, for a call a node would cost more than a level's job on small tables."""
        node = self.nodes[nid]
        if node.is_leaf:
            return leaf(node)
        if node.passes:
            return self.fold(go_right, leaf, 2 * nid + 1)
        return f"CASE WHEN {go_right(node)} THEN {self.fold(go_right, leaf, 2 * nid + 2)} ELSE {self.fold(go_right, leaf, 2 * nid + 1)} END"

    def dump(self, depth: int | None = None) -> str:
        """Preorder text with 1-based features."""
        out: list[str] = []

        def walk(nid: int, level: int) -> None:
            node, pad = self.nodes[nid], "\t" * level
            if node.is_leaf or level == depth:
                out.append(f"{pad}{nid}:leaf={node.weight:.6g}")
            else:
                left, right = 2 * nid + 1, 2 * nid + 2
                if node.passes:
                    out.append(f"{pad}{nid}:[f{node.fid + 1} absent] all={left}")
                    walk(left, level + 1)
                    return
                out.append(f"{pad}{nid}:[f{node.fid + 1}<{node.cut:.6g}] yes={left},no={right},missing={right if node.default_right else left}")
                walk(left, level + 1)
                walk(right, level + 1)

        walk(0, 0)
        return "\n".join(out) + "\n"


def number(x: float) -> str:
    """A DOUBLE of SQL, exactly."""
    return f"({x!r}D)" if math.isfinite(x) else f"double('{x}')"


def by_bin(bins: str = "bins") -> Callable[[Node], str]:
    """Training's condition: right iff missing and the default is right, or bin <= the split's."""
    return lambda x: f"coalesce({bins}[{x.fid}] <= {x.bid}, {x.default_right})"


def by_value(values: str = "x", place: dict[int, int] | None = None) -> Callable[[Node], str]:
    """Scoring's condition: right iff value - cut >= -RT_EPS; missing goes to the default side. place: where a feature is in `values`, if not at its number."""
    return lambda x: f"coalesce({values}[{place[x.fid] if place else x.fid}] - {number(x.cut)} >= {number(-RT_EPS)}, {x.default_right})"


def node_id(tree: Tree, cond: Callable[[Node], str]) -> Column:
    return F.expr(tree.fold(cond, lambda x: str(x.nid)))


def by_tree(tid: str, n: int, value: Callable[[int], str]) -> str:
    """SQL of value(t) of the tree t that tid names, found by halving."""

    def pick(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return value(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {tid} < {mid} THEN {pick(lo, mid)} ELSE {pick(mid, hi)} END"

    return pick(0, n)


#: Leaves beyond which generated code would be too long.
CASE_LEAVES = 400


def node_number(trees: list[Tree], tid: str, stride: int, bins: str = "bins") -> Column:
    """tid x stride + the node that a row of bins is in: one nested CASE, or for many leaves a walk over arrays of the nodes."""
    if sum(len(t.leaves()) for t in trees) <= CASE_LEAVES:
        return F.expr(by_tree(tid, len(trees), lambda t: trees[t].fold(by_bin(bins), lambda x: str(t * stride + x.nid))))
    fid, bid, right = [-1] * (len(trees) * stride), [0] * (len(trees) * stride), [False] * (len(trees) * stride)
    for t, tree in enumerate(trees):
        for x in tree.nodes.values():
            if not x.is_leaf and not x.is_pruned:
                at = t * stride + x.nid
                fid[at], bid[at], right[at] = max(0, x.fid), -1 if x.passes else x.bid, x.default_right and not x.passes
    fids, bids, rights = F.lit(fid), F.lit(bid), F.lit(right)
    base = (F.col(tid) * stride).cast("int")

    def step(at: Column, _: Column) -> Column:
        go = F.when(F.coalesce(F.get(F.col(bins), fids[at]) <= bids[at], rights[at]), 2).otherwise(1)
        return F.when(fids[at] < 0, at).otherwise(2 * at - base + go).cast("int")

    levels = max(x.nid + 1 for t in trees for x in t.nodes.values()).bit_length() - 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, levels))), base, step)


def weight_sql(tree: Tree, cond: Callable[[Node], str], rate: float) -> str:
    return tree.fold(cond, lambda x: number(float(rate * x.weight)))


def merge_hybrid(trees: list[Tree], totals: list[int], depth: int) -> list[tuple[int, int]]:
    """(heap place, feature) of a global tree whose places are filled from parties' splits in order of gain, weighed by the parties' rows.

    A party's split enters the queue when its parent there was taken.
    """
    everyone, queue = sum(totals), []
    for p, (tree, n) in enumerate(zip(trees, totals)):
        if not tree.nodes[0].is_leaf:
            heapq.heappush(queue, (-tree.nodes[0].gain * everyone / max(1, n), p, 0))
    out: list[tuple[int, int]] = []
    while queue and len(out) < 2**depth - 1:
        _, p, nid = heapq.heappop(queue)
        out.append((len(out), trees[p].nodes[nid].fid))
        for kid in (2 * nid + 1, 2 * nid + 2):
            node = trees[p].nodes.get(kid)
            if node and not node.is_leaf and not node.is_pruned:
                heapq.heappush(queue, (-node.gain * everyone / max(1, totals[p]), p, kid))
    return out
