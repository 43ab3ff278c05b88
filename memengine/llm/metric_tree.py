"""Metric trees of a block of points by an anchors hierarchy, and their assignment to nearest entries.

A tree is flat arrays: the points in leaf order, and per node a ball (centre and
radius), the slice of its points, their sum, and two children.  About ``sqrt(n)``
anchors are found first; from there the tree grows both ways, anchors are joined
in pairs up to the root and divided further down to the leaves.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass

import numpy as np

LEAF = 64


@dataclass
class Tree:
    order: np.ndarray  # place in the block of each point, in leaf order
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    children: np.ndarray  # two per node, -1 for none; node 0 is the root

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as arrays:
            return Tree(**dict(arrays))


class _Node:
    __slots__ = ("ids", "centre", "radius", "total", "children")

    def __init__(self, points: np.ndarray, ids: np.ndarray, children: tuple = ()):
        self.ids, self.children = ids, children
        own = points[ids]
        self.total = own.sum(axis=0)
        self.centre = self.total / len(ids)
        self.radius = math.sqrt(max(0.0, _squares(own - self.centre).max()))


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows, dtype=np.float64)


def anchors(points: np.ndarray, ids: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Up to ``wanted`` groups of ``ids``, each of the points nearest to its anchor.

    Each new anchor is the point farthest from its own; it takes over what is nearer to it.  An anchor's points are
    kept by falling distance, and only those more than half way to the new one are looked at.
    """
    flat = points[ids].astype(np.float64)
    far = np.sqrt(_squares(flat - flat[0]))
    order = np.argsort(-far, kind="stable")
    pivots, owned, ranges = [flat[0]], [order], [far[order]]
    while len(pivots) < wanted:
        widest = max(range(len(pivots)), key=lambda a: ranges[a][0] if len(ranges[a]) else -1.0)
        if ranges[widest][0] == 0:
            break
        pivot, mine, mine_far = flat[owned[widest][0]], [], []
        for a, other in enumerate(pivots):
            half = math.sqrt(float(((pivot - other) ** 2).sum())) / 2
            reach = int(np.searchsorted(-ranges[a], -half, side="left"))
            if not reach:
                continue
            near = np.sqrt(_squares(flat[owned[a][:reach]] - pivot))
            taken = near < ranges[a][:reach]
            mine.append(owned[a][:reach][taken])
            mine_far.append(near[taken])
            left = np.r_[np.flatnonzero(~taken), np.arange(reach, len(owned[a]))]
            owned[a], ranges[a] = owned[a][left], ranges[a][left]
        ids_, far_ = np.concatenate(mine), np.concatenate(mine_far)
        order = np.argsort(-far_, kind="stable")
        pivots.append(pivot)
        owned.append(ids_[order])
        ranges.append(far_[order])
    return [ids[o] for o in owned if len(o)]


def _grown(points: np.ndarray, ids: np.ndarray, leaf: int) -> _Node:
    if len(ids) <= leaf or (points[ids] == points[ids[0]]).all():
        return _Node(points, ids)
    groups = anchors(points, ids, max(2, math.isqrt(len(ids))))
    nodes: list[_Node | None] = [_grown(points, group, leaf) for group in groups]
    # joined in pairs, the smallest common ball first; a pair's ball is bounded from the two it joins
    width = lambda a, b: (math.sqrt(float(((a.centre - b.centre) ** 2).sum())) + a.radius + b.radius) / 2
    pairs = [(max(width(nodes[i], nodes[j]), nodes[i].radius, nodes[j].radius), i, j) for i in range(len(nodes)) for j in range(i)]
    heapq.heapify(pairs)
    left = len(nodes)
    while left > 1:
        _, i, j = heapq.heappop(pairs)
        if nodes[i] is None or nodes[j] is None:
            continue
        both = _Node(points, np.r_[nodes[i].ids, nodes[j].ids], (nodes[i], nodes[j]))
        nodes[i] = nodes[j] = None
        for k, other in enumerate(nodes):
            if other is not None:
                heapq.heappush(pairs, (max(width(both, other), both.radius, other.radius), len(nodes), k))
        nodes.append(both)
        left -= 1
    return next(node for node in nodes if node is not None)


def tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of ``points``, whole numbers; at least one row."""
    root = _grown(points, np.arange(len(points)), leaf)
    nodes, children, starts, order, stack = [], [], [], [], [(root, -1, 0)]
    at = 0
    while stack:  # depth first, so that a node's points are one slice
        node, parent, side = stack.pop()
        number = len(nodes)
        if parent >= 0:
            children[parent][side] = number
        nodes.append(node)
        children.append([-1, -1])
        starts.append(at)
        if node.children:
            stack += [(node.children[1], number, 1), (node.children[0], number, 0)]
        else:
            order.append(node.ids)
            at += len(node.ids)
    placed, starts = np.concatenate(order), np.array(starts)
    return Tree(
        placed, points[placed], starts, starts + np.array([len(n.ids) for n in nodes]), np.array([n.centre for n in nodes]),
        np.array([n.radius for n in nodes]), np.array([n.total for n in nodes]), np.array(children),
    )


def _exact(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exactly."""
    points, entries = points.astype(np.int64), entries.astype(np.int64)
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most**2 < 2**53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (_squares(p)[:, None] - 2 * (p @ e.T) + _squares(e)[None, :]).astype(np.int64)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def owners(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each point in leaf order, points per entry, sums per entry, points looked at one by one).

    A ball inherits the entries its parent could not rule out.  One is ruled out if all of the ball is
    strictly nearer to the entry nearest to its centre; a ball with a single entry left is owned by it,
    and its cached sum counts.  In leaves the entries left are compared exactly, ties go to the lower one.
    """
    k = len(entries)
    floats = entries.astype(np.float64)
    between = np.sqrt(np.maximum(((floats[:, None, :] - floats[None, :, :]) ** 2).sum(axis=2), 0))
    first = np.array([not any((entries[i] == entries[j]).all() for j in range(i)) for i in range(k)])  # later equal ones own nothing
    out = np.empty(len(t.points), dtype=np.int64)
    counts, sums, singles = np.zeros(k, dtype=np.int64), np.zeros((k, t.points.shape[1]), dtype=np.int64), 0
    at, left = np.zeros(1, dtype=np.int64), first[None, :].copy()
    while len(at):
        away = ((t.centre[at][:, None, :] - floats[None, :, :]) ** 2).sum(axis=2)
        nearest = np.where(left, away, np.inf).argmin(axis=1)
        best = away[np.arange(len(at)), nearest][:, None]
        reach = 2 * t.radius[at][:, None] * between[nearest]
        left &= best - away + reach >= -1e-7 * (1 + best + away + reach)
        owned = left.sum(axis=1) == 1
        for node, entry in zip(at[owned], nearest[owned]):
            out[t.start[node] : t.end[node]] = entry
        np.add.at(counts, nearest[owned], (t.end - t.start)[at[owned]])
        np.add.at(sums, nearest[owned], t.total[at[owned]])
        at, left = at[~owned], left[~owned]
        leaf = t.children[at, 0] < 0
        if leaf.any():
            sizes = (t.end - t.start)[at[leaf]]
            rows = np.concatenate([np.arange(t.start[n], t.end[n]) for n in at[leaf]])
            far = _exact(t.points[rows], entries)
            far[~np.repeat(left[leaf], sizes, axis=0)] = np.iinfo(np.int64).max
            out[rows] = chosen = far.argmin(axis=1)
            counts += np.bincount(chosen, minlength=k)
            np.add.at(sums, chosen, t.points[rows].astype(np.int64))
            singles += len(rows)
        at, left = t.children[at[~leaf]].ravel(), np.repeat(left[~leaf], 2, axis=0)
    return out, counts, sums, singles
