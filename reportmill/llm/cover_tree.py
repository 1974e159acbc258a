"""Cover trees over unit vectors, and the dual traversal that finds all pairs within a distance.

A tree has nested levels whose radii halve: a node's centre is also the centre of one of its children, and children cover their
members within half the radius of their parent's level. Each node keeps its true covering radius, the distance to its farthest
member. The traversal drops a pair of nodes when even their nearest members must be too far apart, and takes all their pairs at once
when even the farthest must be near enough.
"""

from __future__ import annotations

import numpy as np

from reportmill.llm.suffixes import spread

_POINT = 1e-7  # below this radius rounding hides distances, and members count as one place
_CELLS = 1 << 21  # distances that one step of the traversal holds
_ROWS = 128
_NONE = np.zeros(0, np.int64)


class Tree:
    """Nodes as arrays; members of a node are a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        self.order = np.arange(n)
        self.centre, self.begin, self.end, self.radius = [0], [0], [n], [_radius(points, 0, self.order)]
        self.children: list[np.ndarray] = [_NONE]
        open_ = [(0, 1.0)]
        while open_:
            node, scale = open_.pop()
            if self.end[node] - self.begin[node] > 1 and self.radius[node] > _POINT:
                while scale >= self.radius[node]:
                    scale /= 2
                open_.extend((child, scale / 2) for child in self._split(node, scale))
        self.centre, self.begin, self.end, self.radius = map(np.array, (self.centre, self.begin, self.end, self.radius))
        self.split = np.array([len(x) > 0 for x in self.children])
        self.first = np.array([x[0] if len(x) else i for i, x in enumerate(self.children)])
        self.below_it = np.array([max(1, len(x)) for x in self.children])

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children, the node of each); a node without children stands for itself."""
        return spread(self.first[nodes], self.below_it[nodes]), np.repeat(nodes, self.below_it[nodes])

    def _split(self, node: int, scale: float) -> list[int]:
        """Children of a node: greedily, the next member that is not covered becomes a centre. Distances are taken many rows at a time."""
        a, b = self.begin[node], self.end[node]
        members = self.order[a:b]
        left = np.concatenate([[self.centre[node]], members[members != self.centre[node]]])
        made, at, placed = [], a, []
        while len(left):
            rows = _distance(self.points[left[:_ROWS]] @ self.points[left].T)
            alive = np.ones(len(left), bool)
            for row in range(len(rows)):
                if not alive[row]:
                    continue
                near = alive & (rows[row] <= scale)
                near[row] = True
                covered = np.flatnonzero(near)
                alive[covered] = False
                placed.append(left[covered])
                made.append(len(self.centre))
                self.centre.append(int(left[row]))
                self.begin.append(at)
                at += len(covered)
                self.end.append(at)
                self.radius.append(float(rows[row, covered].max()) if len(covered) > 1 else 0.0)
                self.children.append(_NONE)
            left = left[alive]
        self.order[a:b] = np.concatenate(placed)
        self.children[node] = np.array(made)
        return made


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _radius(points: np.ndarray, centre: int, members: np.ndarray) -> float:
    return float(_distance(points[members] @ points[centre]).max()) if len(members) else 0.0


class _Links:
    """Weighted link counts and components of both trees' points; the second tree's points are numbered after the first's."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        for x in a.tolist():
            self.join(x, int(b[0]))
        for x in b.tolist():
            self.join(x, int(a[0]))

    def within(self, a: np.ndarray) -> None:
        self.count[a] += self.weights[a].sum() - self.weights[a]
        for x in a.tolist():
            self.join(x, int(a[0]))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            self.join(x, y)


def threshold_links(vectors: np.ndarray, weights: np.ndarray, least: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of links, least connected position) of each vector, for all pairs with cosine >= ``least``.

    With ``split`` only pairs of one vector before it and one from it on are looked for. Each pair is settled by its own cosine in
    double precision, except where covering radii leave no doubt. ``least`` is above 0.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit, links, reach = vectors / norms[:, None], _Links(weights), float(np.sqrt(2.0 - 2.0 * least))

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= least
        links.pairs(a[near], b[near])

    if split is None:
        left = right = Tree(unit)
        shift, stack = 0, [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    else:
        left, right, shift, stack = Tree(unit[:split]), Tree(unit[split:]), split, [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        if not split or split == len(vectors):
            stack = []

    def members(tree: Tree, node: int, by: int) -> np.ndarray:
        return tree.order[tree.begin[node] : tree.end[node]] + by

    def open_pairs(x: np.ndarray, y: np.ndarray) -> None:
        """Settles pairs of nodes without children; the others go on, those of one node together, so that a step compares many."""
        ends = ~left.split[x] & ~right.split[y]
        for p, q in zip(x[ends].tolist(), y[ends].tolist(), strict=True):
            # Single vectors, or vectors at one place.
            a, b = members(left, p, 0), members(right, q, shift)
            step = max(1, _CELLS // (len(b) * 64))
            for i in range(0, len(a), step):
                one, two = np.repeat(a[i : i + step], len(b)), np.tile(b, len(a[i : i + step]))
                settle(*((one[one < two], two[one < two]) if split is None and p == q else (one, two)))
        x, y = x[~ends], y[~ends]
        by_left = len(np.unique(x)) <= len(np.unique(y))
        held, others = (x, y) if by_left else (y, x)
        order = np.argsort(held, kind="stable")
        nodes, first = np.unique(held[order], return_index=True)
        for node, some in zip(nodes, np.split(others[order], first[1:]), strict=False):
            stack.append((np.array([node]), some) if by_left else (some, np.array([node])))

    while stack:
        a, b = stack.pop()
        mine, of_mine = left.below(a)
        theirs, of_theirs = right.below(b)
        step = max(1, _CELLS // len(theirs))
        for i in range(0, len(mine), step):
            rows, of_rows = mine[i : i + step], of_mine[i : i + step]
            apart = _distance(left.points[left.centre[rows]] @ right.points[right.centre[theirs]].T)
            both = left.radius[rows][:, None] + right.radius[theirs][None, :]
            open_ = apart <= both + reach + _POINT
            if split is None:
                # Of a node with itself each pair of children counts once.
                open_ &= (of_rows[:, None] != of_theirs[None, :]) | (rows[:, None] <= theirs[None, :])
            x, y = np.nonzero(open_)
            sure = apart[x, y] + both[x, y] < reach - _POINT
            x, y = rows[x], theirs[y]
            single = (left.end[x] - left.begin[x] == 1) & (right.end[y] - right.begin[y] == 1)
            twins = (x == y) if split is None else np.zeros(len(x), bool)
            alone = single & ~twins
            settle(left.order[left.begin[x[alone]]], right.order[right.begin[y[alone]]] + shift)
            dense = twins & ~single & (2 * left.radius[x] < reach - _POINT)
            for p in x[dense].tolist():
                links.within(members(left, p, 0))
            whole = sure & ~twins & ~single
            for p, q in zip(x[whole].tolist(), y[whole].tolist(), strict=True):
                links.all_of(members(left, p, 0), members(right, q, shift))
            left_open = ~single & ~dense & ~whole
            open_pairs(x[left_open], y[left_open])
    return links.count, np.array([links.find(i) for i in range(len(vectors))], np.int64)
