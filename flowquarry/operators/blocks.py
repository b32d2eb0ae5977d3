"""Neighbours within blocks of points: cuts of space, and the exact comparison of two blocks, in numpy."""

from __future__ import annotations

import numpy as np


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes, widest first, as columns. A rotation keeps distances, so any one is right."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    return np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, ::-1]


def cut_tree(sample: np.ndarray, most: float) -> list[tuple]:
    """Cuts (axis, value, left, right) in the middle of the widest axis, until a part has at most ``most`` points. A leaf is (-1, region, 0, 0)."""
    nodes, pending, regions = [(-1, 0, 0, 0)], [(0, sample)], 0
    while pending:
        number, part = pending.pop()
        if len(part) > most:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value = np.sort(part[:, axis])[(len(part) - 1) // 2]
            below = part[:, axis] <= value
            if below.all():  # more than half of the part is at its upper edge
                below = part[:, axis] < value
                value = part[below, axis].max() if below.any() else value
            if below.any():
                left = len(nodes)
                nodes += [(-1, 0, 0, 0)] * 2
                nodes[number] = (axis, float(value), left, left + 1)
                pending += [(left, part[below]), (left + 1, part[~below])]
                continue
        nodes[number] = (-1, regions, 0, 0)
        regions += 1
    return nodes


def region_of(nodes: list[tuple], at: np.ndarray) -> np.ndarray:
    tree = np.array(nodes, dtype=float)
    where, everyone = np.zeros(len(at), dtype=int), np.arange(len(at))
    while True:
        axis = tree[where, 0].astype(int)
        if (axis < 0).all():
            return tree[where, 1].astype(np.int32)
        step = np.where(at[everyone, np.maximum(axis, 0)] <= tree[where, 1], tree[where, 2], tree[where, 3]).astype(int)
        where = np.where(axis < 0, where, step)


def box_gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Squared distance of boxes (or points, when low is high)."""
    apart = np.maximum(0.0, np.maximum(low2 - high, low - high2))
    return (apart * apart).sum(axis=-1)


def reach(eps: float) -> float:
    """Squared distance that boxes of rotated, so rounded, coordinates may have and still hold points within ``eps``."""
    return eps * eps * (1 + 1e-6)


def _leaves(at: np.ndarray, some: np.ndarray, most: int) -> list[np.ndarray]:
    done, pending = [], [some]
    while pending:
        part = pending.pop()
        if len(part) <= most:
            done.append(part)
            continue
        inside = at[part]
        axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        order = np.argpartition(inside[:, axis], len(part) // 2)
        pending += [part[order[len(part) // 2:]], part[order[:len(part) // 2]]]
    return [p for p in done if len(p)]


class Groups:
    """Union of numbered points."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while not np.array_equal(up := self.parent[found], found):
            found = up
        self.parent[of] = found
        return found

    def join(self, pairs: np.ndarray) -> None:
        for i, j in pairs.T.tolist():
            i, j = self._root(i), self._root(j)
            self.parent[max(i, j)] = min(i, j)

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def _near(p: np.ndarray, q: np.ndarray, limit: float) -> np.ndarray | None:
    """Pairs of rows within the squared distance; None if there are none. Products decide, and what they leave within their rounding is added up."""
    centre = p.mean(axis=0)
    a, b = p - centre, q - centre
    left, right = (a * a).sum(axis=1), (b * b).sum(axis=1)
    apart = a @ (-2.0 * b.T)
    apart += left[:, None]
    apart += right
    slack = 1e-9 * (1.0 + left.max() + right.max())
    near = apart <= limit + slack
    if not near.any():
        return None
    i, j = np.nonzero(near & (apart >= limit - slack))
    total = np.zeros(len(i))
    for c in range(p.shape[1]):
        step = p[i, c] - q[j, c]
        total += step * step
    near[i, j] = total <= limit
    return near


def compare(x: np.ndarray, at: np.ndarray, weight: np.ndarray, sides: list[np.ndarray], eps: float, least: int, most: int) -> tuple:
    """Neighbours of points within one side, or across two: (links, pairs, seen).

    ``x`` and ``at`` are coordinates, plain and rotated; ``sides`` are positions in them. Points are cut into leaves of at most
    ``most``, and leaves whose boxes are further apart than ``eps`` are not compared. A point is sure once the weight ``seen``
    around it, its own included, has reached ``least``. Near pairs of sure points only matter by what they connect: each sure
    point is linked to one of its group, and leaves of one group that are sure as a whole are not compared again. Every
    pair of a point that is not sure is given out, and such a point has fewer than ``least`` of them.
    """
    groups, seen, rest = Groups(len(x)), weight.astype(np.int64), [np.zeros((2, 0), dtype=np.int64)]
    first = _leaves(at, sides[0], most)
    leaves = first if len(sides) == 1 else first + _leaves(at, sides[1], most)
    low, high = np.array([at[p].min(axis=0) for p in leaves]), np.array([at[p].max(axis=0) for p in leaves])
    meet = []
    for i in range(len(first)):
        others = np.arange(i, len(leaves)) if len(sides) == 1 else np.arange(len(first), len(leaves))
        gap = box_gap(low[i], high[i], low[others], high[others])
        meet += [(int(j) != i, float(g), i, int(j)) for g, j in zip(gap, others) if g <= reach(eps)]
    for _, _, i, j in sorted(meet):
        p, q = leaves[i], leaves[j]
        of_p, of_q = groups.roots(p), groups.roots(q)
        if (seen[p] >= least).all() and (seen[q] >= least).all() and (of_p == of_p[0]).all() and (of_q == of_p[0]).all():
            continue
        near = _near(x[p], x[q], eps * eps)
        if near is None:
            continue
        if i == j:
            np.fill_diagonal(near, False)
        seen[p] += near @ weight[q]
        if i != j:
            seen[q] += weight[p] @ near
        sure = np.outer(seen[p] >= least, seen[q] >= least)
        a, b = np.nonzero(near & ~sure if i != j else np.triu(near & ~sure))
        rest.append(np.stack([p[a], q[b]]))
        a, b = np.nonzero(near & sure & (of_p[:, None] != of_q))
        _, one = np.unique(of_p[a] * np.int64(len(x)) + of_q[b], return_index=True)  # one pair joins two groups
        groups.join(np.stack([p[a[one]], q[b[one]]]))
    pairs = np.concatenate(rest, axis=1)
    settled = (seen >= least)[pairs].all(axis=0)
    groups.join(pairs[:, settled])
    everyone = np.arange(len(x))
    roots = groups.roots(everyone)
    links = np.stack([roots, everyone])[:, roots != everyone]
    return links, pairs[:, ~settled], seen
