"""Comparison of cycles: weighted longest common subsequence, minimum-weight matching, order of triplets."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def common_subsequence(a: list, b: list, size: dict) -> float:
    """Largest total size of a common subsequence; items are (segment, strand), sizes by segment. Equal items always pair."""
    row = [0.0] * (len(b) + 1)
    for x in a:
        diagonal = 0.0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = diagonal + size[x[0]] if x == y else max(row[j], row[j - 1])
            diagonal = kept
    return row[-1]


def cycle_overlap(true: list, found: list, size: dict) -> float:
    """The best over all rotations of the found cycle and of its reverse on the other strand."""
    other = [(s, "+" if d == "-" else "-") for s, d in reversed(found)]
    return max((common_subsequence(true, c[k:] + c[:k], size) for c in (found, other) for k in range(len(c))), default=0.0)


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a minimum-cost matching of all rows (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[owner[at] - 1, open_ - 1] - u[owner[at]] - v[open_]
            better = reduced < least[open_]
            least[open_[better]], way[open_[better]] = reduced[better], at
            to = open_[least[open_].argmin()]
            gap = least[to]
            u[owner[done]] += gap
            v[done] -= gap
            least[~done] -= gap
            at = to
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [-1] * n
    for c in range(1, m + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def match_segments(true: list[tuple], found: list[tuple]) -> list[int | None]:
    """The true segment (chrom, start, end, strand) each found one stands for; other chromosomes cost 3e9."""
    if not true or not found:
        return [None] * len(found)
    cost = np.array([[abs(t[1] - f[1]) + abs(t[2] - f[2]) if t[0] == f[0] else 3e9 for t in true] for f in found], float)
    if len(found) <= len(true):
        return list(assignment(cost))
    back = assignment(cost.T)
    out: list[int | None] = [None] * len(found)
    for t, f in enumerate(back):
        out[f] = t
    return out


def triplet_share(true: list[tuple], found: list[tuple]) -> float:
    """Share of triples of distinct true segments whose cyclic order the found cycle keeps, on the better of both strands.

    Both cycles are read from a segment they share; found segments take the place of the true ones they match, with their
    own strand, and on the other strand the found cycle is read backwards.
    """
    place = match_segments(true, found)
    best = 0.0
    labels = list(dict.fromkeys(true))
    triples = list(combinations(labels, 3))
    if not triples:
        return 0.0
    for turn in (False, True):
        steps = [(true[p][:3] + (f[3] if not turn else "+-"["+-".index(f[3]) - 1],)) for f, p in zip(found, place) if p is not None]
        steps = steps[::-1] if turn else steps
        shared = next((t for t in true if t in steps), None)
        if shared is None:
            continue
        a, b = true.index(shared), steps.index(shared)
        t, f = true[a:] + true[:a], steps[b:] + steps[:b]
        first = {x: f.index(x) for x in dict.fromkeys(f)}
        rank = {x: t.index(x) for x in labels}
        good = sum(all(x in first for x in c) and sorted(c, key=rank.get) == sorted(c, key=first.get) for c in triples)
        best = max(best, good / len(triples))
    return best
