"""Upper bounds of how often a walk may pass each discordant edge, from read counts.

Counts are sorted and cut into the fewest contiguous clusters that are valid; among those cuts the best sum of cluster
scores and of log2 gaps between clusters wins, the earliest cut on ties. The sum is additive, so a dynamic programme over
suffixes replaces trying all cuts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

LEAST = -10.0


def cluster_score(counts: list[float], most: int) -> tuple[int, float] | None:
    """(size of the base part, score) of sorted counts as one cluster, or None if they can't be one.

    The base part has multiplicity 1; the others get the nearest multiple of its mean. The score is the sum of log2 gaps
    between multiplicities less their deviations from whole multiples.
    """
    if len(counts) == 1 or counts[-1] < 2 * counts[0]:
        return len(counts), 0.0
    base = next(k for k, c in enumerate(counts) if c >= 2 * counts[0])
    if counts[-1] / (sum(counts[:base]) / base) >= most + 0.5:
        return None
    best = None
    for size in range(base, 0, -1):
        mean = sum(counts[:size]) / size
        if counts[size] / mean < 1.5:
            continue
        groups: dict[int, list[int]] = {}
        m = 2
        for k in range(size, len(counts)):
            while counts[k] / mean >= m + 0.5:
                m += 1
            groups.setdefault(m, []).append(k)
        if m > most or any(len(g) > size for g in groups.values()):
            continue
        gaps = sum(math.log2(counts[g[0]]) - math.log2(counts[g[0] - 1]) for g in groups.values())
        off = sum(abs(m - sum(counts[k] for k in g) / len(g) / mean) for m, g in groups.items())
        if gaps - off > (best[1] if best else LEAST):
            best = size, gaps - off, off
    return (best[0], best[1]) if best and best[2] < 1.0 else None


def multiplicities(reads: list[int], most: int = 5) -> list[int]:
    if not reads:
        return []
    order = np.argsort(reads, kind="stable")
    counts = [max(float(reads[k]), 1e-9) for k in order]
    n = len(counts)
    if math.log2(counts[-1]) - math.log2(counts[0]) < 1.0:
        return [1] * n

    @lru_cache(maxsize=None)
    def one(i: int, j: int) -> tuple[int, float] | None:
        return cluster_score(counts[i:j], most)

    @lru_cache(maxsize=None)
    def best(i: int, k: int) -> tuple[float, tuple[int, ...]] | None:
        """Best score of cutting counts[i:] into k clusters, and their ends."""
        if k == 1:
            s = one(i, n)
            return None if s is None else (s[1], (n,))
        found = None
        for j in range(i + 1, n - k + 2):
            head = one(i, j)
            tail = best(j, k - 1) if head else None
            if tail:
                score = head[1] + math.log2(counts[j]) - math.log2(counts[j - 1]) + tail[0]
                if found is None or score > found[0]:
                    found = score, (j, *tail[1])
        return found

    cuts = next(b[1] for k in range(1, n + 1) if (b := best(0, k)))
    out, i = [0] * n, 0
    for j in cuts:
        size = one(i, j)[0]
        mean, m = sum(counts[i : i + size]) / size, 2
        for k in range(i, j):
            if k < i + size:
                out[order[k]] = 1
            else:
                while counts[k] / mean >= m + 0.5:
                    m += 1
                out[order[k]] = m
        i = j
    return out
