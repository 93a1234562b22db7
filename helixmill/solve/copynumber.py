"""Copy numbers of a breakpoint graph's edges by maximum likelihood under node balance; numpy only.

Minimise sum(r / x + a x - l ln x) over x > 0 subject to A x = 0, where for sequence edges a = cov * len / 2, l = -1/2,
r = nc^2 / (2 cov len), and for breakpoint edges a = cov, l = reads, r = 0. Copy numbers are 2 x, x for a self-loop.
Newton steps from x = 1 that reduce the residual of the optimality conditions, the curvature kept positive.
"""

from __future__ import annotations

import numpy as np

FLOOR = 1e-9


def solve(a: np.ndarray, l: np.ndarray, r: np.ndarray, balance: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> np.ndarray:  # noqa: E741
    x, dual = np.ones(len(a)), np.zeros(len(balance))

    def residual(x: np.ndarray, dual: np.ndarray) -> np.ndarray:
        return np.concatenate([a - l / x - r / x**2 + balance.T @ dual, balance @ x])

    for _ in range(steps):
        now = residual(x, dual)
        if np.abs(now).max() < tolerance * (1 + np.abs(a).max()):
            break
        curve = np.maximum(l / x**2 + 2 * r / x**3, 1e-8 * (1 + a) / x)
        g = now[: len(a)]
        schur = (balance / curve) @ balance.T
        step_dual = np.linalg.lstsq(schur, now[len(a) :] - (balance / curve) @ g, rcond=None)[0] if len(balance) else dual
        step = -(g + balance.T @ step_dual) / curve
        shrinks = step < 0
        t = min(1.0, 0.99 * float((-x[shrinks] / step[shrinks]).min())) if shrinks.any() else 1.0
        size = np.linalg.norm(now)
        while t > 1e-10 and np.linalg.norm(residual(np.maximum(x + t * step, FLOOR), dual + t * step_dual)) > (1 - 1e-4 * t) * size:
            t /= 2
        x, dual = np.maximum(x + t * step, FLOOR), dual + t * step_dual
    return x


def balance_rows(sequence: list[tuple], concordant: list[tuple], discordant: list[tuple], ends: set) -> np.ndarray:
    """Rows of A: at each node that is no end node, its sequence edge minus its breakpoint edges. Edges are pairs of nodes;
    a self-loop counts once."""
    edges = [*sequence, *concordant, *discordant]
    nodes = sorted({n for e in edges for n in e} - ends)
    row = {n: k for k, n in enumerate(nodes)}
    out = np.zeros((len(nodes), len(edges)))
    for k, e in enumerate(edges):
        for n in set(e):
            if n in row:
                out[row[n], k] = 1 if k < len(sequence) else -1
    return out


def fit(sequence: list[tuple], lengths: list[int], bases: list[float], concordant: list[tuple], c_reads: list[int], discordant: list[tuple], d_reads: list[int], ends: set, cov: float) -> np.ndarray:
    """Copy numbers of sequence, concordant and discordant edges, in that order."""
    size, nc = np.asarray(lengths, float), np.asarray(bases, float)
    if not concordant and not discordant:
        return nc * 2 / (cov * size)
    n = len(concordant) + len(discordant)
    a = np.concatenate([0.5 * cov * size, np.full(n, cov)])
    l = np.concatenate([np.full(len(size), -0.5), np.asarray([*c_reads, *d_reads], float)])  # noqa: E741
    r = np.concatenate([0.5 * nc**2 / (cov * size), np.zeros(n)])
    x = solve(a, l, r, balance_rows(sequence, concordant, discordant, ends))
    loops = np.array([False] * (len(sequence) + len(concordant)) + [e[0] == e[1] for e in discordant])
    return np.where(loops, x, 2 * x)
