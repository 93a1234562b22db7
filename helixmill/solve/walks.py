"""Decomposition of a breakpoint graph into weighted walks, and the rules a legal walk keeps; no solver library.

A graph: sequence edges (two nodes each, with length and copy number) and breakpoint edges between nodes. A walk
alternates: along a sequence edge from one node to its other, then over a breakpoint edge. A cycle returns to its first
node; a path begins and ends at end nodes.

The greedy mode takes one walk after the other: the one of the largest weight times length (weight: the least copy number
per pass) with a bonus for the path constraints it newly satisfies, found by depth-first search with a budget of steps, so
the result doesn't depend on time. It stops when the weight falls below LEAST_CN, when at most a tenth of the
length-weighted copy number is left and at most a tenth of the constraints, or when a walk adds less than 0.5%.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

LEAST_CN = 0.1
REST = 0.1
GAIN = 0.005
BUDGET = 4000


@dataclass
class Graph:
    sequence: list[tuple]  # (node, node) in reference order
    lengths: list[float]
    joints: list[tuple]  # (node, node): concordant and discordant edges
    cn: list[float]  # of sequence edges, then joints
    bounds: list[int]  # most passes, by joint
    ends: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.of_node = {n: (k, self.sequence[k][1 - side]) for k, e in enumerate(self.sequence) for side, n in enumerate(e)}
        self.at: dict = {}
        for k, (a, b) in enumerate(self.joints):
            self.at.setdefault(a, []).append((k, b))
            if a != b:
                self.at.setdefault(b, []).append((k, a))


@dataclass(frozen=True)
class Walk:
    steps: tuple  # (sequence edge, entry node) in order
    joints: tuple  # joint after each step; a cycle has one for each step
    cyclic: bool

    def passes(self, n_sequence: int) -> Counter:
        """Edge number -> times passed; joints are numbered after the sequence edges."""
        return Counter([k for k, _ in self.steps]) + Counter([n_sequence + j for j in self.joints])


def weight(g: Graph, w: Walk, cn: list[float]) -> float:
    return min(cn[e] / n for e, n in w.passes(len(g.sequence)).items())


def length(g: Graph, w: Walk) -> float:
    return sum(g.lengths[k] for k, _ in w.steps)


def satisfied(g: Graph, w: Walk, constraints: list[Counter]) -> set[int]:
    own = w.passes(len(g.sequence))
    return {k for k, c in enumerate(constraints) if all(own[e] >= n for e, n in c.items())}


def best_walk(g: Graph, cn: list[float], constraints: list[Counter], open_ones: set[int], bonus: float) -> tuple[Walk, float] | None:
    """The walk of best score over starts at every end node and every sequence edge; ties to the one found first."""
    n = len(g.sequence)
    best: tuple[float, Walk] | None = None
    starts = [(v, False) for v in sorted(g.ends) if v in g.of_node] + [(e[0], True) for e in g.sequence]

    for start, cyclic in starts:
        if cn[g.of_node[start][0]] < LEAST_CN:
            continue
        stack = [((), (), Counter(), start)]
        steps = 0
        while stack and steps < BUDGET:
            steps += 1
            done, joined, used, enter = stack.pop()
            k, leave = g.of_node[enter]
            passed = used + Counter([k])
            if cn[k] / passed[k] < LEAST_CN or passed[k] > 2:
                continue
            done = (*done, (k, enter))
            closed = None
            if not cyclic and leave in g.ends:
                closed = Walk(done, joined, False)
            options = []
            for j, to in g.at.get(leave, ()):
                if passed[n + j] >= g.bounds[j] or cn[n + j] / (passed[n + j] + 1) < LEAST_CN or to not in g.of_node:
                    continue
                if cyclic and to == start:
                    closed = Walk(done, (*joined, j), True)
                else:
                    options.append((cn[n + j], j, to))
            if closed:
                w = weight(g, closed, cn)
                value = w * length(g, closed) + bonus * len(satisfied(g, closed, constraints) & open_ones)
                if w >= LEAST_CN and (best is None or value > best[0] * (1 + 1e-12)):
                    best = value, closed
            for _, j, to in sorted(options):  # the joint of most copies is tried first
                stack.append((done, (*joined, j), passed + Counter([n + j]), to))
    return (best[1], weight(g, best[1], cn)) if best else None


def greedy(g: Graph, constraints: list[Counter] | None = None, alpha: float = 0.01) -> list[tuple[Walk, float, set[int]]]:
    """Walks with weight and the constraints each satisfies, in the order found."""
    constraints = constraints or []
    cn = list(g.cn)
    total = rest = sum(c * s for c, s in zip(cn, g.lengths)) or 1.0
    open_ones, out = set(range(len(constraints))), []
    while rest > REST * total or len(open_ones) > REST * len(constraints):  # each walk uses up an edge, so it ends
        bonus = alpha * rest / len(open_ones) if open_ones else 0.0
        if not (found := best_walk(g, cn, constraints, open_ones, bonus)):
            break
        walk, w = found
        got = satisfied(g, walk, constraints)
        gain = w * length(g, walk)
        if gain < GAIN * total and not got & open_ones:
            break
        out.append((walk, w, got))
        for e, n in walk.passes(len(g.sequence)).items():
            cn[e] = 0.0 if cn[e] - w * n < LEAST_CN else cn[e] - w * n
        rest, open_ones = rest - gain, open_ones - got
    return out


def fewest(g: Graph, pool: list[Walk], cover: float = 0.9, constraints: list[Counter] | None = None) -> list[tuple[Walk, float]]:
    """A small subset of a pool of walks that covers `cover` of the length-weighted copy number: the walk that adds most, each
    time, weights by what is left; then walks go whose removal keeps the cover and the constraints satisfied so far."""
    total = sum(c * s for c, s in zip(g.cn, g.lengths))

    def refit(walks: list[Walk]) -> tuple[list[tuple[Walk, float]], float]:
        cn, got, out = list(g.cn), 0.0, []
        for w in walks:
            x = weight(g, w, cn)
            if x >= LEAST_CN:
                for e, n in w.passes(len(g.sequence)).items():
                    cn[e] -= x * n
                got += x * length(g, w)
                out.append((w, x))
        return out, got

    met = lambda found: set().union(*(satisfied(g, w, constraints or []) for w, _ in found))
    ordered = sorted(pool, key=lambda w: (-weight(g, w, g.cn) * length(g, w), w.steps))
    chosen, got = refit(ordered)
    for w in [w for w, _ in reversed(chosen)]:
        fewer, less = refit([x for x, _ in chosen if x is not w])
        if (less >= cover * total or less >= got - 1e-9) and met(fewer) >= met(chosen):
            chosen, got = fewer, less
    return chosen


def needs_greedy(n_edges: int, n_nodes: int, n_constraints: int, k: int, most_edges: int = 100, most_variables: int = 10_000) -> bool:
    """Whether a graph is too large for the fewest-walks search with k walks: by its edges, or the variables that takes."""
    return n_edges > most_edges or 3 * k + 3 * k * n_edges + 2 * k * n_nodes + k * n_constraints >= most_variables


def faults(g: Graph, walks: list[tuple[Walk, float]]) -> list[str]:
    """Rules that walks break: alternation, closure, bounds, and copy numbers (sums over walks)."""
    out, n = [], len(g.sequence)
    used: Counter = Counter()
    for k, (w, x) in enumerate(walks):
        here = None
        for s, (edge, enter) in enumerate(w.steps):
            if enter not in g.sequence[edge]:
                out.append(f"walk {k}: step {s} enters an edge it isn't on")
            if s and (here, enter) not in (g.joints[w.joints[s - 1]], g.joints[w.joints[s - 1]][::-1]):
                out.append(f"walk {k}: joint {s} doesn't join its steps")
            here = g.of_node[enter][1]
        if w.cyclic and (here, w.steps[0][1]) not in (g.joints[w.joints[-1]], g.joints[w.joints[-1]][::-1]):
            out.append(f"walk {k}: not closed")
        if not w.cyclic and not (w.steps[0][1] in g.ends and here in g.ends):
            out.append(f"walk {k}: a path that doesn't run between end nodes")
        for e, c in w.passes(n).items():
            used[e] += x * c
            if e >= n and c > g.bounds[e - n]:
                out.append(f"walk {k}: joint {e - n} passed too often")
    return out + [f"edge {e}: more than its copies" for e, x in used.items() if x > g.cn[e] + 1e-6]


def euler(edges: Counter, g: Graph, cyclic: bool, constraints: list[Counter] | None = None, budget: int = 20000) -> Walk | None:
    """A walk that passes every edge (numbers as in passes()) exactly as often as asked; deterministic backtracking, from the
    smallest end node or sequence edge. None if there is none within the budget."""
    n = len(g.sequence)
    total = sum(c for e, c in edges.items() if e < n)
    starts = [g.sequence[min(e for e in edges if e < n)][0]] if cyclic else sorted(v for v in g.ends if v in g.of_node and edges[g.of_node[v][0]])
    steps = 0
    for start in starts:
        stack = [((), (), Counter(edges), start)]
        while stack and steps < budget:
            steps += 1
            done, joined, left, enter = stack.pop()
            k, leave = g.of_node[enter]
            if left[k] <= 0:
                continue
            left = left.copy()
            left[k] -= 1
            done = (*done, (k, enter))
            if len(done) == total:
                if not cyclic and leave in g.ends and not any(c > 0 for c in left.values()):
                    return Walk(done, joined, False)
                for j, to in g.at.get(leave, ()):
                    if cyclic and to == start and left[n + j] == 1 and sum(c for c in left.values() if c > 0) == 1:
                        return Walk(done, (*joined, j), True)
                continue
            for j, to in sorted(g.at.get(leave, ()), reverse=True):
                if left[n + j] > 0 and to in g.of_node:
                    more = left.copy()
                    more[n + j] -= 1
                    stack.append((done, (*joined, j), more, to))
    return None
