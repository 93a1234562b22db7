"""The texts of graph, cycles and summary files, which readers elsewhere rely on."""

from __future__ import annotations

from . import __version__

PROGRAM = "helixmill"
SEPARATOR = "-----------------------------------------------"
GRAPH_SEQUENCE = "SequenceEdge: StartPosition, EndPosition, PredictedCN, AverageCoverage, Size, NumberOfLongReads"
GRAPH_BREAKPOINT = "BreakpointEdge: StartPosition->EndPosition, PredictedCN, NumberOfLongReads"
GRAPH_PATHS = "PathConstraint: Path, Support"
CYCLE_SEGMENTS = "List of cycle segments"
CYCLE_ALL_PATHS = "List of all subpath constraints"
CYCLE_LONGEST_PATHS = "List of longest subpath constraints"
CYCLE_WALKS = "List of extracted cycles/paths"
SOLVER_HEADER = "Solver Settings:"
RESOURCE_HEADER = "Resource Usage Summary:"
SUBOPTIMAL = "WARNING: Sub-optimal solution used"
#: A solution whose relative gap is above this share in percent is marked as sub-optimal.
GAP_PERCENT = 1.0


def header(program: str = PROGRAM, version: str = __version__, method: str | None = None) -> str:
    """First line of a graph file, or with a method of a cycles file."""
    return f"#{program}-{method} {version}" if method else f"#{program} {version}"
