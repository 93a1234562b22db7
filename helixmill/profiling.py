"""Resource usage of calls: wall time and the peak memory of this process, kept in a list the caller owns."""

from __future__ import annotations

import functools
import resource
import time
from collections.abc import Callable


class Usage:
    """Figures of profiled calls; a call that is counted is named name/1, name/2 and so on."""

    def __init__(self) -> None:
        self.calls: list[tuple[str, float, float]] = []

    def profiled(self, f: Callable, counted: bool = False) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            n = sum(c.startswith(f"{f.__name__}/") for c, _, _ in self.calls) + 1
            began = time.perf_counter()
            try:
                return f(*args, **options)
            finally:
                peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6
                self.calls.append((f"{f.__name__}/{n}" if counted else f.__name__, peak, time.perf_counter() - began))

        return run
