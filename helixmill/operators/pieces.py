"""Sequential folds over many small groups: one Python stream a partition instead of one call a group.

Rows are dealt by group and sorted, so a group is a run of rows; only the run at the end of a batch is carried over. The
memory needed is that of the largest group, which callers keep small by cutting groups beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole groups with the row ranges of the groups."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        new = np.zeros(len(f), dtype=bool)
        for k in keys:
            c = f[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        if at[-1]:
            yield f.iloc[: at[-1]].reset_index(drop=True), list(zip(at, at[1:]))
        rest = f.iloc[at[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, [(0, len(rest))]


def fold(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema) -> DataFrame:
    """Apply f to frames of whole groups, each group's rows in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, groups in whole_groups(frames, keys):
            yield f(frame, groups)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
