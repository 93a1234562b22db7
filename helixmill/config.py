"""Parameters of the pipeline, passed explicitly; there is no global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that results depend on.
    gain: float = 6.0
    min_seed_size: int = 100_000
    max_seg_gap: int = 300_000
    large_seed: int = 5_000_001
    large_seed_factor: float = 1.2
    arm_quantile: float = 0.49
    arm_cover: float = 0.5
    normal_cn: float = 2.0
    interval_cn: float = 5.0
    interval_delta: int = 100_000
    max_interval: int = 2_000_000
    min_mapq: int = 20
    gap_mapq: int = 10
    match_cutoff: int = 100
    cluster_cutoff: int = 2_000
    min_cluster: int = 3
    min_bp_support: float = 1.0
    min_deletion: int = 600
    merge_distance: int = 200
    coverage_length: int = 10_000_000
    hsr_cn: float = 5.0
    hsr_support: float = 2.5
    hsr_cluster: float = 0.5


DEFAULT = Params()
