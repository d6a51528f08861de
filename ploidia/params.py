"""Every knob, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # cells and genes
    min_genes: int = 200
    min_cells: int = 3
    low_dr: float = 0.05
    up_dr: float = 1.0
    target_sum: float = 1e4
    # reference pool
    normal_score_threshold: float = 0.3
    min_normal_cells: int = 50
    ucell_max_rank: int = 1500
    variance_comps: int = 30
    variance_neighbors: int = 15
    variance_resolution: float = 1.0
    # smoothing and segments
    smooth_window: int = 100
    penalty_coef: float = 1.0
    min_seg_genes: int = 25
    # calls
    call_confidence: float = 0.5
    outlier_fence_mult: float = 12.0
    subclones: bool = True
    max_subclones: int = 5
    subclone_sweep: tuple[float, ...] = (0.3, 0.5, 0.8, 1.2, 1.8)
    min_tumor_cells: int = 30
    complexity_gate: bool = True
    low_complexity_frac: float = 0.5
    coherence_gate: float = 0.45
    coherence_support: float = 0.45
    coherence_window: int = 5
    template_seed_quantile: float = 0.75
    anti_aligned_min_tumor: int = 30
    anti_aligned_frac: float = 0.5
    altered_threshold: float = 0.2
    # display
    heatmap_n_ref: int = 4000
    heatmap_max_obs: int = 8000
    heatmap_vlim: float = 0.15
    sd_amplifier: float = 1.0
    ref_score_quantile: float = 0.5
    cluster_max: int = 8000
    # graphs: cells on which neighbours are exact; beyond, landmarks stand for them
    max_graph_cells: int = 20_000
    block_bytes: float = 1.5e9

    def __post_init__(self) -> None:
        if not (self.sd_amplifier >= 0 and self.sd_amplifier < float("inf")):
            raise ValueError("sd_amplifier must be finite and not negative")
