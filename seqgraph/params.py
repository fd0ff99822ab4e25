"""Alignment parameters, their presets and their check."""

from __future__ import annotations

from dataclasses import dataclass, replace

SEEDINGS = ("minimizer", "mum", "mem", "file", "seedless")


@dataclass(frozen=True)
class AlignParams:
    seeding: str = "minimizer"
    density: float = 10.0
    k: int = 19
    w: int = 30
    ignore_frequent: float = 0.0002
    max_clusters: int = 5
    min_cluster_size: int = 1
    bandwidth: int = 10
    cells_per_slice: int = -1
    identity: float = 0.66
    x_drop: int = -1
    multimap_fraction: float = 0.9
    min_score: float = 0.0
    e_cutoff: float = -1.0
    max_traces: int = 10
    incompatible_overlap: float = 0.3
    mxm_length: int = 20
    mxm_count: int = -1
    mxm_window: int = 0
    unique_bonus: float = 1.0
    clip_ambiguous: float = -1.0
    hpc_reads: bool = False
    restart_stride: int = 0
    diploid_k: tuple[int, ...] = ()
    diploid_cache: str = ""
    cigar_match_mismatch: bool = True

    def checked(self) -> AlignParams:
        """Raises ValueError with all that is wrong."""
        wrong = []
        if self.seeding not in SEEDINGS:
            wrong.append(f"seeding is one of {', '.join(SEEDINGS)}")
        if self.seeding == "minimizer" and not (0 < self.k < 32 and self.w > self.k):
            wrong.append("minimizers need 0 < k < 32 and w > k")
        if not 0 < self.identity < 1:
            wrong.append("the identity cutoff lies between 0 and 1")
        if not 0 <= self.multimap_fraction <= 1 or not 0 <= self.ignore_frequent < 1 or not 0 <= self.incompatible_overlap <= 1:
            wrong.append("fractions lie between 0 and 1")
        if self.max_clusters < 1 or self.min_cluster_size < 1 or self.max_traces < 1 or self.bandwidth < 1:
            wrong.append("clusters, cluster size, traces and bandwidth are at least 1")
        if self.mxm_length < 2:
            wrong.append("exact matches have 2 bases or more")
        if self.mxm_window < 0 or self.restart_stride < 0 or self.unique_bonus <= 0:
            wrong.append("windows and strides are not negative, and a bonus is over 0")
        if any(k % 2 == 0 or not 0 < k <= 63 for k in self.diploid_k):
            wrong.append("diploid k is odd and at most 63")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    @property
    def drop(self) -> float:
        """X-drop in score units; by default that of 50 mismatches."""
        from seqgraph.functions.sequences import error_cost

        return (self.x_drop if self.x_drop >= 0 else max(50, 50 * error_cost(self.identity))) / 100


PRESETS = {
    "dbg": AlignParams(density=5, k=19, w=30, max_clusters=5, bandwidth=5, cells_per_slice=10_000),
    "vg": AlignParams(density=10, k=15, w=20, max_clusters=5, ignore_frequent=0.001, bandwidth=10),
}


def preset(name: str, **changes) -> AlignParams:
    return replace(PRESETS[name], **changes).checked()
