"""Settings of discovery with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DiscoveryConfig:
    join_overlap_th: float = 0.4
    num_overlap_th: float = 0.85
    inclusion_dep_th: float = 0.3
    pkfk_cardinality_th: float = 0.7
    minhash_num_perm: int = 512
    minhash_threshold: float = 0.7
    max_degrees: int = 100
    dbscan_eps: float = 0.1
    schema_sim_neighbours: int = 9
    max_values: int = 20_000
    max_file_size_gb: float = 10
    tfidf_max_features: int = 10_000
    join_sample_rows: int = 1_000


DEFAULT = DiscoveryConfig()
