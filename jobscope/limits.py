"""Rule thresholds.  Fixed values: the findings depend on every one of them."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024
GIB = 1024 * MIB


@dataclass(frozen=True)
class Limits:
    # task_duration_skew
    duration_skew_min_tasks: int = 10
    duration_skew_ratio: float = 3.0
    # shuffle_partition_skew
    shuffle_skew_min_tasks: int = 10
    shuffle_skew_ratio: float = 5.0
    shuffle_skew_bytes: int = 256 * MIB
    # oversized_shuffle_partitions
    oversized_min_tasks: int = 2
    oversized_p95_medium_bytes: int = 256 * MIB
    oversized_p95_high_bytes: int = GIB
    oversized_max_high_bytes: int = 2 * GIB
    # low_shuffle_parallelism
    low_parallelism_medium_bytes: int = GIB
    low_parallelism_high_bytes: int = 10 * GIB
    low_parallelism_medium_tasks: int = 7
    low_parallelism_high_tasks: int = 15
    low_parallelism_oversized_avg_bytes: int = 256 * MIB
    # spill_pressure
    spill_disk_medium_bytes: int = 256 * MIB
    spill_disk_high_bytes: int = GIB
    spill_memory_medium_bytes: int = GIB
    spill_single_task_memory_bytes: int = 4 * GIB
    spill_max_task_disk_high_bytes: int = 512 * MIB
    # memory_spill_skew, disk_spill_skew
    spill_skew_min_tasks: int = 10
    spill_skew_ratio: float = 5.0
    memory_spill_skew_bytes: int = 256 * MIB
    disk_spill_skew_bytes: int = 128 * MIB
    # too_many_tiny_tasks
    tiny_min_tasks: int = 100
    tiny_max_avg_millis: int = 500
    tiny_max_p95_millis: int = 1000
    tiny_max_avg_shuffle_bytes: int = MIB
    # retry_waste
    retry_min_attempts: int = 3
    retry_medium_millis: int = 30_000
    retry_high_millis: int = 300_000
    # speculation_heavy
    speculation_min_tasks: int = 10
    speculation_min_attempts: int = 3
    speculation_medium_share: float = 0.20
    speculation_high_share: float = 0.50
    # executor_imbalance, host_imbalance
    imbalance_min_tasks: int = 10
    imbalance_min_workers: int = 2
    imbalance_duration_share: float = 0.75
    imbalance_task_share: float = 0.50
    # sql_many_exchanges
    many_exchanges: int = 4
    # duplicate_sql_subtree, possible_missed_exchange_reuse
    duplicate_min_count: int = 2
    duplicate_min_size: int = 3


DEFAULT_LIMITS = Limits()
