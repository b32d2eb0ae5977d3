"""Job options in one place, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FlowOptions:
    timeout_seconds: float = 120.0
    idle_seconds: float = 1.0
    # Packets of one key are spread over cells of this many seconds, so that one busy key
    # never has to be ordered by a single task. Never wider than the timeout.
    cell_seconds: float = 10.0
    # The exact median inter-arrival time of a flow with more packets than this is found by
    # narrowing over many tasks instead of in one aggregation buffer. Same values either way.
    # In the flow table only 5-tuples with more packets than this are ordered in cells at all.
    wide_flow_packets: int = 1_000_000


@dataclass(frozen=True)
class AnomalyOptions:
    trees: int = 100
    tree_rows: int = 256
    contamination: float = 0.05
    nu: float = 0.05
    svm_features: int = 256
    eps: float = 0.8
    min_points: int = 5
    clusters: int = 4
    seed: int = 42


@dataclass(frozen=True)
class JobOptions:
    rolling_rows: int = 10
    seed: int = 42
    flow: FlowOptions = field(default_factory=FlowOptions)
    anomaly: AnomalyOptions = field(default_factory=AnomalyOptions)
