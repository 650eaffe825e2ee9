"""Settings of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from coterie.functions import columns as C
from coterie.operators.clusters import CLUSTERS
from coterie.operators.network import LIFT_THRESHOLD, SUPPORT_THRESHOLD
from coterie.operators.transactions import EMPTY_CELL_THRESHOLD, MIN_TRANSACTIONS
from coterie.operators.tree import CCP_ALPHA, NULL_THRESHOLD
from coterie.sources.panels import PanelSpec


@dataclass(frozen=True)
class RunSpec:
    """One named run; every default is the usual setting of the analysis."""

    run_id: str
    panel: PanelSpec = field(default_factory=PanelSpec)
    focus: tuple[str, ...] = C.FOCUS
    # thresholds
    support: float = 0.05
    real_support: float = 0.1
    confidence: float = 0.8
    lift: float = 1.5
    # rules
    real_measures: bool = False
    approach: str = "RAR"
    prune: bool = False
    one_to_one: bool = False
    combine: bool = False
    cluster: bool = True
    by_cohort: bool = False
    antecedents: tuple[str, ...] = ()
    consequents: tuple[str, ...] = ()
    rules_limit: int | None = None
    transaction_limit: int | None = None
    min_transactions: int = MIN_TRANSACTIONS
    empty_cell_threshold: float = EMPTY_CELL_THRESHOLD
    # charts
    weight: str = "lift"
    hidden: tuple[str, ...] = ()
    show_antecedent: str | None = None
    show_consequent: str | None = None
    grouping: Mapping[str, int] = field(default_factory=dict)
    title_changes: Mapping[str, str] = field(default_factory=dict)
    # models
    tree: bool = False
    hierarchy: bool = False
    network: bool = False
    bipartite: bool = True
    network_support: float = SUPPORT_THRESHOLD
    network_lift: float = LIFT_THRESHOLD
    clusters: int = CLUSTERS
    cluster_attributes: tuple[str, ...] = ()
    analysed_attribute: str | None = None
    null_threshold: float = NULL_THRESHOLD
    ccp_alpha: float = CCP_ALPHA
    domains: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def thresholds(self) -> dict[str, float]:
        return {"support": self.support, "confidence": self.confidence, "lift": self.lift}
