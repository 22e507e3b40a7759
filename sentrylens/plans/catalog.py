"""All registered queries; importing the query modules fills the registry."""

from sentrylens.plans import (  # noqa: F401
    q_audit,
    q_decisions,
    q_features,
    q_labels,
    q_populations,
    q_projections,
    q_runs,
    q_windows,
)
from sentrylens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
