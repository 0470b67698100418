"""Imports every query module and exposes the filled registry."""

from importlib import import_module

from shelfwise.plans.registry import ORACLES, QUERIES

MODULES = (
    "q_scalars",
    "q_relational",
    "q_sources",
    "q_aggregates",
    "q_sampling",
    "q_text",
    "q_features",
    "q_neighbors",
    "q_graph",
    "q_metrics",
    "q_learn",
    "q_runs",
)

for _m in MODULES:
    import_module(f"shelfwise.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
