"""Data bindings over the provided tables, registered queries and their SQL counterparts."""

from canopy.plans import contracts, graphs, rules, snapshots, text, trees  # noqa: F401 - importing registers
from canopy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
