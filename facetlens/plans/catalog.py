"""Imports every query module so that the registry is complete."""

from facetlens.plans import code_queries, experiment_queries, geometry_queries, item_queries, source_queries, subspace_queries, token_queries, triage_queries  # noqa: F401
from facetlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
