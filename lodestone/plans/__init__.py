"""Registered queries, with their SQL twins."""

from lodestone.plans import curation_queries, file_queries, gate_queries, job_queries, metric_queries, rule_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
