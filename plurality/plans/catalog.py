"""Imports every module that registers queries."""

from plurality.plans import ablation_queries, contract_queries, evaluation_queries, measure_queries, record_queries, support_queries, text_queries, vote_queries  # noqa: F401
from plurality.plans.registry import ORACLES, QUERIES  # noqa: F401
