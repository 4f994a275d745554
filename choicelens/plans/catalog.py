"""Import every named-query module so the registry is complete."""

from choicelens.plans import (  # noqa: F401
    q_aggs, q_choice, q_clean, q_files, q_geo, q_impute, q_layout, q_model, q_payloads, q_quality,
    q_reshape)
from choicelens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
