"""All queries of the reference's own operators."""

from __future__ import annotations

from tessera.plans import q_audit, q_columns, q_encode, q_features, q_models, q_panel, q_rules, q_shift, q_stream, q_tables  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
