"""All named queries in one place."""

from __future__ import annotations

from pairwright.plans import (  # noqa: F401
    layout_queries,
    mail_queries,
    pair_queries,
    run_queries,
    value_queries,
)
from pairwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
