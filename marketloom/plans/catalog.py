"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from marketloom.plans import cleaning_queries, demand_queries, fault_queries, file_queries, forecast_queries, sales_queries  # noqa: F401
from marketloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
