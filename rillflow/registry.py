"""All registered queries of the signal engine, with the SQL each is held against."""

from __future__ import annotations

from rillflow.plans import extended  # noqa: F401  (registers its queries)
from rillflow.plans.catalog import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
