"""All registered queries."""

from fieldlake.plans import family_plans, farm_plans, record_plans, search_plans, text_plans  # noqa: F401
from fieldlake.plans.sql import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
