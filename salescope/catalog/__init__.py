"""Every query of the library on the test tables, each with the SQL it is checked by."""

from ..plans.registry import QUERIES, SQL
from . import (  # noqa: F401
    analytics, cleaning, decisions, features, forecast, functions, models, profile, quality, returns, signals,
    sources,
)

__all__ = ["QUERIES", "SQL"]
