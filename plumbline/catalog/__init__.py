"""Every operator as a query over the given tables."""

from plumbline.catalog import charts, features, inspect, models, quality, statistics
from plumbline.catalog.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "charts", "features", "inspect", "models", "quality", "statistics"]
