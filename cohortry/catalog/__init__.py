from cohortry.catalog import grouped, models, rows  # noqa: F401
from cohortry.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
