"""First-month friction analytics on Spark DataFrames."""

from firstmonth.plans.first_month import FirstMonth, prepare
from firstmonth.sources.tables import Tables

__all__ = ["FirstMonth", "Tables", "prepare"]
