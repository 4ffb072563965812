"""Hourly counts from fixed sensors, analysed as Spark DataFrame, SQL and MLlib jobs."""

from .params import Params

__all__ = ["Params"]
