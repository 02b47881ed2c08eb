"""Service-queue analytics as Spark DataFrame jobs."""

from waitline.params import Params

__all__ = ["Params"]
