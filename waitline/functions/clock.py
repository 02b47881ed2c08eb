"""Time arithmetic on whole microseconds.

Grid positions are integers ("cells"), so range conditions become equality on a cell
number and never depend on how a timestamp is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read as UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def stamp(us: Column, dtype) -> Column:
    """Back from microseconds to the timestamp type of the source column."""
    return F.timestamp_micros(us).cast(dtype)


def floor_cell(us: Column, step: int, origin: Column | int = 0) -> Column:
    """Last grid cell at or before a time."""
    rel = us - origin
    return ((rel - F.pmod(rel, F.lit(step))) / F.lit(step)).cast("long")


def exact_cell(us: Column, step: int) -> Column:
    """Grid cell of a time that lies on the grid; any other stops the query."""
    off = F.raise_error(F.lit("a point lies off the grid: use grid.episode_at for such moments")).cast("long")
    return F.when(F.pmod(us, F.lit(step)) == 0, floor_cell(us, step)).when(us.isNotNull(), off)


def ceil_cell(us: Column, step: int, origin: Column | int = 0) -> Column:
    """First grid cell at or after a time."""
    rel = us - origin
    return ((rel + F.pmod(-rel, F.lit(step))) / F.lit(step)).cast("long")


def cells(lo: Column, hi: Column) -> Column:
    """Array of the cells lo..hi, empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def minutes_between(start: str, end: str) -> Column:
    """Duration in minutes from whole seconds on both sides."""
    return (F.unix_timestamp(F.col(end).cast("timestamp"))
            - F.unix_timestamp(F.col(start).cast("timestamp"))) / F.lit(60.0)


def exact_minutes_between(start: str, end: str) -> Column:
    """Duration in minutes keeping fractions of a second."""
    return (micros(end) - micros(start)) / F.lit(float(MINUTE_US))
