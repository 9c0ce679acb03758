"""Overlap join: pairs of intervals that have a point in common, as equi-joins on bins.

An interval lies at the level of its length: bins there are 2^level wide and no shorter than it, so it touches two at most,
however long it is.  Of a pair the longer one is met at its own level, and the shorter one is dealt to the levels of longer ones that
there are (64 at most).  A pair that shares two bins is emitted in that where its overlap begins, so each comes once.  Points are
intervals of no length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MINE = ("_level", "_bin", "_start", "_end", "_own")


def _level(start: Column, end: Column) -> Column:
    """The number of bits of the length: the least level whose bins are longer."""
    return F.length(F.regexp_replace(F.bin(end - start), "^0$", ""))


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    found = df.where(F.col(start) <= F.col(end)).select(_level(F.col(start), F.col(end)).alias("l")).distinct().collect()  # at most 64
    return sorted(r["l"] for r in found)


def _dealt(df: DataFrame, start: str, end: str, levels: list[int], strictly: bool) -> DataFrame:
    """Rows at their own level and at each of ``levels`` above it (``strictly`` without their own)."""
    own = df.where(F.col(start) <= F.col(end)).withColumns({"_start": F.col(start), "_end": F.col(end), "_own": _level(F.col(start), F.col(end))})
    up = F.filter(F.array(*(F.lit(x) for x in levels)).cast("array<int>"), lambda x: x > F.col("_own") if strictly else x >= F.col("_own"))
    placed = own.withColumn("_level", F.explode(up))
    return placed.withColumn("_bin", F.explode(_bins()))


def _bins() -> Column:
    # a shift keeps the sign, so bins of negative starts are the lower ones too
    return F.array_distinct(F.array(F.call_function("shiftright", F.col("_start"), F.col("_level")), F.call_function("shiftright", F.col("_end"), F.col("_level"))))


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows whose closed intervals [start, end] (whole numbers) overlap, and which are equal in the columns ``on``.

    The columns of both, those of ``on`` once; other columns need different names.  Rows whose start or end is null, or
    whose end comes before their start, overlap with nothing.  Rows that repeat each have their pairs.
    """
    (ls, le), (rs, re) = left_bounds, right_bounds
    # where left is at its own level and right no longer; and where right is the longer one
    pairs = []
    for mine, theirs, mb, tb, strictly in ((left, right, (ls, le), (rs, re), False), (right, left, (rs, re), (ls, le), True)):
        levels = _levels(mine, *mb)
        long = mine.where(F.col(mb[0]) <= F.col(mb[1])).withColumns({"_start": F.col(mb[0]), "_end": F.col(mb[1]), "_level": _level(F.col(mb[0]), F.col(mb[1]))}).withColumn("_bin", F.explode(_bins()))
        short = _dealt(theirs, *tb, levels, strictly) if levels else theirs.limit(0).withColumns({c: F.lit(0).cast("long") for c in _MINE})
        short = short.select(*theirs.columns, F.col("_level").cast("int").alias("_level"), "_bin", F.col("_start").alias("_s"), F.col("_end").alias("_e"))
        both = long.join(short, [*on, "_level", "_bin"]).where((F.col("_start") <= F.col("_e")) & (F.col("_s") <= F.col("_end")))
        begins = F.call_function("shiftright", F.greatest("_start", "_s"), F.col("_level"))
        pairs.append(both.where(begins == F.col("_bin")).select(*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)))
    return pairs[0].unionByName(pairs[1])
