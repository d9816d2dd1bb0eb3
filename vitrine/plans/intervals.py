"""Point-in-interval join: instants of a key meet the intervals of the same key.

A join on the key alone tests every instant of a key against every interval it ever had,
and a join on the time condition alone is a nested loop. Here an interval is put into
bins of its own width: of the day widths 2**3, 2**6, ... 2**24 it takes the least that is
no shorter than itself, so it touches at most two bins however long it is. An instant
looks into one bin of each width that some interval has, and not at all when it lies before the
first start or after the last end. The join is then an equi-join on (key, width, bin),
which spreads a hot key over its bins, followed by the exact test of both ends.

Defined cases: both ends are included; an instant, end or key that is NULL and an interval
that ends before it starts meet nothing; repeated rows of either side meet each time, so
a caller makes instants distinct, or sums over them, before they are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents of the bin widths in days; 2**24 days exceed all dates Spark knows.
LEVELS = (3, 6, 9, 12, 15, 18, 21, 24)


def _day(t: Column) -> Column:
    # Days of the calendar: in order for both timestamp types, whatever the time zone.
    return F.unix_date(F.to_date(t)).cast("long")


def _bin(day: Column, level: Column) -> Column:
    return F.floor(day / F.pow(F.lit(2.0), level)).cast("long")


def binned_intervals(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """``intervals`` with (_level, _bin), one or two rows for each."""
    days = _day(F.col(end)) - _day(F.col(start)) + 1
    level = F.lit(LEVELS[-1])
    for x in reversed(LEVELS[:-1]):
        level = F.when(days <= 2 ** x, F.lit(x)).otherwise(level)
    first, last = _bin(_day(F.col(start)), F.col("_level")), _bin(_day(F.col(end)), F.col("_level"))
    return (intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level)
            .withColumn("_bin", F.explode(F.sequence(first, last))))


def probes(instants: DataFrame, binned: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """``instants`` with (_level, _bin): a row for each width among the ``binned``
    intervals, of which no more than LEVELS reach the plan."""
    levels = binned.select(F.collect_set("_level")).scalar()
    first, last = binned.select(F.min(start)).scalar(), binned.select(F.max(end)).scalar()
    return (instants.filter(F.col(at).isNotNull() & F.col(at).between(first, last))
            .withColumn("_level", F.explode(levels))
            .withColumn("_bin", _bin(_day(F.col(at)), F.col("_level"))))


def in_force(instants: DataFrame, intervals: DataFrame, keys: list[str], at: str,
             start: str, end: str) -> DataFrame:
    """Pairs of a row of ``instants`` and an interval of its keys that holds its time, with
    the columns of both."""
    binned = binned_intervals(intervals, start, end)
    pairs = probes(instants, binned, at, start, end).join(binned, [*keys, "_level", "_bin"])
    return pairs.filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bin")
