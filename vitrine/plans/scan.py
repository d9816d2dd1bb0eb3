"""Ordered running sums and ranks that never send one key to one task.

A ``Window.partitionBy(k).orderBy(...)`` running sum puts every row of key
``k`` into one task, and an unpartitioned window puts the whole table there.
Here the rows are range-partitioned on ``(keys, order)`` instead, so a hot key
is split across many partitions:

1. ``repartitionByRange`` + ``sortWithinPartitions`` (one shuffle);
2. a per-partition scan (Arrow batches, numpy cumsum) gives each row its
   running sum inside its partition;
3. per (partition, key) totals - at most one row per key per partition -
   become offsets with a small window; only a key that continues from an
   earlier partition has a non-zero offset, so at most one row per partition
   survives and the offset table is bounded by the partition count (a proven
   broadcast);
4. the offsets are added back by a broadcast join.

The scanned rows are checkpointed between steps 2 and 3, so that both read one and
the same range partitioning.

The ordering must be total inside a key (unique ``keys + order``) for the
result to be deterministic, as with any running sum, and key columns must not
be NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PID = "_scan_pid"
IDX = "_scan_idx"


def _scan_partition(keys: list[str], values: list[str], outs: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key = None
        carry = np.zeros(len(values), dtype="int64")
        pos = 0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{o: pd.Series([], dtype="int64") for o in outs},
                                 **{IDX: pd.Series([], dtype="int64")})
                continue
            idx = np.arange(pos, pos + len(pdf), dtype="int64")
            pos += len(pdf)
            vals = pdf[values].fillna(0).astype("int64").to_numpy()
            if keys:
                kdf = pdf[keys]
                change = (kdf != kdf.shift()).any(axis=1).to_numpy()
                change[0] = True
                gid = np.cumsum(change)
                sums = pd.DataFrame(vals).groupby(gid).cumsum().to_numpy()
                if carry_key is not None and tuple(kdf.iloc[0]) == carry_key:
                    sums[gid == 1] += carry
                carry_key = tuple(kdf.iloc[len(pdf) - 1])
            else:
                sums = np.cumsum(vals, axis=0) + carry
            carry = sums[-1].copy()
            yield pdf.assign(**{o: sums[:, i].astype("int64") for i, o in enumerate(outs)},
                             **{IDX: idx})
    return run


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], value, out,
               inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Add running sums of integer column(s) ``value`` per ``keys`` in
    ``order`` as ``out`` (inclusive of the row itself unless
    ``inclusive=False``). ``value`` / ``out`` may be lists of equal length."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(k).asc() for k in keys] + list(order)
    ranged = (df.repartitionByRange(n, *sort_cols)
              .sortWithinPartitions(*sort_cols)
              .withColumn(PID, F.spark_partition_id()))
    locals_ = [f"_scan_local{i}" for i in range(len(values))]
    schema = T.StructType(ranged.schema.fields
                          + [T.StructField(c, T.LongType()) for c in locals_]
                          + [T.StructField(IDX, T.LongType())])
    # Written once to the shared checkpoint folder: totals and rows then see the same
    # ranges. Two branches over a lazy range shuffle may each sample bounds of their
    # own, which would join totals with rows of other partitions.
    ensure_checkpoint_dir(spark)
    scanned = ranged.mapInPandas(_scan_partition(keys, values, locals_), schema).checkpoint()

    totals = scanned.groupBy(PID, *keys).agg(
        *[F.max_by(c, IDX).alias(f"_scan_tot{i}") for i, c in enumerate(locals_)])
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum(f"_scan_tot{i}").over(w), F.lit(0)).alias(f"_scan_off{i}")
            for i in range(len(values))]
    nonzero = reduce(lambda a, b: a | b, [F.col(f"_scan_off{i}") != 0 for i in range(len(values))])
    # Bounded by the number of partitions (see module doc): a proven broadcast.
    offsets = totals.select(PID, *keys, *offs).filter(nonzero)
    joined = scanned.join(F.broadcast(offsets), [PID, *keys], "left")
    for i, (v, o) in enumerate(zip(values, outs)):
        running = F.col(locals_[i]) + F.coalesce(F.col(f"_scan_off{i}"), F.lit(0))
        if not inclusive:
            running = running - F.coalesce(F.col(v), F.lit(0))
        joined = joined.withColumn(o, running.cast("long"))
    return joined.drop(*locals_, *[f"_scan_off{i}" for i in range(len(values))], PID, IDX)


def global_rank(df: DataFrame, value: str, out: str = "ranking",
                descending: bool = True) -> DataFrame:
    """SQL ``RANK() OVER (ORDER BY value)`` without a single-partition window.

    rank(v) = 1 + number of rows ordered strictly before v. Rows are first
    counted per distinct value (partial aggregation), the running count runs
    over the distinct values only, and the ranks join back on the value.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_rank_n"))
    order = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()]
    before = prefix_sum(counts, [], order, "_rank_n", "_rank_before", inclusive=False)
    ranks = before.select(value, (F.col("_rank_before") + 1).alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks[value]), "inner").drop(ranks[value])


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1, 2, 3 ... in ``order`` over the whole table, without one partition."""
    return prefix_sum(df.withColumn("_rn_one", F.lit(1)), [], order, "_rn_one", out) \
        .drop("_rn_one")
