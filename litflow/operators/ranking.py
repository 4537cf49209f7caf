"""Exact ranks over very large partitions without a single-task window.

A window with ``row_number`` or ``cume_dist`` sorts each partition in one task. Here a partition is
cut into value ranges taken from approximate quantiles; ranges are ranked independently and offset
by the sizes of the ranges before them. The ranges only steer parallelism: the ranks are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.session import stored

MAX_RANGES = 4096
# Rows of one range, about.
RANGE_ROWS = 250_000


def _splits(df: DataFrame, column: str, ranges: int | None) -> list[float]:
    if ranges is None:  # as many as the rows need
        ranges = -(-df.count() // RANGE_ROWS)
    ranges = max(1, min(ranges, MAX_RANGES))
    if ranges == 1:
        return []
    probes = [i / ranges for i in range(1, ranges)]
    return df.approxQuantile(column, probes, 1.0 / (4 * ranges))


def _range_of(c: Column, splits: Sequence[float]) -> Column:
    """Monotone range number; a value equal to a split gets a range of its own."""
    uniq = sorted(set(splits))
    if not uniq:
        return F.lit(0)
    lit = F.array(*[F.lit(float(s)) for s in uniq])
    v = c.cast("double")
    return F.size(F.filter(lit, lambda s: s < v)) + F.size(F.filter(lit, lambda s: s <= v))


def _offsets(counts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows before each range; the input has at most 4*MAX_RANGES**2 rows per partition key."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def row_number_desc(
    df: DataFrame, partition: Sequence[str], value: str, tie: str, ranges: int | None = None, name: str = "rank"
) -> DataFrame:
    """``row_number`` per partition by ``value`` descending, then ``tie`` ascending (numeric, unique).

    Ranges are cut on the value and, inside one value, on the tie column, so neither a partition
    nor a single repeated value has to fit into one task.
    """
    df = df.withColumn("_neg", -F.col(value))
    keyed = (
        df.withColumn("_r1", _range_of(F.col("_neg"), _splits(df, "_neg", ranges)))
        # an odd range number holds exactly one value, so it may be cut further by the tie column
        .withColumn(
            "_r2",
            F.when(F.col("_r1") % 2 == 1, _range_of(F.col(tie), _splits(df, tie, ranges))).otherwise(0),
        )
    )
    by = list(partition)
    counts = keyed.groupBy(*by, "_r1", "_r2").agg(F.count("*").alias("_n"))
    offsets = _offsets(counts, by, ["_r1", "_r2"]).drop("_n")
    w = W.partitionBy(*by, "_r1", "_r2").orderBy("_neg", tie)
    return (
        keyed.withColumn("_rn", F.row_number().over(w))
        .join(offsets, [*by, "_r1", "_r2"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_neg", "_r1", "_r2", "_rn", "_before")
    )


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "position", first: int = 0) -> DataFrame:
    """Adds the place of every row in the order of the whole table, from ``first`` on; rows equal in ``order`` get any order.

    The table is range-partitioned by the order and written once; ranges are numbered inside and set off by the sizes of
    the ranges before them, of which there is one row each. No task sees more than a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = _offsets(cut.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], ["_range"])
    w = W.partitionBy("_range").orderBy(*order)
    placed = cut.withColumn("_at", F.row_number().over(w)).join(F.broadcast(sizes.select("_range", "_before")), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_at") - 1 + first).drop("_range", "_at", "_before")


def share_at_most(df: DataFrame, value: str, ranges: int | None = None, name: str = "share") -> DataFrame:
    """``cume_dist`` over the whole table: share of rows whose value is at most this one.

    Equal values are counted first, so a value that fills a third of the table costs one row.
    """
    distinct = df.groupBy(value).agg(F.count("*").alias("_c"))
    cut = distinct.withColumn("_r", _range_of(F.col(value), _splits(distinct, value, ranges)))
    sizes = cut.groupBy("_r").agg(F.sum("_c").alias("_n"))
    offsets = _offsets(sizes.withColumn("_one", F.lit(1)), ["_one"], ["_r"]).select("_r", "_before")
    total = df.select(F.count("*")).scalar()
    w = W.partitionBy("_r").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        cut.withColumn("_upto", F.sum("_c").over(w))
        .join(F.broadcast(offsets), "_r")
        .select(value, ((F.col("_before") + F.col("_upto")) / total).alias(name))
    )
    return df.join(ranked, value)
