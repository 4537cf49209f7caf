"""Sent-paper history: anti-joins, look-back, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def _blocking(sent: DataFrame, as_of: Column, days: int | None) -> DataFrame:
    """Sent keys that still block a repeat; ``days`` None means for ever."""
    if days is None:
        return sent
    return sent.where(F.col("sent_at") > days_before(as_of, days))


def unsent(
    papers: DataFrame, sent: DataFrame, as_of: Column, days: int | None = None, key: str = "paper_key"
) -> DataFrame:
    """Papers that were never sent, or not within the last ``days`` days."""
    return papers.join(_blocking(sent, as_of, days).select(key), key, "left_anti")


def with_sent_flag(
    papers: DataFrame, sent: DataFrame, as_of: Column, days: int | None = None, key: str = "paper_key"
) -> DataFrame:
    """Adds ``is_sent``. History is reduced to one row per key first, so rows never multiply."""
    keys = _blocking(sent, as_of, days).groupBy(key).agg(F.max("sent_at").alias("_last"))
    return papers.join(keys, key, "left").withColumn("is_sent", F.col("_last").isNotNull()).drop("_last")


def last_sent(sent: DataFrame, key: str = "paper_key") -> DataFrame:
    """Latest send per key: the state that repeated marking leaves behind."""
    return sent.groupBy(key).agg(F.max("sent_at").alias("sent_at"))


def retain(sent: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Entries younger than the retention period."""
    return sent.where(F.col("sent_at") > days_before(as_of, days))


def last_run(sent: DataFrame) -> DataFrame:
    return sent.agg(F.max("sent_at").alias("last_run"))
