"""Filters on papers, users, interests and job logs, and job statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litflow.functions import text as tx
from litflow.functions.vectors import batch_embedder, paper_text
from litflow.operators.history import days_before

# Queries used when no interest has keywords.
DEFAULT_QUERIES = ("machine learning", "molecular dynamics", "computational chemistry")


def recent_or_undated(papers: DataFrame, as_of: Column, days: int) -> DataFrame:
    return papers.where(F.col("published_date").isNull() | (F.col("published_date") >= days_before(as_of, days)))


def source_query(
    papers: DataFrame, text: str | None = None, year_start: int | None = None, year_end: int | None = None,
    fields: Sequence[str] | None = None, days_back: int | None = None, as_of: Column | None = None,
) -> DataFrame:
    """The filters a source search offers: text, years, fields or categories (any), days back."""
    out = papers
    if text:
        out = out.where(tx.contains_phrase(tx.joined_text(F.col("title"), F.col("abstract")), text))
    if year_start is not None:
        out = out.where(F.col("year") >= year_start)
    if year_end is not None:
        out = out.where(F.col("year") <= year_end)
    if fields:
        out = out.where(F.arrays_overlap("fields_of_study", F.array(*[F.lit(f) for f in fields])))
    if days_back is not None:
        out = recent_or_undated(out, as_of, days_back)
    return out


def in_period(papers: DataFrame, start: Column, end: Column) -> DataFrame:
    return papers.where(F.col("created_at").between(start, end))


def since(papers: DataFrame, start: Column) -> DataFrame:
    return papers.where(F.col("created_at") >= start)


def eligible_users(users: DataFrame, kind: str, as_of: Column) -> DataFrame:
    """Users due for a digest at ``as_of`` in their own time zone; digest_day 0 is Sunday, and for
    monthly digests it is the day of the month."""
    local = F.from_utc_timestamp(as_of, F.col("timezone"))
    due = F.col("digest_enabled") & (F.col("digest_frequency") == kind) & (F.col("digest_hour") == F.hour(local))
    if kind == "weekly":
        due = due & (F.col("digest_day") == F.dayofweek(local) - 1)
    elif kind == "monthly":
        due = due & (F.col("digest_day") == F.dayofmonth(local))
    return users.where(due)


def alert_users(users: DataFrame) -> DataFrame:
    return users.where("immediate_alerts_enabled")


def active_interests(interests: DataFrame, profiles: DataFrame) -> DataFrame:
    return interests.join(profiles.where("is_active").select("profile_id"), "profile_id", "left_semi")


def derived_queries(interests: DataFrame, first: int = 3) -> DataFrame:
    """Distinct first keywords of all interests, or the default queries when there are none."""
    found = interests.select(F.explode(F.slice("keywords", 1, first)).alias("query")).distinct()
    spark = interests.sparkSession
    fallback = spark.createDataFrame([(d,) for d in DEFAULT_QUERIES], "query string")
    n = found.select(F.count("*")).scalar()
    return found.unionByName(fallback.where(n == 0))


def primary_profiles(profiles: DataFrame) -> DataFrame:
    """First profile per user, as an aggregate."""
    whole = F.struct(*[F.col(c) for c in profiles.columns])
    first = profiles.groupBy(F.col("user_id").alias("_u")).agg(
        F.min_by(whole, F.struct("created_at", "profile_id")).alias("r"))
    return first.select("r.*")


def user_interests(users: DataFrame, profiles: DataFrame, interests: DataFrame) -> DataFrame:
    """User, primary profile and its interests."""
    return users.join(primary_profiles(profiles), "user_id").join(interests, "profile_id")


def missing_embeddings(papers: DataFrame, embedded: DataFrame, limit: int | None = None) -> DataFrame:
    out = papers.join(embedded.where("embedding IS NOT NULL").select("paper_id"), "paper_id", "left_anti")
    return out if limit is None else out.orderBy("paper_id").limit(limit)


def embed_missing(
    papers: DataFrame, embedded: DataFrame, model: Callable[[list[str]], np.ndarray], batch: int = 64, limit: int | None = None
) -> DataFrame:
    """``(paper_id, embedding)`` for papers without one: their title and abstract go to ``model``, ``batch`` texts at a time.

    ``limit`` takes the first papers by id only, for runs of a bounded length; the next run goes on with the rest.
    """
    text = paper_text(F.col("title"), F.col("abstract"))
    return missing_embeddings(papers, embedded, limit).select("paper_id", batch_embedder(model, batch)(text).alias("embedding"))


def stale_interests(interests: DataFrame, as_of: Column, days: int = 7, limit: int | None = None) -> DataFrame:
    old = F.col("embedding_updated_at").isNull() | (F.col("embedding_updated_at") < days_before(as_of, days))
    out = interests.where(old)
    return out if limit is None else out.orderBy("interest_id").limit(limit)


def job_history(jobs: DataFrame, job_type: str | None = None, limit: int | None = 20) -> DataFrame:
    out = jobs if job_type is None else jobs.where(F.col("job_type") == job_type)
    return out if limit is None else out.orderBy(F.col("started_at").desc(), "job_id").limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    """Runs, failures, durations and item counts per job type."""
    secs = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return jobs.withColumn("duration_seconds", secs).groupBy("job_type").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("max_duration"),
        F.sum("items_processed").alias("items_processed"), F.sum("items_created").alias("items_created"),
    )


def campaign_stats(log: DataFrame) -> DataFrame:
    """Per campaign run: users, sent, failed, papers, success rate, duration."""
    sent, failed = F.col("status") == "sent", F.col("status") == "failed"
    s = log.groupBy("run_id").agg(
        F.countDistinct("user_id").alias("users_processed"), F.count_if(sent).alias("emails_sent"),
        F.count_if(failed).alias("emails_failed"), F.sum(F.when(sent, F.col("n_papers")).otherwise(0)).alias("papers_included"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration_seconds"),
    )
    total = F.col("emails_sent") + F.col("emails_failed")
    return s.withColumn("success_rate", F.coalesce(F.try_divide(F.col("emails_sent"), total), F.lit(0.0)))
