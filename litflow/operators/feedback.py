"""Reader feedback: statistics, keyword ratings, unread papers, weekly wrap-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.functions.text import strip
from litflow.operators.history import days_before


def feedback_stats(feedback: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: counts, rates, and mean relevance by rating (NULL where nothing was rated)."""
    up, down = F.col("rating") == "up", F.col("rating") == "down"
    s = feedback.where(F.col("sent_at") >= days_before(as_of, days)).agg(
        F.count("*").alias("total_sent"),
        F.count_if("read").alias("total_read"),
        F.count_if(up).alias("thumbs_up"),
        F.count_if(down).alias("thumbs_down"),
        F.avg(F.when(up, F.col("relevance_score"))).alias("avg_score_up"),
        F.avg(F.when(down, F.col("relevance_score"))).alias("avg_score_down"),
    )
    return s.withColumns({
        "read_rate": F.coalesce(F.try_divide("total_read", "total_sent"), F.lit(0.0)),
        "positive_rate": F.coalesce(
            F.try_divide(F.col("thumbs_up"), F.col("thumbs_up") + F.col("thumbs_down")), F.lit(0.0)
        ),
    })


def keyword_feedback(feedback: DataFrame, min_len: int = 4) -> DataFrame:
    """Up and down votes per distinct title word."""
    word = F.explode(F.array_distinct(F.split(strip(F.lower("title")), r"\s+")))
    return (
        feedback.where(F.col("rating").isNotNull())
        .select("rating", word.alias("word"))
        .where(F.length("word") >= min_len)
        .groupBy("word")
        .agg(
            F.count_if(F.col("rating") == "up").alias("up"),
            F.count_if(F.col("rating") == "down").alias("down"),
        )
    )


def unread(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return feedback.where(~F.col("read") & (F.col("sent_at") > days_before(as_of, days)))


def weekly_wrapup(feedback: DataFrame, as_of: Column, n: int = 10, by: str | None = None) -> DataFrame:
    """The ``n`` most relevant unread papers of the last week, overall or per ``by``."""
    rows = unread(feedback, as_of, 7)
    order = [F.col("relevance_score").desc(), F.col("paper_id")]
    if by is None:
        return rows.orderBy(*order).limit(n)
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
