"""Structured Streaming forms of ingest, alerts, timelines, item state and sent history.

Each function maps a streaming (or batch) DataFrame to another one with the operators of the batch
library; ``run_to`` writes a stream so that a repeated micro-batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litflow.functions import text as tx
from litflow.operators.digest import alerts
from litflow.operators.scoring import Interest, ScoringConfig, score_papers
from litflow.session import _ensure_checkpoint_dir
from litflow.sources.feeds import new_records

BATCH = "batch_id"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """A folder's files of one name as a stream, with the schema of the landed files."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)


def landed_stream(df: DataFrame, batches: int = 3, repeated: DataFrame | None = None) -> DataFrame:
    """A table landed as files, read as a stream of ``batches`` micro-batches; ``repeated`` rows land once more, as another one.

    A micro-batch has as many files as its share of the table has scan partitions, so a task's rows do not grow with the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "landed")
    files = max(1, -(-df.rdd.getNumPartitions() // batches))
    df.repartition(batches * files).write.parquet(path)
    if repeated is not None:
        repeated.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to(
    stream: DataFrame, path: str, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None
) -> None:
    """Processes everything available; micro-batch N owns the folder ``batch_id=N``, so a retry after
    a lost driver overwrites its own output only."""

    def put(batch: DataFrame, n: int) -> None:
        out = batch if prepare is None else prepare(batch, n)
        out.write.mode("overwrite").parquet(f"{path}/data/{BATCH}={n}")

    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(put).start()
    )
    q.awaitTermination()


def read_out(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def unique_records(papers: DataFrame, key: str = "content_hash", time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """First record per key inside the watermark; state older than it is dropped."""
    return papers.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(papers: DataFrame, path: str, store: DataFrame | None = None, delay: str = "1 hour") -> None:
    """Continuous ingest: dedupe within the watermark, then keep what neither ``store`` nor an
    earlier batch holds. ``papers`` has ``doi``, ``content_hash``, ``ord`` and ``created_at``."""
    spark = papers.sparkSession

    def fresh(batch: DataFrame, n: int) -> DataFrame:
        out = batch if store is None else new_records(batch, store)
        if n > 0:
            held = read_out(spark, path).where(F.col(BATCH) < n)
            out = new_records(out, held.select("doi", "content_hash"))
        return out

    run_to(unique_records(papers, delay=delay), path, prepare=fresh)


def stream_alerts(
    papers: DataFrame, interests: Sequence[Interest], as_of, min_score: float = 0.7,
    cfg: ScoringConfig | None = None, time: str = "created_at", lookback: str = "1 hour", keep: Sequence[str] = ("paper_id",),
) -> DataFrame:
    """Papers that score high for an interest, each once; rows later than the look-back are dropped."""
    once = papers.withWatermark(time, lookback).dropDuplicatesWithinWatermark(["paper_id"])
    return alerts(score_papers(once, interests, as_of, cfg, keep), min_score)


def stream_timeline(
    papers: DataFrame, time: str = "created_at", size: str = "1 day", slide: str | None = None, delay: str = "2 days"
) -> DataFrame:
    """Uses of each word and word pair per tumbling (or sliding) window."""
    toks = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.TIMELINE_STOP, 3)
    rows = papers.withWatermark(time, delay).select(time, toks.alias("t")).select(
        time, F.explode(F.concat("t", tx.bigrams(F.col("t")))).alias("term"))
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(window.alias("w"), "term").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "term", "n")


def _panes(size: str, slide: str | None) -> bool:
    """True if a sliding window is made of whole steps, so that counts of steps add up to its own."""
    try:
        return slide is not None and pd.Timedelta(size) % pd.Timedelta(slide) == pd.Timedelta(0)
    except ValueError:
        return False


def run_timeline(papers: DataFrame, path: str, time: str = "created_at", size: str = "1 day", slide: str | None = None) -> None:
    """``stream_timeline`` without state: a micro-batch leaves its own counts, which ``timeline`` adds up.

    There is nothing to keep between micro-batches, so no row is too late. A sliding window of whole steps is stored by its
    steps, not once for each window that a row is in.
    """
    pane = (slide, None) if _panes(size, slide) else (size, slide)
    run_to(papers, path, prepare=lambda batch, n: stream_timeline(batch, time, *pane))


def timeline(out: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Uses of each term per window over all micro-batches that ``run_timeline`` wrote with the same windows."""
    if _panes(size, slide):
        out = out.select(F.window("window_start", size, slide)["start"].alias("window_start"), "term", "n")
    return out.groupBy("window_start", "term").agg(F.sum("n").alias("n"))


def run_alerts(
    papers: DataFrame, path: str, interests: Sequence[Interest], min_score: float = 0.7, cfg: ScoringConfig | None = None,
    time: str = "created_at", lookback: str = "1 hour", keep: Sequence[str] = ("paper_id",),
) -> None:
    """``stream_alerts`` with a clock that moves: a micro-batch is scored as of the newest event time seen up to it.

    Each batch leaves its clock (one row) under ``clock/batch_id=N`` next to its output, so a repeated batch and a
    restarted stream take up the one before. A batch without rows alerts on nothing and keeps the clock. Alerts carry
    the ``as_of`` they were judged by.
    """
    once = papers.withWatermark(time, lookback).dropDuplicatesWithinWatermark(["paper_id"])
    spark = papers.sparkSession

    def judge(batch: DataFrame, n: int) -> DataFrame:
        clock = batch.agg(F.max(time).alias("as_of"))
        if n > 0:
            clock = clock.unionByName(spark.read.parquet(f"{path}/clock/{BATCH}={n - 1}")).agg(F.max("as_of").alias("as_of"))
        clock.write.mode("overwrite").parquet(f"{path}/clock/{BATCH}={n}")
        now = spark.read.parquet(f"{path}/clock/{BATCH}={n}").select("as_of").scalar()
        return alerts(score_papers(batch, interests, now, cfg, keep), min_score).withColumn("as_of", now)

    run_to(once, path, prepare=judge)


STATE_KINDS = ("status", "rating", "priority", "list_id", "archived", "read")


TAG, UNTAG = "tag", "untag"


def item_state(log: DataFrame, key: str = "item_id") -> DataFrame:
    """Latest value of each attribute per item from an event log ``(item, kind, value, ts, seq)``, and its ``tags``.

    ``tag`` and ``untag`` events add and remove one tag; the later of them by (ts, seq) holds, in whatever order they
    arrive. An item without events is no row, one without tags has an empty list; null and empty tags are left out.
    """
    return folded(item_parts(log, key), key)


def item_parts(log: DataFrame, key: str = "item_id") -> DataFrame:
    """The state in parts: one row with an item's attributes (null ``tag``) and one for each tag it ever had (``held``).

    A constant-size aggregate per part: the same query folds a table and runs as a stream in update mode; an item that
    has most of the events is combined before the shuffle. ``folded`` makes rows of items of it.
    """
    at = F.struct("ts", "seq")
    tags = F.col("kind").isin(TAG, UNTAG)
    log = log.where(~tags | (F.coalesce("value", F.lit("")) != "")).withColumn("tag", F.when(tags, F.col("value")))

    def latest(kind: str):
        return F.max_by("value", F.when(F.col("kind") == kind, at)).alias(kind)

    started = (F.col("kind") == "status") & (F.col("value") == "reading")
    finished = (F.col("kind") == "status") & (F.col("value") == "finished")
    return log.groupBy(key, "tag").agg(
        F.max_by(F.col("kind") == TAG, at).alias("held"), *[latest(k) for k in STATE_KINDS],
        F.max(F.when(started, F.col("ts"))).alias("started_at"), F.max(F.when(finished, F.col("ts"))).alias("finished_at"),
        F.count_if(F.col("kind") == "note").alias("n_notes"), F.count_if(F.col("kind") == "highlight").alias("n_highlights"),
    )


def folded(parts: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per item from its parts: the attributes, and the tags it holds in order."""
    counts = ("n_notes", "n_highlights")
    rest = [c for c in parts.columns if c not in (key, "tag", "held", *counts)]
    return parts.groupBy(key).agg(
        *[F.max(c).alias(c) for c in rest], *[F.sum(c).alias(c) for c in counts],
        F.sort_array(F.collect_list(F.when(F.col("held") & F.col("tag").isNotNull(), F.col("tag")))).alias("tags"),
    )


def annotations(log: DataFrame, key: str = "item_id") -> DataFrame:
    """Notes, skip reasons and highlights, one row each, newest to be shown first."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm")
    text = (
        F.when(F.col("kind") == "note", F.concat(F.lit("["), stamp, F.lit("] "), "value"))
        .when((F.col("kind") == "skip_reason") & (F.col("value") != ""), F.concat(F.lit("Skipped: "), "value"))
        .when(F.col("kind") == "highlight", F.col("value"))
    )
    return log.select(key, "kind", text.alias("text"), "ts", "seq").where(F.col("text").isNotNull())


def latest_state(out: DataFrame, *keys: str) -> DataFrame:
    """Current row per key (``item_id`` if none is named) from the upserts of all micro-batches."""
    whole = F.struct(*[F.col(c) for c in out.columns if c != BATCH])
    by = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys or ("item_id",))]
    return out.groupBy(*by).agg(F.max_by(whole, BATCH).alias("r")).select("r.*")


def sent_once(sent: DataFrame, keys: Sequence[str] = ("paper_key",), time: str = "sent_at", retention: str = "30 days") -> DataFrame:
    """First send per key; a key may be sent again once it has left the retention period."""
    return sent.withWatermark(time, retention).dropDuplicatesWithinWatermark(list(keys))
