"""Session helpers: builder for local runs and lineage cutting for iterative jobs."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "litflow", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter configures the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="litflow-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and the plan stays short."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet under the shared checkpoint folder and read again: for results that are used several times."""
    import uuid

    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that no later step reads: a loop gives back a round's disk in the next one."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more: it does so when the driver collects
    its garbage, which a driver with little to do puts off while the disks fill."""
    import gc

    from pyspark import SparkContext

    gc.collect()
    sc = SparkContext._active_spark_context
    if sc is not None:
        sc._jvm.System.gc()


def bit_map(hashes: DataFrame) -> Callable[[Column], Column]:
    """A condition on ``xxhash64`` values that holds for all of ``hashes(h)`` and for few others, without a join: rows that
    no partner can have are dropped before they are shuffled. The low bits of the hashes are set in a map of at most
    2^27 bits, one row that each task reads. ``h`` needs at least 27 of the hash's low bits."""
    import numpy as np
    import pyarrow as pa

    def one(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    held = stored(hashes.distinct())
    bits = 1 << min(27, max(16, (16 * held.count()).bit_length()))
    at = lambda h: F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    words = held.groupBy(at(F.col("h")).alias("at")).agg(F.bit_or(one(F.col("h"))).alias("word")).toArrow()  # bits / 64 rows at most
    whole = np.zeros(bits // 64, dtype=np.int64)
    whole[words["at"].to_numpy()] = words["word"].to_numpy()
    discard(held)
    row = stored(held.sparkSession.createDataFrame(pa.table({"words": pa.array([whole], type=pa.list_(pa.int64()))})))
    return lambda h: F.get(row.select("words").scalar(), at(h)).bitwiseAND(one(h)) != 0


def task_count(spark: SparkSession) -> int:
    """Tasks over which ``spread`` deals rows."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt in turn over all shuffle partitions, whatever their keys, for heavy work on each row: a file
    with one row group is read by one task, however many rows it has and whatever the number of its splits. Rows that
    every core has a fair part of already stay where they are."""
    spark = df.sparkSession
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]  # a row for each task
    if held and max(held) * spark.sparkContext.defaultParallelism <= 2 * sum(held):
        return df
    return df.repartition(task_count(spark))


#: Rows and bytes of an Arrow batch at most, where Python works on texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: a batch is held by the executor and by Python at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def row_count_within(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application.

    Needed when the application was not submitted with ``--py-files``: workers import the package
    by name and do not share the driver's search path.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_litflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="litflow-zip-"), "litflow.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("litflow", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._litflow_shipped = True
