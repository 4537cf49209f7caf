"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litflow.llm.common import cut_lineage, hashable, text_or_empty

WORDS = "[^\\x20\\x09-\\x0D]+"
#: A document's expected copies are held as whole 2**-24ths: their sums do not depend on the order of addition.
UNIT_BITS = 24


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("bigint")


def _hashed(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds ``target`` to one row per source (``key``, ``is_null``, ``source_size``).

    Sources by code point, null last, take the weights in turn. Shares stop at ``cap`` times the source; the excess
    goes to the others by weight until none is above. The level at which that ends is the largest of the levels got
    by filling up the first sources in order of cap per weight. One row per source meets in one task here.
    """
    turn = F.row_number().over(W.orderBy("is_null", "key")) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in weights]), (turn % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "is_null", "key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("weight", "cap", "ratio", "level")


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix", doc_id: str = "doc_id",
    text: str = "text", source: str = "source", size: Column | None = None, bucket_rows: int = 50_000,
) -> DataFrame:
    """Every row with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` = copies * size.

    Within a source, documents stand in order of size class, then bucket, then size. Each adds its expected copies
    (target / source_size, at most ``cap``) to a running sum that starts at one random offset of the source; it is
    emitted once for each whole number the sum crosses. Neighbours are alike in size, so the words taken miss the
    target by about the largest document at most.

    The running sum is never taken in one task: rows are counted by (source, size class, bucket), the counts are
    summed over the few classes and over the buckets of a class, and only the ranks inside a bucket (about
    ``bucket_rows`` rows) come from a window over rows. Equal sizes spread over buckets by a hash of the id.

    Null text has size 0, a null source is a source of its own. Rows that are equal in every column are
    interchangeable, each gets its own share. A source without words has target 0 and emits nothing; an empty table
    gives no rows. A column that bears the name of an output is replaced.
    """
    outputs = ("size", "source_size", "target", "copies", "taken")
    rest = F.struct(*[F.col(c) for c in docs.columns if c.lower() not in outputs]).alias("row")
    words = word_count(text) if size is None else size
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    buckets = max(1, -(-docs.count() // bucket_rows))
    rows = docs.select(
        rest, words.alias("size"), F.col(doc_id).alias("id"), F.xxhash64(*hashable(docs)).alias("tie"),
        F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("key"),
        F.pmod(_hashed(id_text, 8), F.lit(buckets)).alias("bucket"),
    )
    bits = "length(bin(size))"
    rows = rows.withColumn("class", F.expr(f"{bits} * 4 + (shiftright(size, greatest({bits} - 3, 0)) & 3)").cast("int"))

    groups = cut_lineage(rows.groupBy("key", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sizes = groups.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("is_null", F.col("key") == "")
    unit = F.lit(1 << UNIT_BITS)
    plan = source_targets(sizes, weights, cap).select(
        "key", "source_size", "target",
        F.when(F.col("source_size") > 0, F.round(F.least(F.lit(float(cap)), F.try_divide(F.col("target"), F.col("source_size"))) * unit)).otherwise(0).cast("bigint").alias("step"),
        _hashed(F.concat(F.lit(seed), F.col("key")), UNIT_BITS // 4).alias("offset"),
    )
    earlier = W.unboundedPreceding, -1
    classes = groups.groupBy("key", "class").agg(F.sum("n").alias("n")).select(
        "key", "class", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy(F.desc("class")).rowsBetween(*earlier)), F.lit(0)).alias("before_class")
    )
    starts = (
        groups.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("key", "class").orderBy("bucket").rowsBetween(*earlier)), F.lit(0)))
        .join(classes, ["key", "class"]).join(plan, "key")
        .select("key", "class", "bucket", "source_size", "target", "step", "offset", (F.col("before") + F.col("before_class")).alias("before"))
    )
    rank = F.row_number().over(W.partitionBy("key", "class", "bucket").orderBy(F.desc("size"), "id", "tie"))
    upto = (F.col("before") + F.col("rank")) * F.col("step") + F.col("offset")
    return (
        rows.withColumn("rank", rank).join(starts, ["key", "class", "bucket"])
        .withColumn("copies", F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("step"), UNIT_BITS))
        .select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy: what the mixture holds."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
nb AS (SELECT greatest(1, CAST(ceil(count(*) / 50000.0) AS BIGINT)) AS n FROM d),
k AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT n FROM nb) AS bucket,
  length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS class FROM d),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY key),
w AS (SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY key = '', key) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
c AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER p AS BIGINT), 0) AS DOUBLE)
  / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER p AS BIGINT), 0) AS DOUBLE) AS level FROM c
  WINDOW p AS (ORDER BY ratio, key = '', key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l) * weight) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(least(3e0, target / source_size) * 16777216) AS BIGINT) END AS step, CAST('0x' || substr(md5('mix' || key), 1, 6) AS BIGINT) AS off FROM t),
r AS (SELECT k.*, row_number() OVER (PARTITION BY key ORDER BY class DESC, bucket, size DESC, doc_id) AS rank FROM k),
e AS (SELECT doc_id, size, source_size, target, rank * step + off AS upto, step FROM r JOIN u USING (key)),
x AS (SELECT *, (upto >> 24) - ((upto - step) >> 24) AS copies FROM e)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM x
"""
