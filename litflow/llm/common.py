"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litflow.session import cut_lineage, discard, ship_package, small_batches, stored

__all__ = ["cut_lineage", "discard", "ship_package", "stored", "utf8", "slices", "prefix_sums", "text_or_empty", "lowered", "words_of"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks so that long arrays are not copied once per element."""

    def scan(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            xs, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        )["out"]

    n = F.floor((F.size(values) + (block - 1)) / F.lit(block)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda b: F.slice(values, b * block + 1, block))
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x))
    starts = scan(sums, F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(blocks, starts, scan))


# ---------------------------------------------------------------- Arrow texts as byte arrays


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and where each row starts (one entry more than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most ``most`` bytes of text each (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def words_of(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (one entry more than rows); words end with their row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    member = in_word[raw]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~member[:-1]
    fresh[at] = True  # a row's first byte continues nothing
    starts = np.flatnonzero(member & fresh[:n])
    over = np.ones(n + 1, bool)
    over[:n] = ~member
    over[at] = True
    ends = np.flatnonzero(member & over[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


_BASE = 0x9E3779B97F4A7C15


def span_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``span_hashes``: sums of the bytes, each times a power of the base, and the inverse powers."""
    n = len(raw)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return scrambled((sums[ends] - sums[starts]) * down[starts])


def scrambled(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def plus(fields, ddl: str):
    """A schema of these fields and those of a DDL string."""
    from pyspark.sql import types as T

    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash: all but those with a map or a variant inside."""
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def start(spark) -> None:
    """Ships the package, and keeps Arrow batches small."""
    ship_package(spark)
    small_batches(spark)
