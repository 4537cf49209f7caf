"""Centroid clustering of integer vectors: distances are gathers from tables of squared differences."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litflow.llm.common import stored

#: Vectors of one block: their codes take 2 bytes a component.
BLOCK = 4_096
#: Components count as at most this much, so that a distance of ``64`` of them fits into a long.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """True if an array has no null, NaN or infinite entry; null for a null array."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, as longs; beyond ``LIMIT`` they count as ``LIMIT``."""
    limit = F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, limit), -limit)))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, all ``width`` long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pack(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors: (ids, codes, places, values).

    ``values`` lists the sorted integers that occur in each dimension of the block, dimension after dimension, and
    ``places`` where each dimension starts; ``codes`` has the number of each vector's value, dimension after dimension.
    Vectors are only cut into blocks inside the partitions that they already have: nothing is shuffled.
    """
    kind = vectors.schema["id"].dataType

    def run(batches):
        held, size = [], 0

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = table.column("id").combine_chunks()
            x = np.concatenate([rows_of(c, width) for c in table.column("x").chunks])
            found = [np.unique(x[:, d], return_inverse=True) for d in range(width)]
            places = np.cumsum([0, *[len(v) for v, _ in found]])
            codes = np.stack([c.astype(np.uint16) for _, c in found])
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            packed = [codes.tobytes(), places.astype(np.int64).tobytes(), np.concatenate([v for v, _ in found]).tobytes()]
            return pa.RecordBatch.from_arrays([ids, *[pa.array([p], pa.binary()) for p in packed]], ["ids", "codes", "places", "values"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == BLOCK:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return vectors.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL("codes binary, places binary, `values` binary").fields]))


class Block:
    """One row of ``pack``."""

    def __init__(self, codes: bytes, places: bytes, values: bytes) -> None:
        self.places, self.values = np.frombuffer(places, np.int64), np.frombuffer(values, np.int64)
        self.width = len(self.places) - 1
        self.codes = np.frombuffer(codes, np.uint16).reshape(self.width, -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, the smaller in a tie, and the squared distance."""
        dimension = np.repeat(np.arange(self.width), np.diff(self.places))
        table = self.values[:, None] - centroids.T[dimension]  # a row for each occurring value, a column for each centroid
        np.multiply(table, table, out=table)
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for d in range(self.width):
            total += table[self.places[d] + self.codes[d].astype(np.int64)]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid has, and the sums of their components: counts of each value times the value."""
        out = np.zeros((k, self.width), np.int64)
        for d in range(self.width):
            values = self.values[self.places[d] : self.places[d + 1]]
            times = np.bincount(best * len(values) + self.codes[d], minlength=k * len(values)).reshape(k, len(values))
            out[:, d] = times @ values
        return np.bincount(best, minlength=k), out


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; an empty one stays. Reaches the driver as one row of sums for each centroid."""
    k, width = len(centroids), len(centroids[0])
    given = np.array(centroids, np.int64)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(*row)
                n, s = block.sums(block.nearest(given)[0], k)
                count += n
                total += s
        sums = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * width, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(count), sums], ["number", "n", "sums"])

    parts = blocks.select("codes", "places", "values").mapInArrow(run, "number int, n bigint, sums array<bigint>").where("n > 0")
    added = parts.select("number", "n", F.posexplode("sums").alias("d", "s")).groupBy("number", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = [list(c) for c in centroids]
    for r in added.collect():  # at most as many rows as the centroids have components
        new[r["number"]][r["d"]] = int(r["s"]) // r["n"]
    return new


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1_024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Lloyd's rounds in whole numbers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector.

    Kept are vectors with ``width`` components, none null or non-finite, each as ``floor(scale * x)``. The first
    centroids are the ``k`` vectors with the smallest hash of ``seed:vec_id`` (ties: the smaller vector); then each
    round assigns all vectors to the nearest centroid (ties: the smaller number) and moves each centroid that has
    any to the floor of their mean. Fewer vectors than ``k`` give fewer centroids; none give no rows. A null id counts
    as the text ``null`` in the hash. Repeated rows are rows of their own, other columns are not looked at. Components
    beyond ``LIMIT`` (2^17 before scaling) count as ``LIMIT``.

    Vectors are packed once into blocks with the values that occur in each dimension. In each round a task tabulates
    (value - centroid)^2 for these and adds up gathered entries; only sums of a task, ``k`` rows, are shuffled.
    """
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("x")).where((F.size("x") == width) & finite(F.col("x")))
    exact = kept.select("id", whole(F.col("x"), scale).alias("x"))
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = exact.select(turn.alias("turn"), "x").orderBy("turn", "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in first]
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), *T.StructType.fromDDL("cluster int, distance bigint").fields])
    if not centroids:
        return _result(vectors.sparkSession.createDataFrame([], schema), [], vec_id)
    blocks = stored(pack(exact, width))
    for _ in range(rounds):
        moved = _moved(blocks, centroids)
        if moved == centroids:  # nothing moves in any later round either
            break
        centroids = moved
    given = np.array(centroids, np.int64)

    def assign(batches):
        for batch in batches:
            for i, row in enumerate(zip(*(batch.column(name).to_pylist() for name in ("codes", "places", "values")), strict=True)):
                best, distance = Block(*row).nearest(given)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return _result(stored(blocks.mapInArrow(assign, schema)), centroids, vec_id)


def _result(assigned: DataFrame, centroids: list[list[int]], vec_id: str) -> DataFrame:
    """Inertias and digests of the clusters beside each vector; the side that is broadcast has a row for each centroid."""
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(i, s, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in per.items()]
    named = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1_024, seed: int = 3) -> str:
    """The same in DuckDB's SQL, a step for each round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, embedding, sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')) AS h FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, h, d, floor({scale} * embedding[d]::DOUBLE)::BIGINT AS x FROM kept, range(1, {width + 1}) t(d))",
        f"c0 AS MATERIALIZED (SELECT n, d, x AS v FROM parts JOIN (SELECT h, row_number() OVER (ORDER BY h) - 1 AS n FROM kept ORDER BY h LIMIT {k}) f USING (h))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(n, (s, n)) AS n, min(s) AS s FROM
                (SELECT vec_id, n, sum((x - v) * (x - v))::BIGINT AS s FROM parts JOIN c{i} USING (d) GROUP BY vec_id, n) GROUP BY vec_id)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT n, d, sum(x)::BIGINT AS t, count(*) AS m FROM parts JOIN a{i} USING (vec_id) GROUP BY n, d),
                c{i + 1} AS MATERIALIZED (SELECT c.n, c.d, CASE WHEN m IS NULL THEN v ELSE (t - ((t % m) + m) % m) // m END AS v
                FROM c{i} c LEFT JOIN m{i} USING (n, d))"""
            )
    last = f"a{rounds}"
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, n::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY n))::BIGINT AS cluster_inertia,
               (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM {last} JOIN (SELECT n, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY n) USING (n)"""
