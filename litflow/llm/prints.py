"""Document fingerprints by consistent weighted sampling of weighted terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litflow.llm.common import lowered, slices, stored, utf8, words_of
from litflow.llm.leaks import word_hashes
from litflow.llm.near_copies import SPACE

SAMPLES = 64
#: Text taken at once; samples of its terms take about 100 times as much memory.
PART_BYTES = 1 << 20
#: Terms whose samples are drawn, or rows of samples that are compared, at once.
TERMS = 4096


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each 64-bit hash."""
    half = np.float32(2.0**-24)
    return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * half, (((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * half


def draws(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and c, gamma with shape 2, (c as its logarithm) and b, uniform, of each term and sample: fixed by the term."""
    r, log_c, b = (np.empty((len(terms), samples), np.float32) for _ in range(3))
    number = np.arange(samples, dtype=np.uint64)[None, :] * np.uint64(3)
    golden = np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(terms), TERMS):
        seed = terms[lo : lo + TERMS, None] + number * golden
        x, y = _uniform(_mixed(seed))
        r[lo : lo + TERMS] = -np.log(x * y)
        x, y = _uniform(_mixed(seed + golden))
        log_c[lo : lo + TERMS] = np.log(-np.log(x * y))
        b[lo : lo + TERMS] = _uniform(_mixed(seed + golden + golden))[0]
    return r, log_c, b


def signatures(raw: np.ndarray, at: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16 bits for each row and sample. Terms are words (A-Z lower-cased), weighted by how often the text has them.

    For each sample a term with weight w has t = floor(ln w / r + b), ln y = r (t - b) and a = c / (y e^r); the term
    with the smallest a is drawn together with t. Two texts draw the same with the probability of their generalised
    Jaccard similarity: the sum of the smaller weights over the sum of the larger. A text without words draws nothing.
    """
    raw = lowered(raw)
    starts, ends, rows = words_of(raw, at, ~SPACE)
    out = np.full((len(at) - 1, samples), 0xFFFF, np.uint16)
    if not len(starts):
        return out
    terms, word = np.unique(_mixed(word_hashes(raw, starts, ends)), return_inverse=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    pair, weight = np.unique(row * len(terms) + word, return_counts=True)
    row, term = pair // len(terms), pair % len(terms)
    r, log_c, b = draws(terms, samples)
    once = log_c + r * b - r  # ln a at weight 1: t is 0
    log_w = np.log(weight).astype(np.float32)
    lo = 0
    bounds = np.searchsorted(row, np.arange(len(at)))
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + TERMS, side="right")) - 1)
        x, y = bounds[lo], bounds[hi]
        mine, full = term[x:y], np.flatnonzero(bounds[lo + 1 : hi + 1] > bounds[lo:hi])
        if y > x:
            value = once[mine]
            more = np.flatnonzero(weight[x:y] > 1)
            if len(more):
                m = mine[more]
                t = np.floor(log_w[x:y][more][:, None] / r[m] + b[m])
                value[more] = log_c[m] - r[m] * (t - b[m]) - r[m]
            # the smallest value and where it stands, in one number
            bits = value.view(np.uint32)
            ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
            packed = (ordered.astype(np.uint64) << np.uint64(32)) | np.arange(y - x, dtype=np.uint64)[:, None]
            best = (np.minimum.reduceat(packed, bounds[lo:hi][full] - x, axis=0) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            who, k = mine[best], np.arange(samples)[None, :]
            t = np.floor(log_w[x:y][best] / r[who, k] + b[who, k]).astype(np.int64).view(np.uint64)
            code = _mixed(terms[who] + t * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(48)
            out[lo + full] = code.astype(np.uint16)
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _hex(codes: np.ndarray) -> list[str]:
    return [c.tobytes().hex() for c in codes.astype(">u2")]


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(texts: list[str], codes: np.ndarray, following: list[str], next_codes: np.ndarray) -> list:
    edited = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
    # long texts go in parts, like all others
    batch = pa.RecordBatch.from_arrays([pa.array(edited, pa.large_string())], ["text"])
    changed = np.concatenate([signatures(*utf8(p.column(0))) for p in slices([batch], "text", PART_BYTES)])
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(_hex(codes)), pa.array(_hex(changed)), pa.array(likeness(codes, changed)), pa.array(likeness(codes, next_codes)),
    ]


FOUND = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split(" ")[0] for f in FOUND.split(", ")]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint``: 64 samples of 16 bits each as hex. Null text: empty. Likeness is the share of equal samples."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, text, PART_BYTES):
            codes = signatures(*utf8(part.column(part.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_hex(codes))], [*part.schema.names, "fingerprint"])

    from litflow.llm.common import plus

    return kept.mapInArrow(run, plus(kept.schema.fields, "fingerprint string"))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    The next document follows in order of id (null first, equal ids by a hash of the text; equal rows in any order);
    the first follows the last, and a single one itself. Null text is empty. Two empty texts are alike (1).

    Documents are ordered over all partitions once. Inside a partition each row meets the next as the rows stream
    past; the first and last row of each partition are written aside and meet in a join over partition numbers.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        pid = TaskContext.get().partitionId()
        id_kind = None
        held: tuple | None = None

        def pack(kind: int, ids: list, texts: list[str | None], found: list | None) -> pa.RecordBatch:
            n = len(ids)
            blank = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            head = [pa.array([kind] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array(ids, id_kind), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*head, *(found or blank)], ["kind", "pid", "id", "text", *NAMES])

        for part in slices(batches, "text", PART_BYTES):
            id_kind = part.column(0).type
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            codes = signatures(*utf8(part.column(1)))
            if held is None:
                yield pack(1, [None], texts[:1], None)
            else:
                ids, texts, codes = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], codes])
            if len(ids) > 1:
                yield pack(0, ids[:-1], [None] * (len(ids) - 1), _compare(texts[:-1], codes[:-1], texts[1:], codes[1:]))
            held = (ids[-1], texts[-1], codes[-1:])
        if held is not None:
            yield pack(2, [held[0]], [held[1]], None)

    made = stored(ordered.select("id", "text").mapInArrow(run, f"kind int, pid int, id {id_type}, text string, {FOUND}"))
    heads = made.where("kind = 1").select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    order = W.orderBy("pid")  # one row per partition
    turns = made.where("kind = 1").select("pid").select("pid", F.coalesce(F.lead("pid").over(order), F.min("pid").over(W.partitionBy())).alias("next_pid"))
    ends = made.where("kind = 2").select("pid", "id", "text").join(turns, "pid").join(heads, "next_pid").select("id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices([batch], "text", PART_BYTES):
                one, two = signatures(*utf8(part.column(1))), signatures(*utf8(part.column(2)))
                found = _compare(part.column(1).to_pylist(), one, part.column(2).to_pylist(), two)
                yield pa.RecordBatch.from_arrays([part.column(0), *found], ["id", *NAMES])

    last = ends.mapInArrow(finish, f"id {id_type}, {FOUND}")
    return made.where("kind = 0").select("id", *NAMES).unionByName(last).withColumnRenamed("id", doc_id)
