"""Suffix-array dedup: depth-limited radix sorts find every string of the threshold length that occurs twice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import cut_lineage, plus, slices, stored, text_or_empty, utf8

#: Text taken at once; its hashes take about 100 times as much memory.
PART_BYTES = 1 << 20
#: Contexts sorted at once, and contexts of one anchor beyond which its windows are split before the sort.
SORT_ROWS = 16_384
GROUP_ROWS = 32_768

BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A value for each byte, so that sums of powers do not cancel.
BYTE_VALUES = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size, r = 1, values
    while size * 2 <= width:
        r = np.minimum(r[:-size], r[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(r[:n], r[width - size : width - size + n])


class Anchors:
    """The anchor of each window: its k-gram with the smallest hash, the first of equal ones.

    Equal windows have their anchor at the same place, so it is enough to compare windows around equal anchors.
    ``row, at, gram, first, last``: an anchor's row, place, k-gram hash, and the first and last window that it stands
    for. In a row whose anchors lie dense (a short period), windows that occur before in the row are left out and
    listed in ``spans`` (row, start, end) together with what they repeat.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        none = np.zeros(0, np.int64)
        self.row = self.at = self.first = self.last = none
        self.gram, self.spans = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
        n, width = len(raw), length - gram + 1
        if n < length:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * _powers(BASE, n), out=sums[1:])
        back = _powers(BASE_INVERSE, n)
        hashed = _mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
        place = np.arange(len(hashed), dtype=np.uint64)
        low = _lowest((hashed & np.uint64(0xFFFFFFFF00000000)) | place, width)
        start = np.arange(n - length + 1)
        row = np.searchsorted(offsets, start, side="right") - 1
        whole = start + length <= offsets[row + 1]
        start, row, place = start[whole], row[whole], (low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(start):
            return
        fresh = self._fresh(start, row, place)
        dense = np.bincount(row[fresh], minlength=len(offsets)) > 64 + 8 * np.diff(np.append(offsets, n)) // width
        if dense.any():
            windows = np.flatnonzero(dense[row])
            value = _mixed((sums[start[windows] + length] - sums[start[windows]]) * back[start[windows]])
            order = np.lexsort((windows, value, row[windows]))
            same = (value[order[1:]] == value[order[:-1]]) & (row[windows[order[1:]]] == row[windows[order[:-1]]])
            again, repeated = np.append(False, same), np.append(same, False) | np.append(False, same)
            local = np.sort(windows[order[repeated]])
            cut = np.flatnonzero(np.append(True, (start[local[1:]] != start[local[:-1]] + 1) | (row[local[1:]] != row[local[:-1]]))) if len(local) else none
            ends = np.append(cut[1:], len(local)) - 1 if len(local) else none
            if len(local):
                self.spans = np.column_stack([row[local[cut]], start[local[cut]], start[local[ends]] + length])
            keep = np.ones(len(start), bool)
            keep[windows[order[again]]] = False
            start, row, place = start[keep], row[keep], place[keep]
            fresh = self._fresh(start, row, place)
        head = np.flatnonzero(fresh)
        self.row, self.at, self.first, self.last = row[head], place[head], start[head], start[np.append(head[1:], len(start)) - 1]
        self.gram = hashed[self.at]

    @staticmethod
    def _fresh(start: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        return fresh


# ---------------------------------------------------------------- sort


def radix_order(group: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by group, then by their first ``depth`` bytes, and the equal bytes of neighbours (-1 between groups).

    A string is ``size`` bytes of ``data`` from ``begin`` on, forwards (step 1) or backwards (-1), then zeros. Most
    significant digits of eight bytes come first; a pass sorts only strings that are equal so far.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = group[order[1:]] != group[order[:-1]]
    common = np.full(n, depth, np.int64)
    common[fresh] = -1
    for done in range(0, depth, 8):
        sizes = np.diff(np.append(np.flatnonzero(fresh), n))
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(rows):
            break
        item = order[rows]
        digit = np.zeros(len(rows), np.uint64)
        for j in range(done, done + 8):
            inside = j < np.minimum(size[item], depth)
            byte = data[np.where(inside, begin[item] + step * j, 0)].astype(np.uint64)
            digit = (digit << np.uint64(8)) | np.where(inside, byte, np.uint64(0))
        block = np.cumsum(fresh[rows])
        again = np.lexsort((digit, block))
        order[rows], digit, block = item[again], digit[again], block[again]
        differs = np.zeros(len(rows), bool)
        differs[1:] = (digit[1:] != digit[:-1]) & (block[1:] == block[:-1])
        at = np.flatnonzero(differs)
        gap = digit[at] ^ digit[at - 1]
        leading = np.zeros(len(at), np.int64)
        for k in range(1, 8):  # bytes that agree: the difference fits into the last ones
            leading += gap < (np.uint64(1) << np.uint64(64 - 8 * k))
        common[rows[at]] = done + leading
        fresh[rows[at]] = True
    return order, common


def repeated_windows(group: np.ndarray, data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (item, first, last) of windows that another item of the group has as well.

    ``anchor, first, last`` are places in ``data``. A window that starts d before the anchor is the d bytes before it
    and ``length - d`` from it on: items are sorted once to the right and once to the left, and two windows are equal
    if both their parts fall into the same run of the sorted order at that depth.
    """
    n = len(group)
    reach = int((anchor - first).max())
    right, right_common = radix_order(group, data, anchor, last + length - anchor, 1, length)
    left, left_common = radix_order(group, data, anchor - 1, anchor - first, -1, reach)
    found = np.zeros((n, reach + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    near, far = anchor - last, anchor - first
    for d in range(int(near.min()), reach + 1):
        item = np.flatnonzero((near <= d) & (d <= far))
        if len(item) < 2:
            continue
        class_r[right] = np.cumsum(right_common < length - d)
        class_l[left] = np.cumsum(left_common < d)
        key = class_r[item] * (n + 1) + class_l[item]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        found[item[order[np.append(same, False) | np.append(False, same)]], reach - d] = True
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    item, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return item, anchor[item] - reach + begin, anchor[item] - reach + end - 1


# ---------------------------------------------------------------- Spark


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of every text (k1, k2, gram, place), and spans that repeat inside one (gram null, place, until)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text", PART_BYTES):
            raw, at = utf8(part.column(2))
            a = Anchors(raw, at, length, gram)
            rows = np.concatenate([a.row, a.spans[:, 0]])
            places = np.concatenate([a.at, a.spans[:, 1]]) - at[rows]
            until = np.concatenate([np.full(len(a.row), -1), a.spans[:, 2] - at[a.spans[:, 0]]])
            mask = np.concatenate([np.zeros(len(a.row), bool), np.ones(len(a.spans), bool)])
            grams = pa.array(np.concatenate([a.gram, np.zeros(len(a.spans), np.uint64)]).view(np.int64), mask=mask)
            k1, k2 = part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([k1, k2, grams, pa.array(places), pa.array(until)], ["k1", "k2", "gram", "place", "until"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, gram bigint, place bigint, until bigint")


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes that the windows of each wanted anchor cover: (k1, k2, grp, place, near, far, lo, hi, bytes).

    ``near`` and ``far``: how far before the anchor its last and first window start.
    """
    names = ["k1", "k2", "grp", "place", "near", "far", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text", PART_BYTES):
            raw, at = utf8(part.column(2))
            a = Anchors(raw, at, length, gram)
            wanted = part.column(3)
            flat, row = wanted.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            pick = np.flatnonzero(np.isin(a.row * len(raw) + a.at, row * len(raw) + flat + at[row]))
            data = raw.tobytes()
            row = a.row[pick]
            said = [data[x:y] for x, y in zip(a.first[pick].tolist(), (a.last[pick] + length).tolist(), strict=True)]
            k1, k2 = part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))
            columns = [k1, k2, pa.array(a.gram[pick].view(np.int64)), pa.array(a.at[pick] - at[row]), pa.array(a.at[pick] - a.last[pick]), pa.array(a.at[pick] - a.first[pick]), pa.array(said, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, grp bigint, place bigint, near bigint, far bigint, bytes binary")


def _split_hot(items: DataFrame, length: int, gram: int, group_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Splits groups of more than ``group_rows`` contexts by halves of their windows.

    Windows that start ``lo`` to ``hi`` bytes before the anchor share the bytes from the last start to the first end;
    a half shares more of them, so its windows can only be equal to those with the same hash of these bytes. A group
    of one window (lo = hi) is one string: more than one context there means that all of them repeat. Returns the
    items to sort, and rows (k1, k2, start, end) that are settled on the way.
    """
    items = items.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    keys, ready, settled = ["grp", "lo", "hi"], None, []
    while True:
        sizes = items.groupBy(*keys).agg(F.count("*").alias("n"))
        hot = cut_lineage(sizes.where((F.col("n") > group_rows)))
        if hot.isEmpty():
            return (items if ready is None else ready.unionByName(items)), settled
        calm = items.join(hot.select(*keys), keys, "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        big = items.join(hot.select(*keys), keys)
        settled.append(big.where("lo = hi").select("k1", "k2", (F.col("place") - F.col("lo")).alias("start"), (F.col("place") - F.col("lo") + length).alias("end")))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        split = big.where("lo < hi").withColumn("half", F.explode(halves)).drop("lo", "hi").select("*", "half.lo", "half.hi").drop("half")
        split = split.where("lo <= far AND hi >= near")
        # shared bytes: from lo before the anchor (the last start) to length - hi after it (the first end)
        core = F.expr(f"substring(bytes, int(far - lo + 1), int({length} - hi + lo))")
        items = cut_lineage(split.withColumn("grp", F.xxhash64(core)))


def _sorted_spans(items: DataFrame, length: int) -> DataFrame:
    keys = ["grp", "lo", "hi"]

    def solve(table: pa.Table):
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            fresh[1:] |= c[1:] != c[:-1]
        group = np.cumsum(fresh)
        many = np.bincount(group)[group] > 1
        if not many.any():
            return
        table = table.filter(pa.array(many))
        group = group[many]
        said = table.column("bytes").combine_chunks()
        _, offsets, data = said.buffers()
        wide = pa.types.is_large_binary(said.type)
        begin = np.frombuffer(offsets, np.int64 if wide else np.int32)[said.offset : said.offset + len(said)].astype(np.int64)
        near, far, place = (table.column(k).to_numpy() for k in ("near", "far", "place"))
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        anchor = begin + far
        item, first, last = repeated_windows(group, np.frombuffer(data, np.uint8), anchor, anchor - np.minimum(far, hi), anchor - np.maximum(near, lo), length)
        start = place[item] + first - anchor[item]
        k1, k2 = (table.column(k).take(pa.array(item)).combine_chunks() for k in ("k1", "k2"))
        yield pa.RecordBatch.from_arrays([k1, k2, pa.array(start), pa.array(start + (last - first) + length)], ["k1", "k2", "start", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORT_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                same = np.ones(table.num_rows, bool)
                for k in keys:
                    values = table.column(k).to_numpy()
                    same &= values == values[-1]
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from solve(table.slice(0, cut).combine_chunks())
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return items.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "k1 bigint, k2 bigint, start bigint, end bigint")


def repeated_spans(texts: DataFrame, length: int = 400, gram: int = 100, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k1, k2, spans): for each text (``k1, k2``: 128 bits of hash, ``text``) the spans of bytes covered by repeated strings.

    Texts of fewer bytes than ``length`` have none. Copies of a text share a key and are searched once; that they
    repeat each other is a count.
    """
    long = texts.where(F.octet_length("text") >= length)
    rows = stored(_anchor_rows(long, length, gram))
    anchors = rows.where("gram IS NOT NULL").select("k1", "k2", "gram", "place")
    which = F.xxhash64("k1", "k2", "place")
    repeated = anchors.groupBy("gram").agg(F.min(which).alias("x"), F.max(which).alias("y")).where("x <> y").select(F.col("gram").alias("of"))
    wanted = (
        anchors.join(repeated, F.col("gram") == F.col("of")).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    )
    unique = long.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "places")
    items = stored(_contexts(unique, length, gram))
    ready, settled = _split_hot(items, length, gram, group_rows)
    spans = _sorted_spans(ready.select("k1", "k2", "grp", "place", "near", "far", "lo", "hi", "bytes"), length)
    for s in settled:
        spans = spans.unionByName(s)
    spans = spans.unionByName(rows.where("gram IS NULL").select("k1", "k2", F.col("place").alias("start"), F.col("until").alias("end")))
    copies = long.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("bigint").alias("end")).where("n > 1")
    spans = spans.unionByName(copies.select("k1", "k2", F.lit(0).cast("bigint").alias("start"), "end"))
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", keep_bytes: bool = True, gram: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``: the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it starts at two places or more, in any rows, the same
    included; strings are judged on the input. Bytes may be cut inside a character, so ``kept`` is binary (null if
    ``keep_bytes`` is off). Null text is empty. Repeated rows repeat each other. Output names replace columns.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    gram = gram or max(1, length // 4)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    said = text_or_empty(text)
    k1, k2 = F.xxhash64(said).alias("k1"), F.xxhash64(F.lit(length), said).alias("k2")
    spans = repeated_spans(docs.select(k1, k2, said.alias("text")), length, gram, group_rows)
    rows = kept.select(F.struct(*[F.col(c) for c in kept.columns if c != text]).alias("row") if len(kept.columns) > 1 else F.struct(F.lit(0)).alias("row"), F.col(text).isNull().alias("missing"), said.alias("text"), k1, k2)
    rows = rows.join(spans, ["k1", "k2"], "left").select("row", "missing", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = batch.column(3)
            out: list[list] = [[], [], [], [], []]
            for i, value in enumerate(batch.column(2)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                pieces, upto, cut, runs = [], 0, 0, 0
                found = spans[i].as_py() if spans[i].is_valid else []
                end = -1
                for s in found:
                    if s["start"] > end:
                        pieces.append(raw[upto : s["start"]])
                        cut += s["end"] - s["start"]
                        runs += 1
                        end = s["end"]
                    elif s["end"] > end:
                        cut += s["end"] - end
                        end = s["end"]
                    upto = end
                pieces.append(raw[upto:])
                left = b"".join(pieces)
                for column, v in zip(out, (len(raw), cut, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["row", "missing", "text", *names])

    done = rows.mapInArrow(run, plus([rows.schema[c] for c in ("row", "missing", "text")], RESULT))
    columns = [F.when(F.col("missing"), None).otherwise(F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in kept.columns]
    return done.select(*columns, *names)
