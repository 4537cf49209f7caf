"""Benchmark decontamination with an FM-index over each shard of the training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import cut_lineage, lowered, plus, slices, stored, text_or_empty, utf8, words_of

IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text of one shard; its index takes about 25 times as much memory.
SHARD_BYTES = 1 << 20
#: Every so many positions of the indexed sequence keep their place.
SAMPLE_EVERY = 16
#: Benchmark text that goes to the tasks at once; a larger benchmark goes in blocks, each over all documents.
BLOCK_BYTES = 16 << 20
#: Words of an item that stay together; a longer item is cut into pieces that share all but the first of a window's words.
PIECE_WORDS = 10_000

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(BASE_INVERSE, n + 1)[starts]


# ---------------------------------------------------------------- index


def suffix_order(seq: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of a sequence in which each 0 is an end of its own, smaller than all words, in order of place.

    Suffixes are first sorted by as many words as fit into 60 bits; groups that are still equal, and have not met an
    end, are sorted by the rank of what follows, twice as far each time.
    """
    n = len(seq)
    width = max(1, 60 // bits)
    padded = np.concatenate([seq.astype(np.uint64), np.zeros(width, np.uint64)])
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for i in range(width):
        part = np.where(alive, padded[i : i + n], np.uint64(0))
        alive &= part != 0
        key = (key << np.uint64(bits)) | part
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    ended = ~alive[order]  # an end decides: equal ones stand in order of place already
    fresh[1:] |= ended[1:]
    head = np.flatnonzero(fresh)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    reach = width
    while True:
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        open_rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_rows):
            return order
        at = order[open_rows]
        group, after = rank[at], rank[np.minimum(at + reach, n)]
        again = np.lexsort((at, after, group))
        order[open_rows] = at[again]
        group, after = group[again], after[again]
        new = np.ones(len(again), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        fresh[open_rows] = new
        first = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[order[open_rows]] = first
        reach *= 2


@dataclass
class Wavelet:
    """Wavelet tree by levels: on each, symbols stand stably by the bit read before; ranks answer in constant time."""

    ones: list[np.ndarray]
    zeros: list[int]

    @classmethod
    def of(cls, symbols: np.ndarray, bits: int) -> Wavelet:
        ones, zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            counted = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=counted[1:])
            ones.append(counted)
            zeros.append(len(symbols) - int(counted[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        return cls(ones, zeros)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (len(self.ones) - 1 - level)) & 1
            a, b = ones[lo], ones[hi]
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit, zeros + ones[at], at - ones[at])
            out = (out << 1) | bit
        return out


class FmIndex:
    """FM-index of a sequence of word numbers (0: an end)."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        order = suffix_order(seq, self.bits)
        before = np.where(order > 0, seq[order - 1], 0)
        self.tree = Wavelet.of(before.astype(np.int64), self.bits)
        self.first = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols + 1), out=self.first[1:])
        kept = (order % SAMPLE_EVERY == 0) | (before == 0)  # a place after an end has no step back
        self.kept = np.zeros(len(seq) + 1, np.int64)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of ``patterns``, right-aligned), read backwards."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.first[-1])
        for back in range(patterns.shape[1]):
            live = np.flatnonzero((back < lengths) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - back]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: steps back until a kept place is met."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            todo = todo[self.kept[rows[todo] + 1] == self.kept[rows[todo]]]
            if not len(todo):
                break
            symbol = self.tree.access(rows[todo])
            rows[todo] = self.first[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
        return self.places[self.kept[rows]] + steps


# ---------------------------------------------------------------- benchmark


@dataclass
class Phrases:
    """Windows of benchmark items over a vocabulary that holds the items' words only."""

    names: list[str]
    hashes: np.ndarray
    lengths: np.ndarray
    patterns: np.ndarray
    sizes: np.ndarray
    owners: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Phrases:
        """``items``: (name, text). Equal windows are one pattern with several owners."""
        raw, at = utf8(pa.array([t for _, t in items], pa.large_string()))
        raw = lowered(raw)
        starts, ends, rows = words_of(raw, at, IN_WORD)
        hashed = word_hashes(raw, starts, ends)
        vocabulary, first, word = np.unique(hashed, return_index=True, return_inverse=True)
        found: dict[bytes, set[int]] = {}
        number = (word + 1).astype(np.int64)
        for i in range(len(items)):
            mine = number[rows[i] : rows[i + 1]]
            for k in range(max(1, len(mine) - window + 1) if len(mine) else 0):
                found.setdefault(mine[k : k + window].tobytes(), set()).add(i)
        patterns = np.zeros((len(found), window), np.int64)
        sizes = np.zeros(len(found), np.int64)
        for k, p in enumerate(found):
            words = np.frombuffer(p, np.int64)
            sizes[k] = len(words)
            patterns[k, window - len(words) :] = words
        return cls([n for n, _ in items], vocabulary, (ends - starts)[first], patterns, sizes, [np.array(sorted(v)) for v in found.values()])


def scan_shard(raw: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per row, word starts, ends, first word of each row, which words are hit, and (row, item) pairs."""
    raw = lowered(raw)
    starts, ends, rows = words_of(raw, at, IN_WORD)
    n = len(starts)
    hit = np.zeros(n, bool)
    none = np.zeros((0, 2), np.int64)
    counts = np.diff(rows)
    if not n or not len(phrases.patterns):
        return counts, starts, ends, rows, hit, none
    hashed = word_hashes(raw, starts, ends)
    near = np.minimum(np.searchsorted(phrases.hashes, hashed), len(phrases.hashes) - 1)
    known = (phrases.hashes[near] == hashed) & (phrases.lengths[near] == ends - starts)
    symbol = np.where(known, near + 1, 0)
    # the index covers every word; those outside the benchmark's vocabulary are ends, and so is each row's end
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    extra = np.flatnonzero(cut[:n] & known & np.concatenate([[False], known[:-1]]))  # two rows meet without an end
    keep = known | np.concatenate([[False], known[:-1]])  # a run of ends is one end
    place = np.flatnonzero(keep)
    seq = symbol[place]
    if len(extra):
        spots = np.searchsorted(place, extra)
        seq, place = np.insert(seq, spots, 0), np.insert(place, spots, -1)
    if not seq.any():
        return counts, starts, ends, rows, hit, none
    seq, place = np.append(seq, 0), np.append(place, -1)
    index = FmIndex(seq, len(phrases.hashes))
    lo, hi = index.search(phrases.patterns, phrases.sizes)
    met = np.flatnonzero(hi > lo)
    if not len(met):
        return counts, starts, ends, rows, hit, none
    many = (hi - lo)[met]
    which = np.repeat(met, many)
    suffix = np.repeat(lo[met], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    word = place[index.locate(suffix)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.sizes[which], -1)
    hit = np.cumsum(edge[:n]) > 0
    row = np.searchsorted(rows, word, side="right") - 1
    pair = np.unique(row * len(phrases.patterns) + which)
    row, which = pair // len(phrases.patterns), pair % len(phrases.patterns)
    width = np.array([len(o) for o in phrases.owners])[which]
    items = np.concatenate([phrases.owners[w] for w in which])
    return counts, starts, ends, rows, hit, np.unique(np.column_stack([np.repeat(row, width), items]), axis=0)


# ---------------------------------------------------------------- Spark


def item_pieces(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(name, said): items with at most ``PIECE_WORDS`` words as they are, longer ones in overlapping pieces of that many,
    so that each window of an item is one of exactly one of its pieces. Null ids are the empty string, null texts are empty."""
    name, said = F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), text_or_empty(text).alias("said")
    items = benchmark.select(name, said).withColumn("long", F.length("said") > 2 * PIECE_WORDS)
    step = max(1, PIECE_WORDS - window + 1)
    words = F.regexp_extract_all(F.translate("said", UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = items.where("long").select("name", words.alias("words")).select("name", F.explode(F.transform(
        F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array_join(F.slice("words", i + 1, step + window - 1), " "))).alias("said"))
    return items.where("NOT long").select("name", "said").unionByName(cut)


def _blocks(pieces: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The pieces in blocks of a bounded size, read one partition at a time; the caller holds one block at a time."""
    block, size = [], 0
    for name, said in pieces.toLocalIterator():
        if block and size + len(said) > BLOCK_BYTES // 4:
            yield block
            block, size = [], 0
        block.append((name, said))
        size += len(said)
    yield block


OUT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` (bytes from the first to after the
    last word of each run of hit words) to every row.

    Words are runs of letters, digits and characters beyond ASCII after lower-casing A-Z. A window is ``window`` words
    in a row of one item, or all words of a shorter one. Tasks index their texts shard by shard and search all windows
    in each index, so documents are never shuffled. The benchmark goes to the tasks in blocks of bounded size. With
    several, each is searched and its hits (rows with none are left out) written before the next one is read, so the
    driver holds one block, whatever the size of the benchmark or of an item; then hits are joined on a row number and
    the spans merged.

    Null text has no words; an item without words matches nothing; items that share an id count once, a null id is
    the empty string. Rows may repeat. Columns with an output's name are replaced.
    """
    names = {"n_words", "n_hit", "items", "spans"}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    blocks = _blocks(item_pieces(benchmark, window, item_id, item_text))
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _search(kept, text, block, window)
    # rows get a number and are written once, so that every block sees the same rows
    rest = F.struct(*[F.col(c) for c in kept.columns]).alias("row")
    numbered = cut_lineage(kept.select(rest, F.col(text).alias("text"), F.monotonically_increasing_id().alias("number")))
    texts = numbered.select("number", "text")
    found = None
    while block is not None:
        one = stored(_search(texts, "text", block, window).where("n_hit > 0").select("number", "items", "spans"))
        found = one if found is None else found.unionByName(one)
        block, following = following, next(blocks, None)
    merged = found.groupBy("number").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    zero, empty = F.lit(0).cast("bigint"), merged.schema
    joined = numbered.join(merged, "number", "left").select(
        "row.*", zero.alias("n_words"), zero.alias("n_hit"),
        *[F.coalesce(c, F.array().cast(empty[c].dataType)).alias(c) for c in ("items", "spans")],
    )
    return _merge(joined, text)


def _search(docs: DataFrame, text: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    phrases = Phrases.of(items, window)

    def run(batches):
        for part in slices(batches, text, SHARD_BYTES):
            raw, at = utf8(part.column(part.schema.get_field_index(text)))
            counts, starts, ends, rows, hit, pairs = scan_shard(raw, at, phrases)
            names: list[list[str]] = [[] for _ in range(part.num_rows)]
            for row, item in pairs.tolist():
                names[row].append(phrases.names[item])
            step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            cut = np.zeros(len(hit) + 1, bool)
            cut[rows] = True
            both = np.flatnonzero(cut[1:-1] & hit[1:] & hit[:-1]) + 1 if len(hit) else np.zeros(0, np.int64)
            first, last = np.sort(np.append(np.flatnonzero(step == 1), both)), np.sort(np.append(np.flatnonzero(step == -1), both)) - 1
            of = np.searchsorted(rows, first, side="right") - 1
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for row, a, b in zip(of.tolist(), first.tolist(), last.tolist(), strict=True):
                spans[row].append({"start": int(starts[a] - at[row]), "end": int(ends[b] - at[row])})
            upto = np.concatenate([[0], np.cumsum(hit)])
            columns = [
                pa.array(counts, pa.int64()), pa.array(upto[rows[1:]] - upto[rows[:-1]], pa.int64()),
                pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(run, plus(docs.schema.fields, OUT))


def _merge(docs: DataFrame, text: str) -> DataFrame:
    """Unites overlapping spans from several blocks; counts the words of each text and of its spans anew."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            raw, at = utf8(batch.column(names.index(text)))
            raw = lowered(raw)
            starts, _, rows = words_of(raw, at, IN_WORD)
            hits, out = [], []
            for i, spans in enumerate(batch.column(names.index("spans")).to_pylist()):
                mine, joined, n = starts[rows[i] : rows[i + 1]] - at[i], [], 0
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    between = np.searchsorted(mine, s["start"]) - np.searchsorted(mine, joined[-1]["end"]) if joined else 1
                    if between <= 0:
                        joined[-1]["end"] = max(joined[-1]["end"], s["end"])
                    else:
                        joined.append(dict(s))
                for s in joined:
                    n += int(np.searchsorted(mine, s["end"]) - np.searchsorted(mine, s["start"]))
                hits.append(n)
                out.append(joined)
            columns = dict(zip(names, batch.columns, strict=True))
            columns["n_words"] = pa.array(np.diff(rows), pa.int64())
            columns["n_hit"] = pa.array(hits, pa.int64())
            columns["spans"] = pa.array(out, batch.schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_leaks(found: DataFrame, text: str = "text") -> DataFrame:
    """Cuts the spans out of the texts (a space stays in their place); rows keep their other columns."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            where = names.index(text)
            said, spans = batch.column(where).to_pylist(), batch.column(names.index("spans")).to_pylist()
            for i, s in enumerate(spans):
                if s:
                    raw, kept, upto = said[i].encode(), [], 0
                    for x in s:
                        kept.append(raw[upto : x["start"]])
                        upto = x["end"]
                    kept.append(raw[upto:])
                    said[i] = b" ".join(kept).decode()
            columns = [pa.array(said, pa.string()) if n == text else c for n, c in zip(names, batch.columns, strict=True) if n not in ("n_words", "n_hit", "items", "spans")]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n not in ("n_words", "n_hit", "items", "spans")])

    schema = found.drop("n_words", "n_hit", "items", "spans").schema
    return found.mapInArrow(run, schema)


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS phrase
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase FROM dw, ns, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, item_id, i, n FROM occ JOIN win USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
