"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes of its pieces."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from litflow.llm.common import plus, slices

#: Fixed values of byte-level BPE files: the pattern that cuts texts into pieces, and the printable stand-ins of bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))

PART_BYTES = 4 << 20
#: Pieces whose prefix counts a task remembers.
REMEMBERED = 700_000
#: Lengths of stems whose states are remembered, longest first.
STEMS = (9, 6)
#: Texts of several times the length of any common piece are counted without being remembered.
LONG_PIECE = 256


class PrefixCounter:
    """Counts tokens of a byte-level BPE at every prefix.

    The tokens of a byte string end with the one token t for which the string before it ends with a token s such that
    s and t stay apart when encoded together; so the count at a place is the count where t begins, plus one. The
    counts at all prefixes of a piece come from one pass and are kept, those of a text are sums over its pieces.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {b: chr(b) for b in PRINTABLE}
        letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
        back = {c: b for b, c in letters.items()}
        self.vocab = {bytes(back[c] for c in token): number for token, number in spec["model"]["vocab"].items() if all(c in back for c in token)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(bytes(back[c] for c in a), bytes(back[c] for c in b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(PIECES).findall
        # tokens that stand when encoded alone, read backwards: (node * 256 + byte) gives the next node
        self.tokens = [t for t in self.vocab if self.merged(t) == [t]]
        self.steps: dict[int, int] = {}
        self.ends = [-1]
        for number, t in enumerate(self.tokens):
            node = 0
            for byte in reversed(t):
                if (found := self.steps.get(node << 8 | byte)) is None:
                    found = self.steps[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = found
            self.ends[node] = number
        self.apart: dict[int, bool] = {}
        self.stems: dict[bytes, tuple[list[int], list[int]]] = {}
        self.counts: dict[str, list[int]] = {}
        self.totals = _Totals(self)

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a short byte string, by its merges in order of rank."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _apart(self, pair: int) -> bool:
        a, b = self.tokens[pair >> 32], self.tokens[pair & 0xFFFFFFFF]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        known = self.apart[pair] = self.merged(a + b) == [a, b]
        return known

    def byte_counts(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ..., raw."""
        counts, last, done = [0], [0], 0
        for cut in STEMS:  # what common stems have in store is taken over
            if len(raw) >= cut and (known := self.stems.get(raw[:cut])) is not None:
                counts, last, done = [*known[0]], [*known[1]], cut
                break
        counts += [0] * (len(raw) - done)
        last += [0] * (len(raw) - done)
        step, ends, apart = self.steps.get, self.ends, self.apart.get
        for end in range(done + 1, len(raw) + 1):
            node, start, found = 0, end, []
            while start and (node := step(node << 8 | raw[start - 1])) is not None:
                start -= 1
                if (token := ends[node]) >= 0:
                    found.append((start, token))
            for start, token in reversed(found):
                if start:
                    pair = last[start] << 32 | token
                    if (ok := apart(pair)) is None:
                        ok = self._apart(pair)
                    if not ok:
                        continue
                counts[end], last[end] = counts[start] + 1, token
                break
        for cut in STEMS:
            if done < cut <= len(raw):
                if len(self.stems) >= REMEMBERED:
                    self.stems.clear()
                self.stems[raw[:cut]] = counts[: cut + 1], last[: cut + 1]
        return counts

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts at every code point of a piece: of piece[:0], piece[:1], ..., piece."""
        if (known := self.counts.get(piece)) is not None:
            return known
        raw = piece.encode()
        found = self.byte_counts(raw)
        if len(raw) != len(piece):
            found = [found[i] for i in (*[i for i, b in enumerate(raw) if b & 0xC0 != 0x80], len(raw))]
        if len(piece) <= LONG_PIECE:
            if len(self.counts) >= REMEMBERED:
                self.counts.clear()
                self.totals.clear()
            self.counts[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; a special token of the file is a piece (and a token) of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else self.find(part)
        return out

    def count(self, pieces: list[str]) -> int:
        return sum(map(self.totals.__getitem__, pieces))

    def sums(self, pieces: list[str]) -> list[int]:
        """Tokens up to the end of each piece."""
        return list(accumulate(map(self.totals.__getitem__, pieces)))

    def at(self, pieces: list[str], sums: list[int], number: int, inside: int) -> int:
        """Tokens of the text cut ``inside`` code points into piece ``number``.

        What stands before the piece is as it was, but white space that the cut makes longer, and a piece cut short
        can fall into several; those are cut anew, a few characters.
        """
        piece = pieces[number]
        if piece in self.special and inside < len(piece):
            first, tail = number, piece[:inside]
            while first and pieces[first - 1] not in self.special and number - first < 2:
                first -= 1
            tail = "".join(pieces[first:number]) + tail
        else:
            first, tail = number, piece[:inside]
            if number and inside == 1 and pieces[number - 1].isspace() and tail.isspace():
                first, tail = number - 1, pieces[number - 1] + tail
        before = sums[first - 1] if first else 0
        if first == number and (inside == len(piece) or piece[:1] != "'" and piece not in self.special):
            return before + (self.totals[piece] if inside == len(piece) else self.piece_counts(piece)[inside])
        return before + self.count(self.find(tail))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ..., text: each as if that prefix were encoded alone."""
        pieces = self.pieces(text)
        sums = self.sums(pieces)
        return [0, *[self.at(pieces, sums, j, i) for j, p in enumerate(pieces) for i in range(1, len(p) + 1)]]

    def fit(self, pieces: list[str], sums: list[int], limit: int) -> int:
        """Code points of the longest prefix, up to the first piece that goes beyond the limit, with at most ``limit`` tokens."""
        j = bisect_right(sums, limit)
        done = sum(map(len, pieces[:j]))
        if j == len(pieces):
            return done
        for inside in range(len(pieces[j]) - 1, 0, -1):
            if self.at(pieces, sums, j, inside) <= limit:
                return done + inside
        return done


class _Totals(dict):
    """Tokens of whole pieces, worked out when first asked for."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.counter.special else self.counter.piece_counts(piece)[-1]
        if len(piece) <= LONG_PIECE:
            self[piece] = n
        return n


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and ``fit_chars`` to every row.

    ``path`` is a byte-level BPE file that every executor can read. ``fit_chars`` code points fit into the limit; it
    comes from the stored prefix counts, nothing is encoded again. Null text is empty; whole texts count. Output
    names replace columns.
    """
    names = ["n_bytes", "n_tokens", "over_limit", "fit_chars"]
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])

    def run(batches: Iterator[pa.RecordBatch]):
        count = counter(path)
        for part in slices(batches, text, PART_BYTES):
            out: list[list] = [[], [], [], []]
            for said in part.column(part.schema.get_field_index(text)).to_pylist():
                pieces = count.pieces(said or "")
                n = count.count(pieces)
                first = pieces[: limit + 1]  # each piece has a token: the limit lies in these
                fits = len(said or "") if n <= limit else count.fit(first, count.sums(first), limit)
                for column, value in zip(out, (len((said or "").encode()), n, n > limit, fits), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], [*part.schema.names, *names])

    return kept.mapInArrow(run, plus(kept.schema.fields, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"))


def token_prefixes(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``prefix_tokens``: the exact count at every code point of the text (null text: that of the empty one)."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "prefix_tokens"])

    def run(batches: Iterator[pa.RecordBatch]):
        count = counter(path)
        for part in slices(batches, text, PART_BYTES):
            counts = [count.prefix_counts(said or "") for said in part.column(part.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.list_(pa.int32()))], [*part.schema.names, "prefix_tokens"])

    return kept.mapInArrow(run, plus(kept.schema.fields, "prefix_tokens array<int>"))
