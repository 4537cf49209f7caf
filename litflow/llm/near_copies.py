"""SimHash near-duplicates: fingerprints are linked by a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.llm.common import cut_lineage, discard, hashable, lowered, plus, scrambled, slices, span_hashes, span_sums, stored, utf8, words_of
from litflow.llm.components import connected_components

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

SEED = 42
#: Text taken at once; its shingle hashes and their bits take about 30 times as much memory.
PART_BYTES = 3 << 18
#: Fingerprints of one trie at most; larger groups go in pairs of parts.
TRIE_ROWS = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def simhashes(raw: np.ndarray, at: np.ndarray, words: int = 4) -> np.ndarray:
    """One fingerprint for each row of a UTF-8 buffer."""
    return simhash_table(raw, at, words, 1)[:, 0]


def shingle_hashes(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, row after row, and how many each row has; a row without words has none."""
    raw = lowered(raw)
    starts, ends, rows = words_of(raw, at, ~SPACE)
    counts = np.diff(rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    # words one after the other, a space after each
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    spaced = np.full(int(size.sum()), 0x20, np.uint8)
    within = np.repeat(starts - begin, size) + np.arange(len(spaced))
    letters = np.ones(len(spaced), bool)
    letters[begin + size - 1] = False
    spaced[letters] = raw[within[letters]]
    # shingles of each row: all starts but the last words - 1; a shorter row is one shingle
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    row_of = np.repeat(np.arange(len(counts)), n)
    first = rows[:-1][row_of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.minimum(counts, words)[row_of] - 1
    text, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    left, right = begin[first].tolist(), (begin[last] + size[last] - 1).tolist()
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(left, right, strict=True)), np.uint64, len(left)), n


def simhash_table(raw: np.ndarray, at: np.ndarray, words: int, prints: int) -> np.ndarray:
    """``prints`` fingerprints for each row: the first from the shingles' hashes, others from these hashes mixed anew."""
    hashes, n = shingle_hashes(raw, at, words)
    out = np.zeros((len(n), prints), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(n)
    for k in range(prints):
        if k:
            hashes = _mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
        set_bits = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        bits = (set_bits * 2 > n[full, None]).astype(np.uint8)
        out[full, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


#: One bit of each byte: eight lanes in which up to 255 hashes add up without a carry.
LANES = np.uint64(0x0101010101010101)


def distinct_shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each row, and how many it has; a row without words has none.

    A shingle's hash is mixed from those of its words, A-Z lower-cased; a row of fewer words is one shingle.
    """
    raw = lowered(raw)
    starts, ends, rows = words_of(raw, at, ~SPACE)
    counts = np.diff(rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    word = np.concatenate([span_hashes(*span_sums(raw), starts, ends), np.zeros(words, np.uint64)])
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    first = rows[:-1][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts, words)[row]
    h = length.astype(np.uint64)
    for j in range(words):
        h = np.where(j < length, scrambled(h * np.uint64(0x9E3779B97F4A7C15) + word[first + j]), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.bincount(row[fresh], minlength=len(counts))


def set_prints(hashes: np.ndarray, n: np.ndarray, prints: int) -> np.ndarray:
    """``prints`` fingerprints for each row of ``distinct_shingles``: a bit is 1 if it is in more than half the mixed hashes."""
    out = np.zeros((len(n), prints), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    # rows are summed in pieces of at most 255 shingles
    pieces = -(-n[full] // 255)
    piece = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    heads = np.cumsum(pieces) - pieces
    for k in range(prints):
        hashes = _mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
        planes = np.stack([np.add.reduceat((hashes >> np.uint64(bit)) & LANES, piece) for bit in range(8)], axis=1)
        counts = planes.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        bits = np.add.reduceat(counts, heads, axis=0, dtype=np.int64) * 2 > n[full, None]
        out[full, k] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, name: str = "simhash", prints: int | None = None) -> DataFrame:
    """Adds the fingerprint as a long (its 64 bits), or an array of ``prints`` of them; null text and text without words: zero."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == name])

    def run(batches):
        for part in slices(batches, text, PART_BYTES):
            raw, at = utf8(part.column(part.schema.get_field_index(text)))
            if prints is None:
                found = pa.array(simhashes(raw, at, words).view(np.int64))
            else:
                table = simhash_table(raw, at, words, prints).view(np.int64)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * prints, pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])

    return kept.mapInArrow(run, plus(kept.schema.fields, f"{name} bigint" if prints is None else f"{name} array<bigint>"))


# ---------------------------------------------------------------- trie


def _labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n points under links (a, b) and equal labels in ``start``."""
    label = start.copy()
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label = label[label]
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        if np.array_equal(label[a], label[b]):
            return label


#: Node pairs worked on at once; with at most ``DIRECT`` pairs of values one is compared directly, so many pairs at a time.
FRONT, DIRECT, AT_ONCE = 1 << 16, 1 << 10, 1 << 19


def _expand(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places from ranges that start at a and b with na and nb places, range pair by range pair."""
    total = na * nb
    upto = np.cumsum(total)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        base = np.repeat(np.arange(lo, hi), total[lo:hi])
        k = np.arange(len(base)) - np.repeat(upto[lo:hi] - total[lo:hi] - (upto[lo - 1] if lo else 0), total[lo:hi])
        yield a[base] + k // nb[base], b[base] + k % nb[base]
        lo = hi


def trie_links(prints: np.ndarray, heads: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between sorted distinct values that differ in ``budget`` bits or fewer.

    ``heads``: starts of the runs that share the first ``depth`` bits; only values of one run are compared. A node of
    the trie is a range of the sorted values. Pairs of nodes go down together, one bit at a time, and carry the bits
    that differ so far; a pair beyond the budget is dropped, and a pair of small nodes is compared value by value, once.
    Passes with budget 1, 2, ... come first: nodes that lie within one component by then need no visit, so a dense
    group is not paired out.
    """
    n = len(prints)
    label = np.arange(n)
    tails = np.append(heads[1:], n)
    ones = [None] * 64
    kept_a, kept_b = [], []

    def counted(level: int) -> np.ndarray:
        if ones[level] is None:
            bit = (prints >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        return ones[level]

    for allowed in range(1, budget + 1):
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        many = tails - heads > 1
        stack = [(depth, heads[many], tails[many], heads[many], tails[many], np.zeros(int(many.sum()), np.int8))]
        found_a, found_b = [], []
        pending = 0
        while stack:
            level, al, ah, bl, bh, err = stack.pop()
            if len(al) > FRONT:
                half = len(al) // 2
                stack.append((level, al[half:], ah[half:], bl[half:], bh[half:], err[half:]))
                al, ah, bl, bh, err = al[:half], ah[:half], bl[:half], bh[:half], err[:half]
                stack.append((level, al, ah, bl, bh, err))
                continue
            one = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
            small = ~one & ((ah - al) * (bh - bl) <= DIRECT) if level < 64 else ~one
            fresh = small & ((err == allowed) | (allowed == 1))  # those of fewer bits were compared in an earlier pass
            if fresh.any():
                for x, y in _expand(al[fresh], (ah - al)[fresh], bl[fresh], (bh - bl)[fresh]):
                    ok = (x < y) & (label[x] != label[y])
                    ok[ok] = np.bitwise_count(prints[x[ok]] ^ prints[y[ok]]) <= budget
                    if ok.any():
                        found_a.append(x[ok])
                        found_b.append(y[ok])
                        pending += int(ok.sum())
            go = ~one & ~small
            if pending > 16 * FRONT:  # what was found so far is folded in, and prunes the rest
                label, change, pending = _fold(n, label, found_a, found_b, kept_a, kept_b)
            if not go.any() or level >= 64:
                continue
            al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
            c = counted(level)
            am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
            same = (al == bl) & (ah == bh)
            sides = ((al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am, ah, bl, bm, err + 1))
            parts = [[], [], [], [], []]
            for number, side in enumerate(sides):
                fits = (side[0] < side[1]) & (side[2] < side[3]) & (side[4] <= allowed)
                if number == 3:
                    fits &= ~same
                if number < 2:
                    fits &= ~same | (side[1] - side[0] > 1)
                for part, values in zip(parts, side, strict=True):
                    part.append(values[fits])
            merged = [np.concatenate(p) for p in parts]
            if len(merged[0]):
                stack.append((level + 1, *merged))
        if found_a:
            label, change, _ = _fold(n, label, found_a, found_b, kept_a, kept_b)
    if not kept_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(kept_a), np.concatenate(kept_b)


def _fold(n, label, found_a, found_b, kept_a, kept_b):
    """Unites components by the links found; keeps one link for each component that goes into another."""
    new = _labels(n, np.concatenate(found_a), np.concatenate(found_b), label)
    moved = np.flatnonzero((label == np.arange(n)) & (new != label))
    kept_a.append(new[moved])
    kept_b.append(moved)
    found_a.clear()
    found_b.clear()
    return new, np.concatenate([[0], np.cumsum(new[1:] != new[:-1])]), 0


def trie_pairs(prints: np.ndarray, label: np.ndarray, heads: np.ndarray, depth: int, budget: int):
    """Yields all pairs of places whose labels differ and whose values differ in ``budget`` bits or fewer, some at a time.

    Like ``trie_links``, but values are sorted and may repeat, and nothing is pruned except pairs of one label. Equal
    values of several labels are split by halves once all bits are used up.
    """
    tails = np.append(heads[1:], len(prints))
    change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    ones = {}
    many = tails - heads > 1
    stack = [(depth, heads[many], tails[many], heads[many], tails[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        level, *sides = stack.pop()
        if len(sides[0]) > FRONT:
            half = len(sides[0]) // 2
            stack += [(level, *[x[half:] for x in sides]), (level, *[x[:half] for x in sides])]
            continue
        al, ah, bl, bh, err = sides
        one = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
        small = ~one & ((ah - al) * (bh - bl) <= DIRECT)
        if small.any():
            for x, y in _expand(al[small], (ah - al)[small], bl[small], (bh - bl)[small]):
                ok = (x < y) & (label[x] != label[y])
                ok[ok] = np.bitwise_count(prints[x[ok]] ^ prints[y[ok]]) <= budget
                if ok.any():
                    yield x[ok], y[ok]
        go = ~one & ~small
        if not go.any():
            continue
        al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        if level < 64:
            if level not in ones:
                ones[level] = np.concatenate([[0], np.cumsum((prints >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)]).astype(np.int64)
            c = ones[level]
            am, bm, cost = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl]), 1
        else:
            am, bm, cost = (al + ah) // 2, (bl + bh) // 2, 0
        same = (al == bl) & (ah == bh)
        parts = []
        for number, side in enumerate(((al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + np.int8(cost)), (am, ah, bl, bm, err + np.int8(cost)))):
            fits = (side[0] < side[1]) & (side[2] < side[3]) & (side[4] <= budget)
            if number < 2:
                fits &= ~same | (side[1] - side[0] > 1)
            if number == 3:
                fits &= ~same
            parts.append([x[fits] for x in side])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))


# ---------------------------------------------------------------- links between all fingerprints


def _blocks(rows: int, budget: int) -> tuple[int, int]:
    """Number of blocks that 64 bits are cut into, and how many of them are chosen as a key.

    Two values within the budget agree in all but ``budget`` blocks. More blocks make longer keys, for more copies of
    each value; the smallest number is taken whose keys leave about 4096 values in a group.
    """
    for n in range(budget + 1, 17):
        if rows >> (64 // n * (n - budget)) <= 4096 or comb(n + 1, budget) > 128:
            return n, n - budget
    return 16, 16 - budget


def fingerprint_links(values: DataFrame, budget: int = 4, near: "Near | None" = None, most: int | None = None) -> DataFrame:
    """Links (print, a, b) that join all distinct values ``v`` of a ``print`` within ``budget`` differing bits into components.

    A value goes to one group for each choice of blocks, with the chosen blocks turned to the front, so that the first
    levels of the trie are equal there by choice and the trie joins the rest. A group beyond ``TRIE_ROWS`` is dealt
    into parts that meet in pairs. The links of a task span what it found; they are fewer than its values.

    With ``near`` values also have (node, label, size, shared, prints), and pairs of nodes with different labels that it lets
    through are given instead, as (bits, a, b): of each node those of the fewest differing bits, ``near.most`` in a task.
    A pair (-1, -1) tells that there are more.

    With ``most`` values also have ``rep``, a node that has them, and links of nodes (bits, a, b) are given: without bits
    one from each node to the smallest that a task's links join it to, so that a dense group, which tasks see again and
    again, gives much the same few links; with bits, minus the number of times a link was found, up to ``most`` links of each node.
    """
    from itertools import combinations

    extra = ["node", "label", "size", "shared", "prints"] if near else ["rep"] if most is not None else []

    sizes = values.agg(F.count("*").alias("n"), F.countDistinct("print").alias("p")).first()
    n, chosen = _blocks(sizes["n"] // max(1, sizes["p"]), budget)
    edges = [round(i * 64 / n) for i in range(n + 1)]
    widths = np.diff(edges)
    orders = [[*choice, *[i for i in range(n) if i not in choice]] for choice in combinations(range(n), chosen)]
    depth = int(min(widths[order[:chosen]].sum() for order in orders))
    turns = []
    for number, order in enumerate(orders):
        bits, turned = 0, F.lit(0).cast("bigint")
        for i in order:
            piece = F.shiftrightunsigned("v", 64 - edges[i + 1]).bitwiseAND(F.lit((1 << int(widths[i])) - 1).cast("bigint"))
            bits += int(widths[i])
            turned = turned.bitwiseOR(F.shiftleft(piece, 64 - bits))
        turns.append(F.struct(F.lit(number).alias("turn"), turned.alias("turned")))
    front = F.shiftrightunsigned("turned", 64 - depth)
    spread = values.select("print", *extra, F.explode(F.array(*turns)).alias("t")).select("print", "t.*", *extra)
    # a row for every TRIE_ROWS rows at most, so it is broadcast
    hot = spread.groupBy("print", "turn", front.alias("front")).count().where(F.col("count") > TRIE_ROWS).select("print", "turn", "front", F.ceil(F.col("count") / (TRIE_ROWS // 2)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("turned", *extra[:1]), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("p"), F.greatest(o, F.col("own")).alias("q"))
    )
    dealt = (
        spread.withColumn("front", front).join(F.broadcast(hot), ["print", "turn", "front"], "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(own))
        .withColumn("pair", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(pairs)))
        .select("print", "turn", "pair.p", "pair.q", "turned", *extra)
    )
    keys = ["print", "turn", "p", "q"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TRIE_ROWS:
                table = pa.Table.from_batches(held)
                cut = _last_group(table, keys, depth)
                if cut:
                    yield from _join_groups(table.slice(0, cut), keys, depth, budget, near, most, straight)
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if held:
            yield from _join_groups(pa.Table.from_batches(held), keys, depth, budget, near, most, straight)

    def straight(turn: np.ndarray, turned: np.ndarray) -> np.ndarray:
        """Turned values with their blocks in the old order."""
        out = np.zeros(len(turned), np.uint64)
        for number in np.unique(turn):
            mine, bits = turn == number, 0
            for i in orders[number]:
                bits += int(widths[i])
                piece = (turned[mine] >> np.uint64(64 - bits)) & np.uint64((1 << int(widths[i])) - 1)
                out[mine] |= piece << np.uint64(64 - edges[i + 1])
        return out.view(np.int64)

    # equal fronts have one sign, so a group is sorted like unsigned values
    return dealt.repartition("print", "turn", front, "p", "q").sortWithinPartitions(*keys, "turned").mapInArrow(run, f"{'bits' if extra else 'print'} int, a bigint, b bigint")


def _fresh(table: pa.Table, keys: list[str], depth: int) -> np.ndarray:
    """Where a group of a sorted table starts: rows with other keys or another front than the row before."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    front = table.column("turned").to_numpy().view(np.uint64) >> np.uint64(64 - depth)
    for values in [front, *[table.column(k).to_numpy() for k in keys]]:
        fresh[1:] |= values[1:] != values[:-1]
    return fresh


def _last_group(table: pa.Table, keys: list[str], depth: int) -> int:
    """Where the last group of a sorted table starts."""
    return int(np.flatnonzero(_fresh(table, keys, depth))[-1])


def _join_groups(table: pa.Table, keys: list[str], depth: int, budget: int, near: "Near | None", most: int | None, straight: Callable):
    heads = np.flatnonzero(fresh := _fresh(table, keys, depth))
    turned = table.column("turned").to_numpy().view(np.uint64)
    order = np.arange(len(turned))
    if near:
        label = table.column("label").to_numpy()
        order = np.lexsort((label, turned, np.cumsum(fresh)))
        label, value = label[order], table.column("node").to_numpy()[order]
    if near:
        size, shared = table.column("size").to_numpy()[order], table.column("shared").to_numpy()[order]
        prints = table.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(order), -1)[order]
        best = Best(near.most)
        for a, b in trie_pairs(turned, label, heads, depth, budget):
            fits = near.common(size[a], size[b], np.minimum(shared[a], shared[b]))
            a, b = a[fits], b[fits]
            bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
            fits = near.bits(bits, np.minimum(size[a], size[b]))
            best.add(value[a[fits]], value[b[fits]], bits[fits])
        a, b, bits = best.ranked()
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int32()), pa.array(a), pa.array(b)], ["bits", "a", "b"])
        return
    a, b = trie_links(turned, heads, depth, budget)
    if most is not None:
        rep = table.column("rep").to_numpy()
        for links in _node_links(rep[a], rep[b], most):
            yield pa.RecordBatch.from_arrays(list(links), ["bits", "a", "b"])
        return
    turn, number = table.column("turn").to_numpy(), table.column("print").to_numpy()
    sides = [pa.array(straight(turn[x], turned[x])) for x in (a, b)]
    yield pa.RecordBatch.from_arrays([pa.array(number[a], pa.int32()), *sides], ["print", "a", "b"])


def _node_links(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Of links between nodes: one from each node to the smallest that they join it to, then the ``most`` of each node found most often."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    least = _labels(len(nodes), a, b, np.arange(len(nodes)))
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    yield pa.nulls(len(moved), pa.int32()), pa.array(nodes[least[moved]]), pa.array(nodes[moved])
    if most:
        apart = a != b  # a node may have several values of a print
        pair, found = np.unique(np.minimum(a, b)[apart] * len(nodes) + np.maximum(a, b)[apart], return_counts=True)
        best = Best(most)
        best.add(nodes[pair // len(nodes)], nodes[pair % len(nodes)], -found)
        a, b, bits = best.ranked()
        held = slice(0, len(a) - best.more)
        yield pa.array(bits[held], pa.int32()), pa.array(a[held]), pa.array(b[held])


class Near:
    """Pairs that may be alike by ``percent``: by the counts of their shingles, and by the bits in which all prints differ.

    Sets of similarity J have an angle of at most acos(2 J / (1 + J)), and each bit of two prints differs with the
    chance of the angle over pi; ``DEVIATIONS`` above that are let through (of pairs just alike one in 4,000 is lost).
    Texts of few shingles do not follow this law closely: with less than ``FEW`` only the counts decide.
    """

    FEW, DEVIATIONS = 40, 3.5

    def __init__(self, percent: int, prints: int, most: int = 0) -> None:
        self.percent, self.most = percent, most
        p, n = acos(2 * percent / (100 + percent)) / pi, 64 * prints
        self.cut = int(n * p + self.DEVIATIONS * sqrt(n * p * (1 - p)))

    def sizes(self, a, b):
        """The smaller set is at least ``percent`` of the larger; arrays or columns."""
        return (a * 100 >= b * self.percent) & (b * 100 >= a * self.percent)

    def common(self, a, b, most):
        """Sets of these sizes that have ``most`` shingles in common may be alike; implies ``sizes``."""
        return most * (100 + self.percent) >= (a + b) * self.percent

    def bits(self, bits, smaller):
        return (bits <= self.cut) | (smaller < self.FEW)

    def column(self, a: str, b: str) -> Column:
        """The same of the structs a and b with (size, prints)."""
        count = F.zip_with(F.col(f"{a}.prints"), F.col(f"{b}.prints"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return self.sizes(F.col(f"{a}.size"), F.col(f"{b}.size")) & self.bits(F.aggregate(count, F.lit(0), lambda s, x: s + x), F.least(f"{a}.size", f"{b}.size"))


class Best:
    """Pairs in which one node is among the ``most`` nearest of the other; pairs that no longer are go while others come."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.waiting, self.more = most, [], 0, False

    def add(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        if len(a):
            self.held.append((np.minimum(a, b), np.maximum(a, b), bits))
            self.waiting += len(a)
            if self.waiting > 1 << 20:
                self._cut()

    def _cut(self) -> None:
        a, b, bits = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((b, a))
        a, b, bits = a[order], b[order], bits[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, bits = a[fresh], b[fresh], bits[fresh]
        keep = np.zeros(len(a), bool)
        for node, other in ((np.concatenate([a, b]), np.concatenate([b, a])),):
            order = np.lexsort((other, np.tile(bits, 2), node))
            heads = np.ones(len(order), bool)
            heads[1:] = node[order][1:] != node[order][:-1]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
            keep[order[place < self.most] % len(a)] = True
        self.more |= not keep.all()
        self.held, self.waiting = [(a[keep], b[keep], bits[keep])], 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ranked()[:2]

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs and the bits in which they differ."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._cut()
        return tuple(np.append(x, -1) for x in self.held[0]) if self.more else self.held[0]


def print_components(rows: DataFrame, budget: int = 4) -> DataFrame:
    """(node, component) of the nodes that share a value with another or have one within the budget of another's.

    ``rows``: (node, prints), any number of rows per node. Values are compared print by print; a value stands for the
    smallest node that has it. Nodes without a link are left out.
    """
    return connected_components(_print_links(rows.select("node", F.posexplode("prints").alias("print", "v")), budget, 0))


def _print_links(each: DataFrame, budget: int, most: int) -> DataFrame:
    """Links (bits, a, b) of the nodes of ``each`` (node, print, v): those without bits join them into components.

    Those with bits are spanning links, up to ``most`` of a node from each task, and links of equal values; the fewer bits, the more often.
    """
    values = stored(each.groupBy("print", "v").agg(F.min("node").alias("rep")))
    same = each.join(values, ["print", "v"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    joins = same.select(F.lit(None).cast("int").alias("bits"), "a", "b")
    if most:
        joins = joins.unionByName(same.select(F.lit(-1).alias("bits"), "a", "b"))
    return joins.unionByName(fingerprint_links(values, budget, most=most))


#: Links of one node that are compared in one task.
HOT_LINKS = 256
#: Nearest nodes of each node that are checked in the first round of the second step, and by how much more in each later one.
MOST, GROWTH = 4, 8


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each ``text``."""

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            hashes, n = distinct_shingles(*utf8(part.column(1)), words)
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _beside(links: DataFrame, facts: DataFrame, value: Column) -> DataFrame:
    """Links (a, b) with ``value`` of the facts of both nodes as of_a and of_b; a node of many links meets them in several tasks."""
    met = links
    for end in ("a", "b"):
        hot = links.groupBy(end).count().where(F.col("count") > HOT_LINKS).select(end, F.ceil(F.col("count") / HOT_LINKS).cast("int").alias("parts"))
        dealt = met.join(hot, end, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        copies = facts.select(F.col("node").alias(end), value.alias(f"of_{end}")).join(hot, end, "left")
        copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        met = dealt.join(copies, [end, "part"]).drop("part")
    return met


def checked_components(rows: DataFrame, texts: DataFrame, budget: int, words: int, percent: int, linking: int) -> DataFrame:
    """(node, component) of the nodes that have a link; what is linked is one relation, whatever the order of the work:

    some of the first ``linking`` prints of both is within the budget, ``Near`` lets the pair through by all prints, and
    the distinct shingles have a Jaccard similarity of ``percent`` or more. ``rows``: (node, prints, size), with as many
    prints everywhere; ``texts``: (node, text), where a node has one text, in any number of rows.

    First, of the links that span the fingerprints' components, ``MOST`` of each node are checked. The nodes of a
    component that these do not hold together go into the trie again, with labels of what holds so far: across labels
    each task gives the nearest pairs of every node, the nearest over all tasks are checked and unite labels, and rounds
    with more of them follow until none is left out. Only pairs are looked at whose shingles that other labels have, too
    (``shared_sizes``), would suffice. Rows grow with the nodes in each round, not with the pairs of a group: what holds is carried on as
    one link from each node to its label.
    """
    prints = rows.select(F.size("prints").alias("n")).first()
    near = Near(percent, prints["n"] if prints else 1)
    first = F.posexplode(F.slice("prints", 1, linking)).alias("print", "v")
    each = rows.select("node", first)
    links = stored(_print_links(each, budget, MOST).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("bits").alias("bits"), F.count_if(F.col("bits").isNull()).alias("joins")))
    wholes = stored(connected_components(links.where("joins > 0")).withColumnRenamed("component", "whole"))
    # those found by most prints are likely the nearest
    tried = stored(nearest_pairs(links.where("bits IS NOT NULL"), MOST))
    facts = F.struct("size", "prints")
    # spanning links name the first node of each side, which need not be within the budget of one another
    gaps = F.zip_with(*[F.slice(f"{end}.prints", 1, linking) for end in ("of_a", "of_b")], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    seen = stored(_beside(tried, rows, facts).select("a", "b", (near.column("of_a", "of_b") & (F.array_min(gaps) <= budget)).alias("ok")))
    sets = stored(shingle_sets(texts.join(wholes, "node", "left_semi").dropDuplicates(["node"]), words))

    def alike(links: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("of_a", "of_b"))
        whole = F.size("of_a") + F.size("of_b") - both
        return stored(_beside(links, sets, F.col("shingles")).where(both * 100 >= whole * percent).select("a", "b"))

    good = alike(seen.where("ok").select("a", "b"))
    labels = connected_components(good)
    label = F.coalesce("component", "node")
    broken = wholes.join(labels, "node", "left").groupBy("whole").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high").select("whole")
    rest = stored(rows.join(wholes.join(broken, "whole", "left_semi"), "node"))
    discard(links, wholes, seen)
    if rest.isEmpty():
        return labels
    near.most = MOST
    while True:
        labelled = rest.join(labels, "node", "left").withColumn("label", label).drop("component")
        # labels only grow together, so a node that no other label can hold any more needs no later round
        able = stored(shared_sizes(labelled, sets).where(F.col("shared") * 100 >= F.col("size") * percent))
        found = stored(fingerprint_links(able.select("node", "label", "size", "shared", "prints", first), budget, near).distinct())
        pairs = found.where("a <> b")
        nearest = stored(nearest_pairs(pairs, near.most))
        new = alike(nearest.join(tried, ["a", "b"], "left_anti"))
        good = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)
        left = not found.where("a = b").isEmpty() or nearest.count() < pairs.count()
        discard(found, rest)
        if not left:
            return connected_components(good)
        labels = connected_components(good)
        rest = able.drop("label", "shared")
        rest.stored_at = able.stored_at
        tried = tried.unionByName(nearest)
        near = Near(percent, prints["n"], near.most * GROWTH)


def shared_sizes(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes (node, whole, label, ...) with ``shared``: how many of a node's shingles some other label of its whole has, too.

    Nodes of two labels have no more than this in common. Shingles are compared by a hash taken with the whole, so
    ``shared`` may be too large, never too small.
    """
    each = labelled.select("node", "whole", "label").join(sets, "node").select("node", "label", F.explode("shingles").alias("s"), "whole")
    of = W.partitionBy("key")
    both = each.select(F.xxhash64("whole", "s").alias("key"), "node", "label").select("node", F.min("label").over(of).alias("low"), F.max("label").over(of).alias("high"))
    counts = both.where("low <> high").groupBy("node").agg(F.count("*").alias("shared"))
    return labelled.join(counts, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint")))


def nearest_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Of the distinct pairs (bits, a, b) those (a, b) in which one node is among the ``most`` nearest of the other."""
    ends = pairs.select("bits", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select("bits", F.col("b").alias("node"), F.col("a").alias("other")))
    place = F.row_number().over(W.partitionBy("node").orderBy("bits", "other"))  # tasks drop what is further off before the shuffle
    return ends.withColumn("place", place).where(F.col("place") <= most).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_components(
    docs: DataFrame, budget: int = 4, words: int = 4, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Every row with ``simhash`` (long) and ``component_id``: the smallest id that links reach, its own included.

    Texts with one fingerprint, and texts without words (fingerprint zero), are linked like any others. Null ids are
    passed over when the smallest is taken; a component with null ids only has a null one. Columns with an output's
    name are replaced. Only fingerprints are shuffled, joined and linked. With ``columns`` only these are returned;
    they are written beside the fingerprints, so that texts are read and hashed once instead of twice.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("simhash", "component_id")])
    printed = with_fingerprint(kept, text, words)
    if columns is not None:
        printed = stored(printed.select(*columns, "simhash"))
    return with_components(printed, budget, doc_id).drop("__component")


def with_components(printed: DataFrame, budget: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """Rows that have a ``simhash`` with ``component_id`` and ``__component``, the fingerprint that names the component."""
    narrow = cut_lineage(printed.groupBy("simhash").agg(F.min(doc_id).alias("least")))
    parts = print_components(narrow.select(F.col("simhash").alias("node"), F.array("simhash").alias("prints")), budget)
    joined = narrow.join(parts, F.col("simhash") == F.col("node"), "left").withColumn("__component", F.coalesce("component", "simhash"))
    least = joined.groupBy("__component").agg(F.min("least").alias("component_id"))
    labels = joined.join(least, "__component").select(F.col("simhash").alias("__print"), "__component", "component_id")
    return printed.join(labels, F.col("simhash") == F.col("__print")).drop("__print")


def keep_one(
    docs: DataFrame, budget: int = 4, words: int = 4, doc_id: str = "doc_id", text: str = "text", prints: int = 1, percent: int | None = None
) -> DataFrame:
    """One row of each component: that with the smallest id; of several rows with it, the first by a hash of their columns.

    Texts are linked if any of their ``prints`` fingerprints are within the budget: more of them find more of the less
    similar copies. With ``percent``, which takes half as many prints again to judge pairs by, a link holds only if the texts share so much of their distinct shingles (Jaccard
    similarity). Components are found from ids and hashes, written once; then one shuffle brings whole rows to the
    hashes kept.

    Null and empty texts, and texts of spaces only, have no shingles and are alike: one of them stays. Equal rows are
    one row of the result. An empty table gives none. Other columns are passed on whatever their names.
    """
    columns = hashable(docs)
    keyed = docs.withColumns({"__k1": F.xxhash64(*columns), "__k2": F.xxhash64(F.lit(1), *columns)})
    bare = keyed.select("__k1", "__k2", F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # the smallest id first, null last, then the hash
    first = F.min(F.struct(F.col("id").isNull(), "id", "__k1", "__k2"))
    if percent is None:
        narrow = stored(with_fingerprint(bare, "text", words, "prints", prints).select(F.col("__k1").alias("node"), "__k1", "__k2", "id", "prints"))
        parts = print_components(narrow.select("node", "prints"), budget)
    else:  # equal texts are one node
        t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
        texts = with_set_prints(bare.select("__k1", "__k2", "id", t1.alias("t1"), t2.alias("t2"), "text"), words, prints * 3 // 2).groupBy("t1", "t2")
        named = stored(texts.agg(first.alias("k"), F.first("prints").alias("prints"), F.first("size").alias("size")))
        # texts of one 64-bit hash: of n texts about n^2 / 2^65, some hundreds in 10^11, so that their hashes are broadcast
        same = stored(named.groupBy("t1").count().where("count > 1").select("t1", F.lit(True).alias("shared")))
        node = F.when(F.col("shared"), F.xxhash64(F.lit(2), "t1", "t2")).otherwise(F.col("t1")).alias("node")
        narrow = named.join(F.broadcast(same), "t1", "left").select(node, "k", "prints", "size")
        given = bare.select(t1.alias("t1"), t2.alias("t2"), "text").join(F.broadcast(same), "t1", "left").select(node, "text")
        parts = checked_components(narrow.select("node", "prints", "size"), given, budget, words, percent, prints)
    labelled = narrow.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = labelled.groupBy("component").agg((first if percent is None else F.min("k")).alias("k")).select("k.__k1", "k.__k2")
    return keyed.dropDuplicates(["__k1", "__k2"]).join(kept, ["__k1", "__k2"], "left_semi").select(*docs.columns)


def with_set_prints(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """(…, prints, size) instead of the last column, the text: prints of its distinct shingles, and how many these are."""

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            hashes, n = distinct_shingles(*utf8(part.column(part.num_columns - 1)), words)
            table = set_prints(hashes, n, prints).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * prints, pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(n.astype(np.int64))], [*part.schema.names[:-1], "prints", "size"])

    return docs.mapInArrow(run, plus(docs.schema.fields[:-1], "prints array<bigint>, size bigint"))
