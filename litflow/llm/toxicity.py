"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import lowered, plus, slices, span_hashes, span_sums, stored, utf8, words_of

#: Tokens and their stems are each counted in this many buckets by a hash, so that counts and scores have one size
#: whatever the vocabulary.
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Bytes of a longer token that are its stem; a token that tells nothing by itself scores as its stem does.
STEM = 5
PART_BYTES = 1 << 20

IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[48:58] = IN_TOKEN[97:123] = IN_TOKEN[128:] = True

def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (of the token, of its stem), start and end (bytes) of every token, and the first token of each row.

    Tokens are runs of letters and digits, A-Z lower-cased, every byte beyond ASCII a letter.
    """
    raw = lowered(raw)
    starts, ends, rows = words_of(raw, at, IN_TOKEN)
    if not len(starts):
        return np.zeros((0, 2), np.int32), starts, ends, rows
    sums = span_sums(raw)
    h = np.stack([span_hashes(*sums, starts, ends), span_hashes(*sums, starts, np.minimum(ends, starts + STEM))], axis=1)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + np.array([0, BUCKETS], np.int32), starts, ends, rows


# ---------------------------------------------------------------- segments


def segments(places: list[int], scores: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in one pass.

    Only its positive entries are given: their place, their score, and the sum of all entries before each. A segment is
    kept on a list with the sums left and right of it; a new one is joined to the nearest earlier segment with a
    smaller sum on its left, as long as the sum on that one's right is smaller than its own. No step looks at an
    entry twice but for joins, which remove a segment each.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum up to and with
    lower: list[int] = []  # of each: the nearest earlier one with a smaller sum before it, or -1
    for place, score, left in zip(places, scores, before, strict=True):
        first, last, right = place, place, left + score
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                found.append((first, last, left, right))
                lower.append(j)
                break
            first, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
            j -= 1
    return [(a, b, right - left) for a, b, left, right in found]


class Lexicon:
    """Scores of the buckets, and the extreme-value law of the best segment in a text without toxic passages.

    ``rate`` and ``scale`` are Karlin and Altschul's lambda and K: in n tokens of clean text about
    ``scale * n * exp(-rate * s)`` segments score s or more by chance. ``bias`` and ``slope`` turn evidence into a score.
    """

    def __init__(self, buckets: np.ndarray, scores: np.ndarray, drift: float, rate: float, scale: float = 1.0, bias: float = -3.0, slope: float = 1.0) -> None:
        self.buckets, self.scores, self.drift, self.rate, self.scale, self.bias, self.slope = buckets, scores, drift, rate, scale, bias, slope

    def table(self) -> np.ndarray:
        out = np.zeros(2 * BUCKETS, np.float32)
        out[self.buckets] = self.scores
        return out

    def of_rows(self, table: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> Iterator[list[tuple[int, int, float]]]:
        """The maximal segments of each row; every token costs the drift, tokens that tell nothing score nothing else."""
        own, stem = table[bucket[:, 0]], table[bucket[:, 1]]
        s = np.where(own != 0, own, stem).astype(float) - self.drift
        before = np.concatenate([[0.0], np.cumsum(s)])
        up = np.flatnonzero(s > 0)
        bounds = np.searchsorted(up, rows)
        for i in range(len(rows) - 1):
            mine = up[bounds[i] : bounds[i + 1]]
            if not len(mine):
                yield []
                continue
            yield segments(mine.tolist(), s[mine].tolist(), (before[mine] - before[rows[i]]).tolist())

    def expected(self, score: float, n: int) -> float:
        """How many segments of this score or more clean text of n tokens has by chance."""
        return self.scale * max(n, 1) * exp(-self.rate * score)

    def evidence(self, found: list[float], n: int) -> float:
        """Minus the logarithm of the chance that clean text has r segments together as good as the best r; the best r counts.

        r segments with normalised scores s = rate * score - ln(scale * n) have the tail s^(r-1) e^-s / (r! (r-1)!) of
        their sum; each more of them is paid for by a halved chance.
        """
        if not found:
            return 0.0
        shift, total, best = log(self.scale * max(n, 1)), 0.0, 0.0
        for r, score in enumerate(sorted(found, reverse=True), 1):
            total += self.rate * score - shift
            if r == 1:
                chance = -log(-np.expm1(-exp(min(-total, 50.0)))) if total < 30 else total
            else:
                chance = total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r)
            best = max(best, chance + (1 - r) * log(2))
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + exp(-max(-500.0, min(500.0, self.bias + self.slope * evidence))))


def karlin_rate(scores: np.ndarray, weights: np.ndarray, drift: float) -> float:
    """The positive solution x of sum(weights * exp(x * (scores - drift))) = 1, where what is left of the weights has score 0.

    It exists if some score is above the drift and the mean is below it; else the largest rate is given.
    """
    rest = max(0.0, 1.0 - float(weights.sum()))
    total = lambda x: float((weights * np.exp(np.minimum(x * (scores - drift), 700.0))).sum()) + rest * exp(-x * drift)
    low, high = 0.0, 1.0
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return low


# ---------------------------------------------------------------- learning


def training_rows(docs: DataFrame, labels: DataFrame, most: int, text: str, doc_id: str, label: str) -> DataFrame:
    """(k1, k2, toxic, clean, buckets) of each distinct labelled text that may be learned from: its token buckets in order.

    At most about ``most`` labelled ids, by a hash, are taken; their table has a bounded size and is broadcast, so texts
    stay where they are. Equal texts are one row that counts its labels; a text is toxic if at least half of them are.
    Several labels of an id count each; null ids and null labels are left out.
    """
    mine = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("id"))
    voted = mine.groupBy("id").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    n = voted.count()
    if n > most:
        voted = voted.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(voted), "id").select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "toxic", "clean", "text")

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            bucket, _, _, first = tokens(*utf8(part.column(4)))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(pa.array(2 * first, pa.int32()), pa.array(bucket.ravel()))], ["k1", "k2", "toxic", "clean", "buckets"])

    made = rows.mapInArrow(run, "k1 bigint, k2 bigint, toxic bigint, clean bigint, buckets array<int>")
    return made.groupBy("k1", "k2").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.first("buckets").alias("buckets"))


def _counts(rows: DataFrame) -> DataFrame:
    """(bucket, clean, toxic): texts of each label in which it occurs; a task adds up its texts before anything is shuffled."""

    def run(batches):
        sums = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for flag, buckets in zip(toxic, batch.column(1), strict=True):
                sums[int(flag), np.unique(buckets.values.to_numpy())] += 1
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[0, seen]), pa.array(sums[1, seen])], ["bucket", "clean", "toxic"])

    made = rows.select("toxic", "buckets").mapInArrow(run, "bucket int, clean bigint, toxic bigint")
    return made.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(prior: float, z: float) -> Column:
    """Shrunken log-odds of a bucket (clean, toxic of all_clean, all_toxic) under Dirichlet priors.

    The prior of both labels is the distribution of all labelled texts, each count times ``prior``. The log-odds count
    only as far as they are sure: ``z`` standard deviations are taken off towards zero.
    """
    alpha = (F.col("clean") + F.col("toxic")) * prior
    whole = (F.col("all_clean") + F.col("all_toxic")) * prior
    share = lambda kind: (F.col(kind) + alpha) / (F.col(f"all_{kind}") + whole)
    logit = lambda p: F.log(p) - F.log(F.greatest(1 - p, F.lit(1e-12)))
    odds = logit(share("toxic")) - logit(share("clean"))
    deviation = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    return F.signum(odds) * F.greatest(F.abs(odds) - z * deviation, F.lit(0.0))


def learn(
    docs: DataFrame, labels: DataFrame, most: int = 200_000, forms: tuple[tuple[float, float], ...] = ((0.1, 1.5), (0.3, 1.5), (0.3, 3.0), (1.0, 1.5)),
    drift: float = 0.5, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
) -> Lexicon:
    """The lexicon of labelled texts that are not held out; ``most`` bounds the labelled ids.

    Three quarters of the distinct texts give the tokens' log-odds, in ``forms`` of prior weight and certainty; the
    rest, which these have not seen, calibrates each form: clean texts the law of chance segments, all of them the
    score. The form of the smallest log loss there is kept. Without toxic or without clean texts no token scores.
    """
    rows = stored(
        training_rows(docs, labels, most, text, doc_id, label)
        .select((F.col("toxic") >= F.col("clean")).cast("int").alias("toxic"), (F.pmod("k1", F.lit(4)) == 0).alias("apart"), "buckets")
    )
    counts = stored(_counts(rows.where("NOT apart")))
    kinds = {bool(r["stem"]): r for r in counts.groupBy((F.col("bucket") >= BUCKETS).alias("stem")).agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).collect()}
    nothing = Lexicon(np.zeros(0, np.int32), np.zeros(0), drift, 1.0)
    if not kinds or not all(r["c"] and r["t"] for r in kinds.values()):
        return nothing
    of_kind = lambda name: F.when(F.col("bucket") < BUCKETS, kinds[False][name]).otherwise(kinds[True][name])
    scored = counts.withColumns({"all_clean": of_kind("c"), "all_toxic": of_kind("t")}).select("bucket", F.col("clean"), "all_clean", F.col("toxic"), "all_toxic", F.array(*[log_odds(*f) for f in forms]).alias("s"))
    found = scored.where(F.exists("s", lambda x: x != 0)).orderBy("bucket").toArrow()  # at most a row for each bucket
    if not found.num_rows:
        return nothing
    c, ac, t, at = (found.column(n).to_numpy() for n in ("clean", "all_clean", "toxic", "all_toxic"))
    s = np.array(found.column("s").to_pylist())
    bucket = found.column("bucket").to_numpy()
    models = []
    for k, (prior, _) in enumerate(forms):
        live = s[:, k] != 0
        background = ((c + prior * (c + t)) / (ac + prior * (ac + at)))[live] / 2  # tokens and stems are two views of one text
        models.append(Lexicon(bucket[live], s[live, k], drift, karlin_rate(s[live, k], background, drift)))
    return _calibrated(rows.where("apart").select("toxic", "buckets"), models)


def _calibrated(rows: DataFrame, models: list[Lexicon]) -> Lexicon:
    """The model of the smallest log loss on the rows, its scale, bias and slope set from them."""

    def best(batches):
        tables = [m.table() for m in models]
        for batch in batches:
            sizes, found = [], []
            for buckets in batch.column(1):
                b = buckets.values.to_numpy().reshape(-1, 2)
                sizes.append(len(b))
                found.append([[s for _, _, s in next(m.of_rows(t, b, np.array([0, len(b)])))] for m, t in zip(models, tables, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["toxic", "n", "found"])

    apart = stored(rows.mapInArrow(best, "toxic int, n bigint, found array<array<double>>"))
    # the likeliest scale, given the rate: as many texts as there are, against the sum of n * exp(-rate * best score)
    best_of = lambda k: F.coalesce(F.array_max(F.col("found")[k]), F.lit(0.0))
    law = apart.where("toxic = 0 AND n > 0").agg(F.count("*").alias("m"), *[F.sum(F.col("n") * F.exp(-m.rate * best_of(k))).alias(f"s{k}") for k, m in enumerate(models)]).first()
    for k, m in enumerate(models):
        if law["m"] and law[f"s{k}"]:
            m.scale = law["m"] / law[f"s{k}"]

    def weigh(batches):
        for batch in batches:
            for k, m in enumerate(models):
                x = [round(min(m.evidence(found[k], n), 100.0), 1) for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.int32()), batch.column(0), pa.array(x, pa.float64())], ["model", "toxic", "x"])

    steps = apart.mapInArrow(weigh, "model int, toxic int, x double").groupBy("model", "x").agg(F.sum("toxic").alias("one"), F.sum(1 - F.col("toxic")).alias("zero")).collect()
    losses = []  # from a thousand steps of evidence for each model at most
    for k, m in enumerate(models):
        x, one, zero = np.array([(r["x"], r["one"], r["zero"]) for r in steps if r["model"] == k], float).reshape(-1, 3).T
        m.bias, m.slope = logistic(x, one, zero)
        p = np.clip(1 / (1 + np.exp(-np.clip(m.bias + m.slope * x, -500, 500))), 1e-12, 1 - 1e-12)
        losses.append(-(one * np.log(p) + zero * np.log(1 - p)).sum())
    return models[int(np.argmin(losses))]


def logistic(x: np.ndarray, one: np.ndarray, zero: np.ndarray, prior: tuple[float, float] = (-3.0, 1.0), weight: float = 1.0) -> tuple[float, float]:
    """Bias and slope of the likeliest logistic curve for counts at x, held near ``prior`` by a normal law of ``weight``; the slope is not negative."""
    at = np.array(prior)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -500, 500)))
        n = one + zero
        slope = np.array([(one - n * p).sum(), ((one - n * p) * x).sum()]) - weight * (at - prior)
        w = n * p * (1 - p)
        bend = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + weight * np.eye(2)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Lexicon, text: str = "text", most_expected: float = 0.05) -> DataFrame:
    """Adds ``score`` (0 to 1), ``evidence``, ``n_passages`` and ``passages``: every significant toxic segment of the text.

    A passage (start, end in code points, score, expected) is a maximal segment of which clean text of this length has
    ``most_expected`` or fewer by chance. Null, empty and tokenless texts have no passage and the score of no evidence.
    Repeated rows are rows of their own; columns of the input with an output's name are replaced. The scores of the
    buckets that tell something go to every task; a task's table of all buckets has 8 MB.
    """
    names = ("score", "evidence", "n_passages", "passages")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        table = model.table()
        for part in slices(batches, text, PART_BYTES):
            raw, at = utf8(part.column(part.schema.get_field_index(text)))
            bucket, starts, ends, rows = tokens(raw, at)
            letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
            scores, evidence, passages = [], [], []
            for i, found in enumerate(model.of_rows(table, bucket, rows)):
                n, base = int(rows[i + 1] - rows[i]), int(letters[at[i]])
                x = model.evidence([s for _, _, s in found], n)
                evidence.append(x)
                scores.append(model.score(x))
                passages.append([
                    {"start": int(letters[starts[a]]) - base, "end": int(letters[ends[b]]) - base, "score": s, "expected": model.expected(s, n)}
                    for a, b, s in found if model.expected(s, n) <= most_expected
                ])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, kind)],
                [*part.schema.names, *names],
            )

    fields = "score double, evidence double, n_passages int, passages array<struct<start: bigint, `end`: bigint, score: double, expected: double>>"
    return kept.mapInArrow(run, plus(kept.schema.fields, fields))
