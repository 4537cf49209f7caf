"""Language identification: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litflow.llm.common import cut_lineage, lowered, plus, slices, utf8

#: Families of languages by ISO code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
}
UNKNOWN = "und"

#: Hash buckets of byte n-grams of one length, and these lengths.
BUCKET_BITS, GRAMS = 11, (2, 3, 4)
BUCKETS = 1 << BUCKET_BITS
WIDTH = BUCKETS * len(GRAMS)
#: Rows whose features are held at once.
ROWS = 64
PART_BYTES = 3 << 18

IN_WORD = np.zeros(256, bool)
IN_WORD[97:123] = IN_WORD[128:] = True


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of hashed byte n-gram counts for each text, square roots scaled to length 1.

    A-Z are lower-cased and bytes that are no letters become one space, so n-grams see where words begin and end.
    """
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    low = lowered(raw)
    member = IN_WORD[low]
    low = np.where(member, low, 32).astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(at))
    again = np.zeros(len(low), bool)
    again[1:] = ~member[1:] & ~member[:-1] & (row[1:] == row[:-1])
    low, row = low[~again], row[~again]
    for k, size in enumerate(GRAMS):
        if len(low) < size:
            continue
        m = len(low) - size + 1
        value = np.zeros(m, np.uint32)
        for j in range(size):
            value = value * np.uint32(0x01000193) + low[j : j + m] + np.uint32(1)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        bucket = (value >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        inside = row[:m] == row[size - 1 :]
        counts = np.bincount(row[:m][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = counts.reshape(n, BUCKETS)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def fit_svm(rows: np.ndarray, y: np.ndarray, penalty: float = 8.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent.

    ``y`` is 1 or -1. The last column of ``rows`` is 1, its weight the bias. The two sides weigh alike however many
    rows they have.
    """
    n = len(rows)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * penalty * share)
    square = np.einsum("ij,ij->i", rows, rows) + diagonal
    weights, alpha = np.zeros(rows.shape[1], np.float32), np.zeros(n)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            slope = y[i] * float(rows[i] @ weights) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * y[i]) * rows[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights


def training_sample(docs: DataFrame, per_language: int, most: int, languages: int, text: str, lang: str, by: str) -> DataFrame:
    """At most ``per_language`` rows of each of the ``languages`` most frequent languages, and ``most`` in all, by a hash
    of the id; texts need a letter.

    Counts come first (of whole rows, at most ``languages`` of them), so that only about twice the rows needed are
    sent to the window that takes the exact number.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(by).cast("string"), F.lit(""))).alias("turn")
    )
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return rows.select("text", "lang").limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 20, -(-(per_language << 21) // r["count"]))))])
    few = rows.where(F.pmod("turn", F.lit(1 << 20)) < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("turn", F.xxhash64("text")))
    return few.withColumn("place", place).where(F.col("place") <= per_language).orderBy("place", "lang").limit(most).select("text", "lang")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", per_language: int = 600, most: int = 6_000, languages: int = 200) -> dict:
    """The models: ``langs``, and weights for each pair of families and each pair of languages in a family.

    Each pair is fitted in a task of its own on at most ``2 * per_language`` sampled rows of its two sides (families
    take up to that many rows of their languages together); ``per_language``, ``most`` and ``languages`` bound the sample.
    """
    sample = training_sample(docs, per_language, most, languages, text, lang, by)

    def vectors(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text", PART_BYTES):
            for lo in range(0, part.num_rows, ROWS):
                piece = part.slice(lo, ROWS)
                x = features(*utf8(piece.column(0))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    held = cut_lineage(sample.mapInArrow(vectors, "lang string, x binary"))
    langs = sorted(r["lang"] for r in held.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in langs})
    sides: list[tuple[str, str, str]] = []  # pair, language, side
    for a, b in combinations(families, 2):
        sides += [(f"family\t{a}\t{b}", x, a if family_of(x) == a else b) for x in langs if family_of(x) in (a, b)]
    for f in families:
        for a, b in combinations([x for x in langs if family_of(x) == f], 2):
            sides += [(f"lang\t{a}\t{b}", a, a), (f"lang\t{a}\t{b}", b, b)]
    weights: dict[str, np.ndarray] = {}
    if sides:
        table = F.create_map(*[v for x in langs for v in (F.lit(x), F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(s).alias("side")) for p, y, s in sides if y == x]).cast("array<struct<pair:string,side:string>>"))])
        spread = held.withColumn("at", F.explode(table[F.col("lang")])).select("at.*", "x")

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            pair = frame["pair"].iloc[0]
            one = pair.split("\t")[1]
            vectors, side = frame["x"].to_numpy(), frame["side"].to_numpy()
            order = np.lexsort((vectors, side))  # the same rows give the same weights
            rows = np.ones((len(order), WIDTH + 1), np.float32)
            for i, k in enumerate(order):
                rows[i, :-1] = np.frombuffer(vectors[k], np.float16)
            weights = fit_svm(rows, np.where(side[order] == one, 1.0, -1.0))
            return pd.DataFrame({"pair": [pair], "w": [weights.astype(np.float32).tobytes()]})

        fitted = spread.groupBy("pair").applyInPandas(fit, "pair string, w binary")
        weights = {r["pair"]: np.frombuffer(bytes(r["w"]), np.float32) for r in fitted.collect()}
    return {"langs": langs, "weights": weights}


def _vote(x: np.ndarray, names: list[str], kind: str, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with most wins (then the largest margins) for each row, and its least margin."""
    wins = np.zeros((len(x), len(names)))
    worst = np.full((len(x), len(names)), np.inf)
    for i, j in combinations(range(len(names)), 2):
        w = weights.get(f"{kind}\t{names[i]}\t{names[j]}")
        if w is None:
            continue
        margin = x @ w[:-1] + w[-1]
        soft = np.tanh(margin) * 1e-3
        wins[:, i] += (margin >= 0) + soft
        wins[:, j] += (margin < 0) - soft
        worst[:, i] = np.minimum(worst[:, i], margin)
        worst[:, j] = np.minimum(worst[:, j], -margin)
    best = wins.argmax(axis=1)
    return best, worst[np.arange(len(x)), best]


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1: how clear the closest decisions on the way were) to every row.

    Whole texts count. Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language was learned; one learned language is the answer for all others. Output names replace columns.
    """
    langs, weights = model["langs"], model["weights"]
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    rows = kept.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, text, PART_BYTES):
            for lo in range(0, part.num_rows, ROWS):
                piece = part.slice(lo, ROWS)
                letters = piece.column(len(columns)).to_numpy(zero_copy_only=False)
                name, score = np.full(piece.num_rows, UNKNOWN, object), np.zeros(piece.num_rows)
                if langs and letters.any():
                    x = features(*utf8(piece.column(columns.index(text))))
                    family, clear = _vote(x, families, "family", weights)
                    chance = 1 / (1 + np.exp(-4 * clear))
                    for f, names in enumerate(families):
                        mine = np.flatnonzero((family == f) & letters)
                        if len(mine):
                            lang, near = _vote(x[mine], members[names], "lang", weights)
                            name[mine] = np.array(members[names], object)[lang]
                            score[mine] = chance[mine] / (1 + np.exp(-4 * near))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(name.tolist(), pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    return rows.mapInArrow(run, plus(kept.schema.fields, "lang_pred string, score double"))


def held_out(by: str = "doc_id"):
    """Rows that are kept from learning: crc32 of the id as text is 2 modulo 4 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(by).cast("string").cast("binary")) % 4 == 2, F.lit(False))
