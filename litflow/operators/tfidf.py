"""Corpus TF-IDF: fit a vocabulary table, store it, score texts against interests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litflow.functions import text as tx
from litflow.operators.scoring import Interest, interest_profile_text

# Fixed value: what counts as a token.
TOKEN = r"(?U)\b[a-zA-Z][a-zA-Z0-9-]*[a-zA-Z0-9]\b|\b[a-zA-Z]\b"


@lru_cache
def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


def terms(text: Column) -> Column:
    """Uni- and bigrams of a text after stop-word removal."""
    plain = F.translate(F.lower(text), *_accent_table())
    toks = F.filter(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*tx.TFIDF_STOP))
    return F.transform(F.array(toks), lambda t: F.concat(t, tx.bigrams(t)))[0]


def term_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(key, F.explode(terms(text)).alias("term")).groupBy(key, "term").agg(
        F.count("*").alias("tf")
    )


def fit(
    docs: DataFrame, key: str, text: Column, max_features: int = 5000, min_df: int = 1, max_df: float = 0.95
) -> DataFrame:
    """Vocabulary ``(term, df, cf, idf)`` with smooth idf, most frequent terms first, ties by term.

    Two shuffles, both after map-side counting; the result never exceeds ``max_features`` rows.
    """
    held = docs.where(tx.strip(text) != "")
    n = held.select(F.count("*")).scalar()
    counts = term_counts(held, key, text).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    top = kept.orderBy(F.col("cf").desc(), "term").limit(max_features)
    return top.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _weights(docs: DataFrame, key: str, text: Column, model: DataFrame) -> DataFrame:
    vocab = F.broadcast(model.select("term", "idf"))  # at most max_features rows
    hits = docs.select(key, F.explode(terms(text)).alias("term")).join(vocab, "term")
    return hits.groupBy(key, "term").agg((F.count("*") * F.first("idf")).alias("w"))


def score(
    docs: DataFrame, key: str, text: Column, model: DataFrame, interests: Sequence[Interest]
) -> DataFrame:
    """Cosine of each text with each interest of a batch: ``(key, interest_id, tfidf_score)``."""
    spark = docs.sparkSession
    profiles = spark.createDataFrame(
        [(i.interest_id, interest_profile_text(i)) for i in interests], "interest_id string, profile string"
    )
    pw = _weights(profiles, "interest_id", F.col("profile"), model)
    pn = pw.groupBy("interest_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("pn"))
    p = pw.join(pn, "interest_id").select("interest_id", "term", (F.col("w") / F.col("pn")).alias("pw"))
    dw = _weights(docs, key, text, model)
    # one pass over a document's terms yields its norm and, through the profile map, every dot product
    lookup = p.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("interest_id", "pw"))).alias("m"))
    marked = dw.join(F.broadcast(lookup), "term", "left")
    ids = [i.interest_id for i in interests]
    agg = marked.groupBy(key).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"),
        *[F.sum(F.col("w") * F.try_element_at("m", F.lit(i))).alias(f"d{n}") for n, i in enumerate(ids)],
    )
    pairs = F.inline(F.array(*[
        F.struct(F.lit(i).alias("interest_id"), (F.col(f"d{n}") / F.col("dn")).alias("c")) for n, i in enumerate(ids)
    ]))
    cos = agg.select(key, pairs)
    all_pairs = docs.select(
        key, (tx.strip(text) == "").alias("blank"), F.explode(F.array(*[F.lit(i) for i in ids])).alias("interest_id")
    )
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0))))
    return all_pairs.join(cos, [key, "interest_id"], "left").select(
        key, "interest_id", F.when(F.col("blank"), 0.5).otherwise(s).alias("tfidf_score")
    )
