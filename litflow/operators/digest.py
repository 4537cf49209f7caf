"""Digests: section picks, statistics, totals, alerts, suggested authors, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from litflow.functions import text as tx
from litflow.operators.scoring import Interest, author_parts_column, relevance_tags, same_author


def section_counts(scored: DataFrame, min_score: float) -> DataFrame:
    """Papers found and high-priority counts per interest."""
    ok = F.col("total_score") >= min_score
    return scored.groupBy("user_id", "interest_id").agg(
        F.count_if(ok).alias("found"),
        F.count_if(ok & (F.col("priority") == "immediate")).alias("immediate"),
        F.count_if(ok & (F.col("priority") == "weekly")).alias("weekly"),
    )


def title_key(title: Column) -> Column:
    return tx.strip(F.lower(title))


def digest_items(
    scored: DataFrame, min_score: float = 0.1, cap: int = 10, exclusive: bool = True
) -> DataFrame:
    """Up to ``cap`` papers per section, best first; adds ``position``.

    With ``exclusive`` a title appears once per digest, in the first section that takes it. Sections
    before a section hide at most ``cap`` titles each, so the best ``cap`` times as many distinct
    titles as the user has sections decide each of them; only those meet in one group per user.
    """
    rows = scored.where(F.col("total_score") >= min_score).withColumn("_key", title_key(F.col("title")))
    order = [F.col("total_score").desc(), F.col("paper_id")]
    by = ["user_id", "interest_id"]
    if not exclusive:
        w = W.partitionBy(*by).orderBy(*order)
        return rows.drop("_key").withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_key").alias("_k")).agg(
        F.min_by(whole, F.struct(-F.col("total_score"), "paper_id")).alias("r")
    ).select("r.*")
    w = W.partitionBy(*by).orderBy(*order)
    sections_of = best.select(*by).distinct().groupBy("user_id").agg(F.count("*").alias("_sections"))
    ranked = best.withColumn("_rn", F.row_number().over(w)).join(sections_of.withColumnRenamed("user_id", "_u"), F.col("user_id").eqNullSafe(F.col("_u")))
    short = ranked.where(F.col("_rn") <= cap * F.col("_sections")).drop("_rn", "_u", "_sections")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        pdf = pdf.sort_values(["interest_ord", "interest_id", "total_score", "paper_id"], ascending=[True, True, False, True])
        for _, section in pdf.groupby(["interest_ord", "interest_id"], sort=False):
            free = section[~section["_key"].isin(used)].head(cap).copy()
            free["position"] = range(1, len(free) + 1)
            used |= set(free["_key"])
            out.append(free)
        return pd.concat(out) if out else pdf.assign(position=0).head(0)

    schema = T.StructType([*short.schema.fields, T.StructField("position", T.IntegerType())])
    return short.groupBy("user_id").applyInPandas(pick, schema).drop("_key")


def sections(items: DataFrame, scored: DataFrame, min_score: float) -> DataFrame:
    """Per section: papers found by score, shown, and shown by priority."""
    found = section_counts(scored, min_score).select("user_id", "interest_id", F.col("found").alias("total_papers_found"))
    shown = items.groupBy("user_id", "interest_id").agg(
        F.count("*").alias("shown"), F.count_if(F.col("priority") == "immediate").alias("immediate_count"),
        F.count_if(F.col("priority") == "weekly").alias("weekly_count"),
    )
    return found.join(shown, ["user_id", "interest_id"], "left").na.fill(0, ["shown", "immediate_count", "weekly_count"])


def digest_totals(section_rows: DataFrame, digest_type: str = "weekly") -> DataFrame:
    """Per user: papers, sections, whether there is content, and the subject line."""
    t = section_rows.groupBy("user_id").agg(
        F.sum("shown").alias("total_papers"), F.count("*").alias("n_sections"),
        F.bool_or(F.col("shown") > 0).alias("has_content"),
    )
    return t.withColumn("subject", tx.subject_line(F.lit(digest_type), F.col("total_papers"), F.col("n_sections")))


def nested_digest(items: DataFrame) -> DataFrame:
    """One row per user with sections as arrays; their length is bounded by the section cap."""
    paper = F.struct("position", "paper_id", "title", "total_score", "priority")
    sec = items.groupBy("user_id", "interest_ord", "interest_id").agg(F.sort_array(F.collect_list(paper)).alias("papers"))
    return sec.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("interest_ord", "interest_id", "papers"))).alias("sections"))


def high_priority(scored: DataFrame, min_score: float = 0.1, levels: Sequence[str] = ("immediate", "weekly")) -> DataFrame:
    """Scored papers of the given priorities with at least ``min_score``."""
    return scored.where(F.col("priority").isin(*levels) & (F.col("total_score") >= min_score))


def enrich(
    items: DataFrame, interests: Sequence[Interest], n: int = 10, summarise: Callable[[Column, Column], Column] = tx.extractive_summary
) -> DataFrame:
    """Summary, relevance note and tags for the first ``n`` papers of each section.

    ``summarise`` maps title and abstract to a summary; it may wrap a ``pandas_udf``, which gets papers in batches.
    """
    note: Column = F.lit(None).cast("string")
    for i in interests:
        text = tx.relevance_note(i.name, i.keywords, F.col("abstract"), F.col("total_score"))
        note = F.when(F.col("interest_id") == i.interest_id, text).otherwise(note)
    first = F.col("position") <= n
    return items.withColumns({
        "summary": F.when(first, summarise(F.col("title"), F.col("abstract"))),
        "why_relevant": F.when(first, note),
        "tags": relevance_tags(),
        "authors_display": tx.authors_display(F.col("authors")),
        "score_percent": tx.score_percent(F.col("total_score")),
    })


def suggested_authors(items: DataFrame, followed: Sequence[str], min_score: float = 0.4, n: int = 5) -> DataFrame:
    """Authors of well-scored papers that nobody follows yet, by papers, with a first paper title."""
    a = F.lower("author")
    tests = [a.contains(f.lower()) | F.lit(f.lower()).contains(a) for f in followed]
    known = reduce(lambda x, y: x | y, tests) if tests else F.lit(False)
    rows = items.where(F.col("total_score") >= min_score).select(
        "title", "interest_ord", "position", F.explode(F.slice("authors", 1, 3)).alias("author"))
    return (
        rows.where(~known).groupBy("author")
        .agg(F.count("*").alias("paper_count"), F.min_by("title", F.struct("interest_ord", "position")).alias("sample_paper"))
        .orderBy(F.col("paper_count").desc(), "author").limit(n)
    )


def alerts(scored: DataFrame, min_score: float = 0.7, once_per_user: bool = False) -> DataFrame:
    """Papers to alert on; a paper may repeat per interest unless ``once_per_user``."""
    hits = scored.where(F.col("total_score") >= min_score)
    if not once_per_user:
        return hits
    whole = F.struct(*[F.col(c) for c in hits.columns])
    return hits.groupBy(F.col("user_id").alias("_u"), F.col("paper_id").alias("_p")).agg(
        F.max_by(whole, F.struct("total_score", "interest_id")).alias("r")).select("r.*")


def author_join(papers: DataFrame, followed: DataFrame) -> DataFrame:
    """``(paper_id, author, follower, followed)`` for all matching names.

    Names match only with equal last names and, when both have a first name, equal initials: the
    join runs on both, so a common last name is spread by initial. Names without a first name match
    every bearer of the last name and are joined on it alone. Equal names are matched once, papers and
    followers come back afterwards: a name that many papers or followers share costs no pairs of them before that.
    """
    bearers = papers.select("paper_id", F.explode("authors").alias("author")).distinct()
    fans = followed.select("follower", "followed").distinct()
    a = bearers.select("author").distinct().withColumn("a", author_parts_column(F.col("author")))
    b = fans.select("followed").distinct().withColumn("b", author_parts_column(F.col("followed")))

    def key(df: DataFrame, p: str) -> DataFrame:
        return df.withColumns({
            f"{p}l": F.col(f"{p}.last"), f"{p}i": F.substring(F.col(f"{p}.first"), 1, 1)})

    a, b = key(a, "a"), key(b, "b")
    same = same_author(F.col("a"), F.col("b.norm"), F.col("b.last"), F.col("b.first"))
    named = a.where("ai <> ''").join(b.where("bi <> ''"), (F.col("al") == F.col("bl")) & (F.col("ai") == F.col("bi")) & same)
    bare = a.where("ai = ''").join(b, F.col("al") == F.col("bl"))
    rest = a.where("ai <> ''").join(b.where("bi = ''"), F.col("al") == F.col("bl"))
    pairs = named.select("author", "followed").unionByName(bare.select("author", "followed")).unionByName(rest.select("author", "followed"))
    return bearers.join(pairs, "author").join(fans, "followed").select("paper_id", "author", "follower", "followed")
