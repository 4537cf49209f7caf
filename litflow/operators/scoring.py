"""Weighted relevance scoring of papers against research interests.

Every component is a Column built from a paper row and one fixed interest, so a batch of interests
is scored in a single pass over the papers: no join, no shuffle. Interests arrive in batches of a
bounded size; more interests mean more passes, never a bigger broadcast.
"""

from __future__ import annotations

import math
import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from litflow.functions import text as tx
from litflow.functions import vectors as vx
from litflow.session import small_batches

# Phrases that hint at a new finding.
NOVELTY_PHRASES = (
    "novel", "new method", "new approach", "first", "breakthrough", "unprecedented", "innovative",
    "state-of-the-art", "outperforms", "surpasses", "introduces", "we propose", "we present",
    "we develop", "framework", "architecture",
)
# Phrases that name a technique.
METHOD_PHRASES = (
    "algorithm", "neural network", "deep learning", "machine learning", "transformer",
    "attention mechanism", "graph neural", "force field", "enhanced sampling", "free energy",
    "collective variable", "metadynamics", "replica exchange",
)
# Default component weights and priority thresholds.
DEFAULT_WEIGHTS = {
    "semantic": 0.30, "keyword": 0.15, "author": 0.15, "novelty": 0.05,
    "citation": 0.15, "recency": 0.10, "tfidf": 0.05, "field_of_study": 0.05,
}
PRIORITY_LEVEL = {"immediate": 0, "weekly": 1, "monthly": 2, "low": 3}
INTERESTS_PER_PASS = 32


@dataclass(frozen=True)
class Interest:
    interest_id: str
    name: str
    user_id: str = "u0"
    ord: int = 0
    description: str | None = None
    keywords: tuple[str, ...] = ()
    excluded_keywords: tuple[str, ...] = ()
    followed_authors: tuple[str, ...] = ()
    followed_journals: tuple[str, ...] = ()
    fields_of_study: tuple[str, ...] = ()
    embedding: tuple[float, ...] | None = None
    weights: dict[str, float] | None = None
    threshold_immediate: float | None = None
    threshold_weekly: float | None = None

    @staticmethod
    def from_row(row: Row) -> Interest:
        d = row.asDict(recursive=True)
        known = {k: d[k] for k in Interest.__dataclass_fields__ if d.get(k) is not None}
        return Interest(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    disabled: frozenset[str] = frozenset()
    threshold_immediate: float = 0.8
    threshold_weekly: float = 0.5
    threshold_monthly: float = 0.3
    citation_very_high: int = 200
    recency_half_life_days: int = 90
    recency_max_age_days: int = 730
    recency_bonus: float = 0.1

    @property
    def active(self) -> list[str]:
        return [n for n in self.weights if n not in self.disabled]

    def validate(self) -> float:
        """Sum of the active weights; warns when it is not one."""
        total = sum(self.weights[n] for n in self.active)
        if abs(total - 1.0) > 0.01:
            warnings.warn(f"scorer weights sum to {total:.3f}, not 1", stacklevel=2)
        return total


# ---------------------------------------------------------------- component expressions
# The factors, caps and bonuses inside the components below.


def semantic_score(cos: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), cos) * 2.5)


def matched_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in ``text`` as whole words, in given order."""
    if not phrases:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(tx.contains_phrase(text, p), F.lit(p)) for p in phrases]))


def keyword_score(n_matched: Column, n_excluded: Column, n_keywords: int) -> Column:
    if n_keywords == 0:
        return F.lit(0.5)
    penalty = F.least(F.lit(0.5), n_excluded * F.lit(0.2))
    return F.greatest(F.lit(0.0), F.sqrt(n_matched / F.lit(float(n_keywords))) - penalty)


# Fixed value: name suffixes that do not tell authors apart.
_SUFFIX = r"\s+(jr\.?|sr\.?|iii?|iv)$"


def author_parts(name: str) -> tuple[str, str, str]:
    """(normalised, last, first) of a fixed name."""
    folded = re.sub(r"\s+", " ", re.sub(_SUFFIX, "", name.lower().strip()))
    if "," in folded:
        last, first = (s.strip() for s in folded.split(",", 1))
        return folded, last, first
    first, _, last = folded.rpartition(" ")
    return folded, last, first


def author_parts_column(name: Column) -> Column:
    """STRUCT<norm, last, first> of a name column."""
    folded = F.regexp_replace(F.regexp_replace(tx.strip(F.lower(name)), _SUFFIX, ""), r"\s+", " ")
    has_comma = folded.contains(",")
    comma_last = tx.strip(F.substring_index(folded, ",", 1))
    comma_first = tx.strip(F.regexp_replace(folded, r"^[^,]*,", ""))
    plain_last = F.substring_index(folded, " ", -1)
    plain_first = F.when(folded.contains(" "), F.regexp_replace(folded, r" [^ ]*$", "")).otherwise(F.lit(""))
    return F.struct(
        folded.alias("norm"),
        F.when(has_comma, comma_last).otherwise(plain_last).alias("last"),
        F.when(has_comma, comma_first).otherwise(plain_first).alias("first"),
    )


def same_author(a: Column, b_norm: Column, b_last: Column, b_first: Column) -> Column:
    """Name match on parts: equal, or equal last names with compatible first names."""
    both = (a["first"] != "") & (b_first != "")
    initial = (F.length(a["first"]) <= 2) | (F.length(b_first) <= 2)
    first_ok = F.when(
        both,
        F.when(initial, F.substring(a["first"], 1, 1) == F.substring(b_first, 1, 1)).otherwise(
            a["first"] == b_first
        ),
    ).otherwise(F.lit(True))
    return (a["norm"] == b_norm) | ((a["last"] == b_last) & first_ok)


def parsed_authors(authors: Column) -> Column:
    """ARRAY<STRUCT<raw, norm, last, first>>; names are taken apart once per paper."""
    return F.transform(
        F.transform(authors, lambda a: F.struct(a.alias("raw"), author_parts_column(a).alias("p"))),
        lambda x: F.struct(
            x["raw"].alias("raw"), x["p"]["norm"].alias("norm"), x["p"]["last"].alias("last"),
            x["p"]["first"].alias("first"),
        ),
    )


def matched_authors(parsed: Column, followed: Sequence[str]) -> Column:
    """The paper's authors (from ``parsed_authors``) that match any followed name."""
    if not followed:
        return F.array().cast("array<string>")
    fixed = [author_parts(f) for f in followed]
    lasts = sorted({la for _, la, _ in fixed})

    def hit(a: Column) -> Column:
        tests = [same_author(a, F.lit(n), F.lit(la), F.lit(fi)) for n, la, fi in fixed]
        return a["last"].isin(*lasts) & reduce(lambda x, y: x | y, tests)

    return F.transform(F.filter(parsed, hit), lambda a: a["raw"])


def author_score(n_authors: Column, n_matched: Column, n_followed: int) -> Column:
    if n_followed == 0:
        return F.lit(0.5)
    none = (F.coalesce(n_authors, F.lit(0)) <= 0) | (n_matched <= 0)
    return F.when(none, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.lit(0.7) + n_matched * F.lit(0.1))
    )


def _hits(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def novelty_score(text: Column) -> Column:
    new = F.least(F.lit(1.0), _hits(text, NOVELTY_PHRASES) * F.lit(0.15))
    method = F.least(F.lit(0.5), _hits(text, METHOD_PHRASES) * F.lit(0.1))
    return F.least(F.lit(1.0), new + method)


def journal_score(journal: Column, followed: Sequence[str]) -> Column:
    if not followed:
        return F.lit(0.5)
    name = tx.strip(F.lower(journal))
    tests = []
    for f in followed:
        g = f.lower().strip()
        tests.append(name.contains(g) | F.lit(g).contains(name))
    hit = reduce(lambda a, b: a | b, tests)
    return F.when(F.coalesce(journal, F.lit("")) == "", F.lit(0.5)).when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def citation_score(count: Column, influential: Column, very_high: int = 200) -> Column:
    base = F.when(count == 0, F.lit(0.3)).otherwise(
        F.least(F.lit(1.0), F.log1p(count) / F.lit(math.log1p(very_high)))
    )
    ratio = influential / F.greatest(count, F.lit(1))
    bonus = F.when(influential > 0, F.least(F.lit(0.2), ratio * 0.5)).otherwise(F.lit(0.0))
    return F.when(count.isNull(), F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), base * 0.8 + bonus + 0.1)
    )


def age_days(as_of: Column, ts: Column) -> Column:
    """Whole days between two instants, rounded down."""
    return F.floor((F.unix_seconds(as_of) - F.unix_seconds(ts)) / 86400)


def recency_score(published: Column, year: Column, as_of: Column, cfg: ScoringConfig) -> Column:
    zero = F.lit(0)
    mid_year = F.make_timestamp(year, F.lit(7), F.lit(1), zero, zero, zero)
    age = F.greatest(age_days(as_of, F.coalesce(published, mid_year)), F.lit(0))
    bonus = F.when(age < 7, F.lit(cfg.recency_bonus) * (1 - age / 7)).otherwise(F.lit(0.0))
    decayed = F.exp(age * F.lit(-0.693 / cfg.recency_half_life_days))
    return (
        F.when(age.isNull(), F.lit(0.5))
        .when(age > cfg.recency_max_age_days, F.lit(0.1))
        .otherwise(F.least(F.lit(1.0), decayed + bonus))
    )


def field_score(fields: Column, wanted: Sequence[str]) -> Column:
    mine = F.array_distinct(F.transform(fields, F.lower))
    want = sorted({w.lower() for w in wanted})
    if not want:
        return F.lit(0.5)
    lit = F.array(*[F.lit(w) for w in want])
    both = F.size(F.array_intersect(mine, lit))
    n = F.size(mine)
    union = n + len(want) - both
    score = 0.4 * both / union + 0.6 * both / F.least(n, F.lit(len(want)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.5)).otherwise(score)


# ---------------------------------------------------------------- pairwise TF-IDF

_PAIR_TOKEN = re.compile(r"\b\w\w+\b")
_UNSHARED_IDF = math.log(1.5) + 1.0
PAIR_MAX_FEATURES = 1000


def pair_tokens(text: str) -> list[str]:
    return [t for t in _PAIR_TOKEN.findall(text.lower()) if t not in _TFIDF_STOP_SET]


def pair_terms(toks: list[str]) -> Counter:
    """Uni- and bigram counts of tokens without stop words."""
    counts = Counter(toks)
    counts.update([f"{a} {b}" for a, b in zip(toks, toks[1:])])
    return counts


_TFIDF_STOP_SET = frozenset(tx.TFIDF_STOP)


class RankedTerms:
    """The terms of one paper, counted and ranked once for however many profiles they are compared with."""

    def __init__(self, counts: Counter):
        self.counts = counts
        self.squares = sum(n * n for n in counts.values())

    @cached_property
    def ranked(self) -> tuple[list[tuple[int, str]], list[int]]:
        """(-count, term) in order, and the squared counts summed up to each place."""
        keys = sorted((-n, t) for t, n in self.counts.items())
        return keys, [0, *accumulate(n * n for n, _ in keys)]

    def tfidf(self, other: Counter, max_features: int = PAIR_MAX_FEATURES) -> float:
        """Cosine of the two-document TF-IDF vectors.

        With two documents a shared term has idf 1 and any other term ln(1.5)+1. When the joint
        vocabulary is larger than ``max_features`` the most frequent terms stay, ties by term.
        """
        paper = self.counts
        if not paper and not other:
            return 0.5
        shared = [t for t in other if t in paper]
        if not shared:
            return 0.0
        kept = list(other)
        rest = self.squares - sum(paper[t] ** 2 for t in shared)  # of the terms that only the paper has
        if len(paper) + len(other) - len(shared) > max_features:
            keys, upto = self.ranked
            # shared terms leave their places in the paper's order and meet it again with their joint counts
            moved = sorted((-paper[t], t) for t in shared)
            joint = sorted((-paper.get(t, 0) - n, t) for t, n in other.items())
            kept = [k[1] for i, k in enumerate(joint) if i + bisect_left(keys, k) - bisect_left(moved, k) < max_features]
            end, gone = max_features - len(kept), 0
            for key in moved:
                if bisect_left(keys, key) < end:
                    end += 1
                    gone += key[0] ** 2
            rest = upto[end] - gone
        both = [t for t in kept if t in paper]
        dot = sum(paper[t] * other[t] for t in both)
        if dot == 0:
            return 0.0
        unshared = _UNSHARED_IDF**2
        mine = sum(paper[t] ** 2 for t in both) + unshared * rest
        theirs = sum(other[t] ** 2 * (1.0 if t in paper else unshared) for t in kept)
        return dot / math.sqrt(mine * theirs)


def pair_tfidf(paper: Counter, other: Counter, max_features: int = PAIR_MAX_FEATURES) -> float:
    return RankedTerms(paper).tfidf(other, max_features)


def interest_profile_text(i: Interest) -> str:
    parts = [i.description or "", " ".join(i.keywords), " ".join(i.fields_of_study)]
    return " ".join(p for p in parts if p) or i.name


def pair_tfidf_udf(interests: Sequence[Interest]):
    """Arrow UDF from paper text to its TF-IDF score with every interest of the batch."""
    profiles = [interest_profile_text(i) for i in interests]
    profile_terms = [pair_terms(pair_tokens(p)) for p in profiles]
    known = frozenset(t for q in profile_terms for t in q)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for t in texts:
                blank = not (t or "").strip()
                toks = [] if blank else pair_tokens(t)
                if toks and known.isdisjoint(toks):
                    # no shared word, hence no shared bigram: every cosine is zero
                    rows.append([0.0 if p.strip() else 0.5 for p in profiles])
                    continue
                terms = RankedTerms(pair_terms(toks))
                rows.append([
                    0.5 if blank or not p.strip() else terms.tfidf(q)
                    for p, q in zip(profiles, profile_terms)
                ])
            yield pd.Series(rows)

    return score


# ---------------------------------------------------------------- scorer registry


@dataclass(frozen=True)
class PaperView:
    """Columns a scorer may use; ``text`` is the lower-cased title and abstract."""

    text: Column
    row: Callable[[str], Column]
    as_of: Column
    slot: int


Scorer = Callable[[PaperView, Interest, ScoringConfig], Column]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Add or replace a scorer that returns a Column; one in Python goes to ``register_python_scorer``."""
    SCORERS[name] = scorer


def register_python_scorer(name: str, inputs: Sequence[str], score: Callable[[pd.DataFrame, Interest, ScoringConfig], pd.Series]) -> None:
    """Add a scorer in Python: it gets a batch of rows with the columns ``inputs`` (``text`` is the lower-cased title and
    abstract). Rows for which it raises count as 0.5, as does null; the other rows and the job go on."""

    def build(view: PaperView, interest: Interest, cfg: ScoringConfig) -> Column:
        row = F.struct(*[(view.text if c == "text" else view.row(c)).alias(c) for c in inputs])
        return guarded(lambda rows: score(rows, interest, cfg))(row)

    register_scorer(name, build)


register_scorer("semantic", lambda p, i, c: semantic_score(p.row(f"_cosine{p.slot}")))
register_scorer(
    "keyword",
    lambda p, i, c: keyword_score(
        F.size(p.row(f"_keywords{p.slot}")),
        F.size(matched_phrases(p.text, i.excluded_keywords)),
        len(i.keywords),
    ),
)
register_scorer(
    "author",
    lambda p, i, c: author_score(
        F.size(p.row("_authors")),
        F.size(p.row(f"_followed{p.slot}")),
        len(i.followed_authors),
    ),
)
register_scorer("novelty", lambda p, i, c: novelty_score(p.text))
register_scorer("journal", lambda p, i, c: journal_score(p.row("journal"), i.followed_journals))
register_scorer(
    "citation",
    lambda p, i, c: citation_score(
        p.row("citation_count"), p.row("influential_citation_count"), c.citation_very_high
    ),
)
register_scorer(
    "recency", lambda p, i, c: recency_score(p.row("published_date"), p.row("year"), p.as_of, c)
)
register_scorer("tfidf", lambda p, i, c: F.get(p.row("_tfidf"), F.lit(p.slot)))
register_scorer("field_of_study", lambda p, i, c: field_score(p.row("fields_of_study"), i.fields_of_study))

# components that do not depend on the interest; computed once per paper
_PAPER_ONLY = ("novelty", "citation", "recency")


def priority(total: Column, immediate: float, weekly: float, monthly: float) -> Column:
    return (
        F.when(total >= immediate, "immediate").when(total >= weekly, "weekly")
        .when(total >= monthly, "monthly").otherwise("low")
    )


def weighted_total(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    total = reduce(lambda a, b: a + b, [scores[n] * F.lit(float(weights[n])) for n in scores])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def guarded(score: Callable[[pd.Series], pd.Series]):
    """Arrow UDF from ``score``; rows for which it raises are null, which counts as 0.5."""

    @F.pandas_udf(T.DoubleType())
    def run(values: pd.Series) -> pd.Series:
        try:
            return score(values)
        except Exception:
            out = []
            for i in range(len(values)):
                try:
                    out.append(float(score(values.iloc[i : i + 1]).iloc[0]))
                except Exception:
                    out.append(None)
            return pd.Series(out, dtype="float64")

    return run


def _component(name: str, view: PaperView, interest: Interest, cfg: ScoringConfig) -> Column:
    """A component's Column; null, and a scorer that cannot be built, count as 0.5."""
    try:
        return F.coalesce(SCORERS[name](view, interest, cfg), F.lit(0.5))
    except Exception as e:
        warnings.warn(f"scorer {name} failed: {e}", stacklevel=2)
        return F.lit(0.5)


def _score_batch(
    papers: DataFrame, batch: Sequence[Interest], cfg: ScoringConfig, as_of: Column,
    keep: Sequence[str], custom_cosine: Callable | None,
) -> DataFrame:
    active = cfg.active
    df = papers.withColumns({
        "_text": tx.joined_text(F.col("title"), F.col("abstract")),
        "_authors": parsed_authors(F.col("authors")),
    })
    if "semantic" in active:
        if custom_cosine is not None:
            df = df.withColumn("_cosines", custom_cosine(batch))
        else:
            mat = np.array([vx.hashed_embedding(vx.interest_text(i.name, i.description, i.keywords)) for i in batch])
            df = df.withColumn(
                "_cosines", vx.cosines_to(mat)(vx.paper_text(F.col("title"), F.col("abstract")))
            )
        # stored vectors are compared with stored ones, hashed texts with hashed texts, never one with the other
        stored = "embedding" in papers.columns and custom_cosine is None
        for slot, i in enumerate(batch):
            cos = F.get("_cosines", F.lit(slot))
            if stored and i.embedding is not None:
                vector = F.array(*[F.lit(float(x)) for x in i.embedding])
                same = F.col("embedding").isNotNull() & (F.size("embedding") == len(i.embedding))
                cos = F.when(same, vx.cosine(F.col("embedding"), vector)).otherwise(cos)
            df = df.withColumn(f"_cosine{slot}", cos)
    none = F.array().cast("array<string>")
    # what a component and the matches both use is computed once, and only for active components
    df = df.withColumns({
        f"_keywords{slot}": matched_phrases(F.col("_text"), i.keywords) if "keyword" in active else none for slot, i in enumerate(batch)
    } | {
        f"_followed{slot}": matched_authors(F.col("_authors"), i.followed_authors) if "author" in active else none for slot, i in enumerate(batch)
    })
    if "tfidf" in active:
        raw = F.concat_ws(" ", F.col("title"), tx.blank_to_null(F.col("abstract")))
        df = df.withColumn("_tfidf", pair_tfidf_udf(batch)(raw))
    shared = [n for n in active if n in _PAPER_ONLY]
    view = PaperView(F.col("_text"), F.col, as_of, 0)
    if shared:
        df = df.withColumns({
            f"_{n}": _component(n, view, batch[0], cfg) for n in shared
        })

    structs = []
    for slot, i in enumerate(batch):
        v = PaperView(F.col("_text"), F.col, as_of, slot)
        scores = {
            n: F.col(f"_{n}") if n in shared else _component(n, v, i, cfg)
            for n in active
        }
        structs.append(F.struct(
            F.lit(i.user_id).alias("user_id"),
            F.lit(i.interest_id).alias("interest_id"),
            F.lit(i.ord).alias("interest_ord"),
            F.col(f"_keywords{slot}").alias("matched_keywords"),
            F.col(f"_followed{slot}").alias("matched_authors"),
            *[scores[n].cast("double").alias(f"{n}_score") for n in active],
        ))
    scored = df.select(*keep, F.inline(F.array(*structs)))

    # weights and thresholds differ per interest only where an interest sets its own
    total: Column | None = None
    prio: Column | None = None
    for i in batch:
        w = {**cfg.weights, **(i.weights or {})}
        t = weighted_total({n: F.col(f"{n}_score") for n in active}, w)
        is_i = F.col("interest_id") == i.interest_id
        total = F.when(is_i, t) if total is None else total.when(is_i, t)
    scored = scored.withColumn("total_score", total)
    for i in batch:
        p = priority(
            F.col("total_score"),
            cfg.threshold_immediate if i.threshold_immediate is None else i.threshold_immediate,
            cfg.threshold_weekly if i.threshold_weekly is None else i.threshold_weekly,
            cfg.threshold_monthly,
        )
        is_i = F.col("interest_id") == i.interest_id
        prio = F.when(is_i, p) if prio is None else prio.when(is_i, p)
    return scored.withColumn("priority", prio)


def interest_batches(
    interests: Sequence[Interest] | DataFrame, size: int = INTERESTS_PER_PASS
) -> Iterator[list[Interest]]:
    """Batches of at most ``size`` interests; a DataFrame is streamed, never collected whole."""
    rows: Iterable[Interest]
    if isinstance(interests, DataFrame):
        rows = (Interest.from_row(r) for r in interests.orderBy("interest_id").toLocalIterator())
    else:
        rows = interests
    batch: list[Interest] = []
    for i in rows:
        batch.append(i)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def score_papers(
    papers: DataFrame, interests: Sequence[Interest] | DataFrame, as_of: str | Column,
    cfg: ScoringConfig | None = None, keep: Sequence[str] = ("paper_id",),
    cosine_of: Callable | None = None,
) -> DataFrame:
    """One row per paper and interest: component scores, matches, ``total_score`` and ``priority``.

    ``keep`` names the paper columns to carry; the text columns stay behind unless named, so later
    sorts and shuffles move scores only.
    """
    cfg = cfg or ScoringConfig()
    cfg.validate()
    small_batches(papers.sparkSession)  # whole texts go to Python
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    parts = [
        _score_batch(papers, b, cfg, at, keep, cosine_of) for b in interest_batches(interests)
    ]
    if not parts:
        raise ValueError("no interests to score against")
    return reduce(DataFrame.unionByName, parts)


def components(scored: DataFrame, cfg: ScoringConfig | None = None) -> DataFrame:
    """Adds ``components``: ARRAY<STRUCT<name, score, weight>>."""
    cfg = cfg or ScoringConfig()
    return scored.withColumn("components", F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.col(f"{n}_score").alias("score"),
            F.lit(float(cfg.weights[n])).alias("weight"),
        )
        for n in cfg.active
    ]))


def top_per_interest(scored: DataFrame, n: int, tie: str = "paper_id") -> DataFrame:
    """The ``n`` best papers of every interest; each task keeps only its own best ``n`` first."""
    w = W.partitionBy("user_id", "interest_id").orderBy(F.col("total_score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def at_least_priority(scored: DataFrame, min_priority: str) -> DataFrame:
    """Rows whose priority is at least ``min_priority``; an unknown name keeps everything."""
    level = PRIORITY_LEVEL.get(min_priority, 3)
    names = [p for p, lv in PRIORITY_LEVEL.items() if lv <= level]
    return scored if level == 3 else scored.where(F.col("priority").isin(*names))


def relevance_tags(limit: int = 5) -> Column:
    """Tags for a scored row: matched keywords, author, novelty, citation, recency; fixed order."""
    some = F.array().cast("array<string>")
    kw = F.when(F.col("keyword_score") >= 0.5, F.slice("matched_keywords", 1, 3)).otherwise(some)
    au = F.when(
        (F.col("author_score") >= 0.5) & (F.size("matched_authors") > 0),
        F.array(F.concat(F.lit("Author: "), F.get("matched_authors", F.lit(0)))),
    ).otherwise(some)
    nov = F.when(F.col("novelty_score") >= 0.5, F.array(F.lit("Novel method"))).otherwise(some)
    cit = F.when(F.col("citation_score") >= 0.7, F.array(F.lit("Highly cited"))).otherwise(some)
    rec = F.when(F.col("recency_score") >= 0.8, F.array(F.lit("Recent"))).otherwise(some)
    return F.slice(F.array_distinct(F.concat(kw, au, nov, cit, rec)), 1, limit)
