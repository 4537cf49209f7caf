"""Keyword timelines, trending topics, citation velocity, topic history and the trend report."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.functions import text as tx
from litflow.operators import ranking
from litflow.operators.scoring import age_days
from litflow.session import bit_map, cut_lineage, give_back, row_count_within, spread, stored, task_count

SEEDS = 30
# Uses of a term that trends, at least.
LEAST_USES = 3
# Seeds decided by one pass: at most 2**8 patterns of them come back.
SEEDS_PER_PASS = 8


def paper_date(as_of: Column, date: str = "published_date") -> Column:
    """Publication date; an unknown date counts as 30 days ago."""
    return F.coalesce(F.col(date), as_of - F.expr("INTERVAL 30 DAYS"))


def recent(papers: DataFrame, as_of: Column, window_days: int, min_papers: int = 5, fallback: int = 100) -> DataFrame:
    """Papers inside the window; when there are too few, the ``fallback`` newest ones."""
    inside = papers.where(paper_date(as_of) >= as_of - F.make_dt_interval(F.lit(window_days)))
    if row_count_within(inside, min_papers - 1):
        return papers.orderBy(paper_date(as_of).desc(), "paper_id").limit(fallback)
    return inside


def _with_text(papers: DataFrame) -> DataFrame:
    """Adds ``_text``, the search text. As the output of a generator it is made once for a row, however many conditions
    read it; as a column they would each get its expression."""
    return papers.select("*", F.explode(F.array(tx.joined_text(F.col("title"), F.col("abstract")))).alias("_text"))


def _uses(dated: DataFrame, *keep: str) -> DataFrame:
    """A row for each use of a word or adjacent word pair: ``(*keep, term)``."""
    toks = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.TIMELINE_STOP, 3)
    return dated.select(*keep, toks.alias("t")).select(*keep, F.explode(F.concat("t", tx.bigrams(F.col("t")))).alias("term"))


def keyword_timeline(
    papers: DataFrame, as_of: Column, window_days: int = 30, least: int = 1, only: Sequence[str] | None = None
) -> DataFrame:
    """``(term, day, n)``: uses of each word and adjacent word pair by age in days.

    Terms used fewer than ``least`` times may be missing: most pairs occur once or twice, and are dropped before they are
    shuffled. With ``only``, just these terms are counted, in papers that hold their words.
    """
    day = age_days(as_of, paper_date(as_of))
    dated = papers.withColumn("day", day).where(F.col("day").between(0, window_days))
    if only is not None:
        holds = F.lit(False)
        for term in only:
            words = F.lit(True)
            for w in term.split(" "):
                words = words & F.col("_text").contains(w)
            holds = holds | words
        mine = _uses(_with_text(spread(dated.select("day", "title", "abstract"))).where(holds), "day")
        return mine.where(F.col("term").isin(*only)).groupBy("term", "day").agg(F.count("*").alias("n"))
    if least <= 1:
        return _uses(spread(dated.select("day", "title", "abstract")), "day").groupBy("term", "day").agg(F.count("*").alias("n"))
    often = used_often(_uses(spread(dated.select("day", "title", "abstract"))), least)
    # the days follow each other over the tasks, in equal parts, by a number that the plan knows: a task adds up what it
    # has of its few days before terms meet, once
    n = task_count(papers.sparkSession)
    held = {r["day"]: r["n"] for r in dated.groupBy("day").agg(F.count("*").alias("n")).collect()}  # a row for each day
    sizes = [held.get(d, 0) for d in range(window_days + 1)]
    each, before = max(1, -(-sum(sizes) // n)), [0, *accumulate(sizes)]
    at = lambda xs: F.get(F.expr(f"array({', '.join(f'{x}L' for x in xs)})"), F.col("day").cast("int"))
    place = at(before[:-1]) + F.pmod(F.xxhash64("paper_id", "title"), at([max(1, x) for x in sizes]))
    dealt = dated.select(F.floor(place / each).cast("int").alias("deal"), "day", "title", "abstract").repartitionById(n, "deal")
    mine = _uses(dealt, "deal", "day").where(often).groupBy("deal", "term", "day").agg(F.count("*").alias("n"))
    return mine.repartition("term").groupBy("term", "day").agg(F.sum("n").alias("n"))


def used_often(uses: DataFrame, least: int) -> Column:
    """A condition on ``term`` that holds for every term with ``least`` uses or more, and for few others.

    Uses are counted by 32 bits of the term's hash; terms that share them only add to each other.
    """
    key = F.xxhash64("term")
    often = bit_map(
        uses.select(key.bitwiseAND(F.lit((1 << 32) - 1)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least).select("h"))
    give_back()
    return often(key)


def trending_keywords(
    timeline: DataFrame, min_total: int = 3, window_days: int = 30, mode: str = "chronological"
) -> DataFrame:
    """``(term, total, score)`` of rising terms. ``chronological`` compares the later half of the
    observed days with the earlier half; ``reference`` keeps day offsets ascending, newest first.

    A term's series has at most ``window_days + 1`` entries, so gathering it is bounded.
    """
    series = F.sort_array(F.collect_list(F.struct("day", "n")), asc=mode == "reference")
    t = timeline.groupBy("term").agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * (1 - F.col("day") / float(window_days))).alias("weighted"),
        series.alias("s"),
    ).where(F.col("total") >= min_total)
    mid = F.floor(F.size("s") / 2).cast("int")
    first = F.aggregate(F.slice("s", 1, mid), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    t = t.withColumn("first", first).withColumn("second", F.col("total") - F.col("first"))
    growth = F.when(F.col("first") > 0, (F.col("second") - F.col("first")) / F.nullif("first", F.lit(0))).otherwise(1.0)
    score = growth * (1 + F.col("weighted") / F.col("total"))
    return t.select("term", "total", score.alias("score")).where(F.col("score") > 0)


def momentum(timeline: DataFrame) -> DataFrame:
    """``(term, momentum)``: minus the slope of uses on age, relative to mean use; 0 below two days."""
    return timeline.groupBy("term").agg(
        F.when(F.count("*") < 2, 0.0)
        .otherwise(-F.regr_slope(F.col("n"), F.col("day")) / F.avg("n")).alias("momentum")
    )


def seed_terms(trending: DataFrame, n: int = SEEDS) -> list[tuple[str, float]]:
    """The ``n`` strongest terms, on the driver: at most ``n`` rows."""
    top = trending.orderBy(F.round("score", 9).desc(), "term").limit(n)
    return [(r["term"], r["score"]) for r in top.collect()]


def seed_timeline(papers: DataFrame, as_of: Column, seeds: Sequence[tuple[str, float]], window_days: int = 30) -> DataFrame:
    """The timeline of the seeds, all that the momentum of topics needs; a row for each seed and day, written once."""
    return stored(keyword_timeline(papers, as_of, window_days, only=[s for s, _ in seeds]))


def seed_matches(papers: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """``(seed, paper_id)`` for every seed that occurs in a paper, without a join."""
    text = tx.joined_text(F.col("title"), F.col("abstract"))
    found = F.array_compact(F.array(*[F.when(F.col("_t").contains(s), F.lit(s)) for s in seeds]))
    return spread(papers.select("paper_id", "title", "abstract")).select("paper_id", text.alias("_t")).select(F.explode(found).alias("seed"), "paper_id")


def with_seed_mask(papers: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """The papers that hold a seed, with ``_mask``: bit i is set if the paper holds seed i. The text is joined and lowered
    once for all seeds, and the table written, so that later passes read the mask instead of searching the texts again."""
    mask = F.lit(0).cast("bigint")
    for i, s in enumerate(seeds):
        mask = mask + F.when(F.col("_text").contains(s), F.lit(1 << i)).otherwise(0)
    held = _with_text(spread(papers)).select(*papers.columns, F.explode(F.array(mask)).alias("_mask"))
    return stored(held.where("_mask <> 0"))


def accepted_seeds(masks: DataFrame, n_seeds: int, min_papers: int, per_pass: int = SEEDS_PER_PASS) -> list[int]:
    """Greedy choice on pattern counts ``(mask, n)``: a seed is taken when enough papers that hold it
    hold no taken seed. A pass decides ``per_pass`` seeds from the counts of their patterns among papers without a
    taken seed, so at most ``2 ** per_pass`` rows come to the driver."""
    taken: list[int] = []
    used = 0
    for first in range(0, n_seeds, per_pass):
        block = sum(1 << i for i in range(first, min(first + per_pass, n_seeds)))
        clear = masks.where(F.col("mask").bitwiseAND(F.lit(used).cast("bigint")) == 0)
        counts = clear.groupBy(F.col("mask").bitwiseAND(F.lit(block).cast("bigint")).alias("m")).agg(F.sum("n").alias("n"))
        local = [(r["m"], r["n"]) for r in counts.collect()]
        for i in range(first, min(first + per_pass, n_seeds)):
            bit = 1 << i
            if sum(n for m, n in local if m & bit and not m & used) >= min_papers:
                taken.append(i)
                used |= bit
    return taken


def topic_papers(
    papers: DataFrame, seeds: Sequence[tuple[str, float]], min_papers: int = 5, masked: DataFrame | None = None
) -> DataFrame:
    """Each paper with the first accepted seed it holds: adds ``seed_no``, ``keyword``, ``growth``. ``masked`` is
    ``with_seed_mask`` of the papers, if the caller has it already."""
    words = [s for s, _ in seeds]
    if not words:
        return papers.where(F.lit(False)).withColumns({
            "seed_no": F.lit(0), "keyword": F.lit(""), "growth": F.lit(0.0)})
    if masked is None:
        masked = with_seed_mask(papers, words)
    masks = cut_lineage(masked.groupBy(F.col("_mask").alias("mask")).agg(F.count("*").alias("n")))
    taken = accepted_seeds(masks, len(words), min_papers)
    if not taken:
        return topic_papers(papers, [], min_papers)
    first = F.coalesce(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(i)) for i in taken])
    out = masked.where(F.col("_mask").bitwiseAND(F.lit(sum(1 << i for i in taken)).cast("bigint")) != 0).withColumn("seed_no", first).drop("_mask")
    return out.withColumns({
        "keyword": F.element_at(F.array(*[F.lit(w) for w in words]), F.col("seed_no") + 1),
        "growth": F.element_at(F.array(*[F.lit(float(g)) for _, g in seeds]), F.col("seed_no") + 1),
    })


def related_keywords(members: DataFrame, k: int = 10) -> DataFrame:
    """``(keyword, word, n, rank)``: words in most of a topic's papers."""
    toks = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.RELATED_STOP, 3)
    n = (
        members.select("keyword", F.explode(F.array_distinct(toks)).alias("word"))
        .where(F.col("word") != F.col("keyword")).groupBy("keyword", "word").agg(F.count("*").alias("n"))
    )
    w = W.partitionBy("keyword").orderBy(F.col("n").desc(), "word")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trend_score(n: Column, growth: Column, avg_age: Column, n_keywords: Column, window_days: int = 30) -> Column:
    """Volume 40, growth 30, recency 20, keyword diversity 10."""
    # Shares of the score and where they saturate.
    one = F.lit(1.0)
    volume = F.least(one, F.log1p(n) / math.log1p(50)) * 40
    rise = F.greatest(F.lit(0.0), F.least(one, growth)) * 30
    fresh = F.greatest(F.lit(0.0), 1 - avg_age / float(window_days)) * 20
    return volume + rise + fresh + F.least(one, n_keywords / 10.0) * 10


def topics(members: DataFrame, timeline: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """One row per topic: id, name, keywords, size, first date, score, momentum, velocity."""
    date = paper_date(as_of)
    base = members.groupBy("seed_no", "keyword", "growth").agg(
        F.count("*").alias("n_papers"), F.min(date).alias("first_seen"), F.avg(age_days(as_of, date)).alias("avg_age")
    )
    rel = related_keywords(members, 10).where("rank <= 9").groupBy("keyword").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("related")
    )
    t = base.join(rel, "keyword", "left").withColumn(
        "keywords", F.concat(F.array("keyword"), F.coalesce("related", F.array().cast("array<string>")))
    )
    # topics number at most SEEDS, so the timeline is filtered by a fixed-size broadcast
    mine = momentum(timeline.join(F.broadcast(base.select(F.col("keyword").alias("term"))), "term", "left_semi"))
    t = t.join(F.broadcast(mine.withColumnRenamed("term", "keyword")), "keyword", "left")
    return t.select(
        F.concat(F.lit("trend_"), F.substring(F.md5("keyword"), 1, 8)).alias("topic_id"),
        F.initcap("keyword").alias("name"),
        F.concat(F.lit("Emerging research on "), "keyword").alias("description"),
        "seed_no", "keyword", "keywords", "n_papers", "first_seen", "growth",
        trend_score(F.col("n_papers"), F.col("growth"), F.col("avg_age"), F.size("keywords"), window_days).alias("trend_score"),
        F.coalesce("momentum", F.lit(0.0)).alias("momentum"),
        (F.col("n_papers") / float(window_days)).alias("velocity"),
    )


def detect_topics(
    papers: DataFrame, as_of: Column, window_days: int = 30, min_papers: int = 5, top_k: int = 10,
    mode: str = "chronological", timeline: DataFrame | None = None,
) -> DataFrame:
    """Trending topics, best first."""
    inside = recent(papers, as_of, window_days, min_papers)
    line = keyword_timeline(inside, as_of, window_days, LEAST_USES) if timeline is None else timeline
    seeds = seed_terms(trending_keywords(line, LEAST_USES, window_days, mode))
    if timeline is None:
        line = seed_timeline(inside, as_of, seeds, window_days)
    found = topics(topic_papers(inside, seeds, min_papers), line, as_of, window_days)
    return found.orderBy(F.col("trend_score").desc(), "seed_no").limit(top_k)


def citation_velocity(papers: DataFrame, as_of: Column, top_k: int | None = 20, max_age: int = 365) -> DataFrame:
    """Citations per day with the share of papers that are no faster, in percent."""
    age = F.greatest(age_days(as_of, paper_date(as_of)), F.lit(1))
    v = (
        papers.withColumn("age", age)
        .where((F.coalesce("citation_count", F.lit(0)) > 0) & (F.col("age") <= max_age))
        .withColumn("velocity", F.col("citation_count") / F.col("age"))
    )
    out = ranking.share_at_most(v, "velocity").withColumn("percentile", F.col("share") * 100).drop("share")
    return out if top_k is None else out.orderBy(F.col("velocity").desc(), "paper_id").limit(top_k)


def acceleration(snapshots: DataFrame, key: str = "paper_id", tie: str = "snapshot_id") -> DataFrame:
    """Latest velocity minus the one before, 0 without one; only two rows per key are compared."""
    w = W.partitionBy(key).orderBy(F.col("ts").desc(), F.col(tie).desc())
    two = snapshots.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    now = F.max(F.when(F.col("_rn") == 1, F.col("velocity")))
    before = F.max(F.when(F.col("_rn") == 2, F.col("velocity")))
    return two.groupBy(key).agg(
        now.alias("velocity"),
        F.when(F.coalesce(before, F.lit(0.0)) == 0, 0.0).otherwise(now - before).alias("acceleration"),
    )


def keep_snapshots(snapshots: DataFrame, n: int = 30, tie: str = "snapshot_id") -> DataFrame:
    """The last ``n`` snapshots of each topic; tasks drop the rest before the shuffle."""
    w = W.partitionBy("topic_id").orderBy(F.col("ts").desc(), F.col(tie).desc())
    return snapshots.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def topic_evolution(snapshots: DataFrame, n: int = 30, tie: str = "snapshot_id") -> DataFrame:
    """Current, mean, peak and lowest score, peak time and phase over the kept snapshots."""
    kept = keep_snapshots(snapshots, n, tie)
    h = kept.groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", tie, "trend_score"))).alias("h"),
        F.avg("trend_score").alias("average_score"), F.max("trend_score").alias("peak_score"),
        F.min("trend_score").alias("min_score"), F.count("*").alias("data_points"),
        F.min_by("ts", F.struct(-F.col("trend_score"), "ts", tie)).alias("peak_date"),
    )

    def mean3(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x["trend_score"]) / 3

    drift = mean3(F.slice("h", -3, 3)) - mean3(F.slice("h", 1, 3))
    phase = (
        F.when(F.col("data_points") < 3, "emerging").when(drift > 5, "growing")
        .when(drift < -5, "declining").otherwise("stable")
    )
    return h.select(
        "topic_id", F.element_at("h", -1)["trend_score"].alias("current_score"), "average_score", "peak_score",
        "min_score", "peak_date", phase.alias("phase"), "data_points",
    )


def topic_history(snapshots: DataFrame, n: int = 30, tie: str = "snapshot_id", values: Sequence[str] = ("trend_score",)) -> DataFrame:
    """The kept snapshots of each topic, one row each: when, and the values that were held (score, paper count, ...)."""
    return keep_snapshots(snapshots, n, tie).select("topic_id", "ts", *values)


def related_trends(topic_table: DataFrame, k: int = 5) -> DataFrame:
    """Topics that share keywords, by Jaccard similarity: ``(topic_id, other_id, similarity, rank)``."""
    kw = topic_table.select(
        "topic_id", F.size(F.array_distinct(F.transform("keywords", F.lower))).alias("size"),
        F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("kw"),
    )
    other = kw.select(F.col("topic_id").alias("other_id"), F.col("size").alias("other_size"), "kw")
    shared = kw.join(other, "kw").where("topic_id <> other_id").groupBy("topic_id", "size", "other_id", "other_size").agg(
        F.count("*").alias("c")
    )
    sim = F.col("c") / (F.col("size") + F.col("other_size") - F.col("c"))
    w = W.partitionBy("topic_id").orderBy(F.col("similarity").desc(), "other_id")
    return shared.select("topic_id", "other_id", sim.alias("similarity")).withColumn(
        "rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relevant_topics(topic_table: DataFrame, interests: Sequence[str]) -> DataFrame:
    """Topics with a keyword among the words of the interests."""
    wanted = sorted({w.lower() for i in interests for w in i.split()})
    lit = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
    return topic_table.where(F.arrays_overlap(F.transform("keywords", F.lower), lit))


def declining_topics(topic_table: DataFrame, n: int = 5, below: float = -0.2) -> DataFrame:
    return topic_table.where(F.col("momentum") < below).orderBy("momentum", "seed_no").limit(n)


def trend_report(
    papers: DataFrame, as_of: Column, interests: Sequence[str] = (), window_days: int = 30,
    mode: str = "chronological",
) -> DataFrame:
    """Long-format report ``(section, rank, name, value)`` with a one-line summary.

    The rising terms, the timeline of the seeds and the seeds that each paper holds are written once and shared by both
    topic passes and the keyword section.
    """
    inside = recent(papers, as_of, window_days)
    trend = stored(trending_keywords(keyword_timeline(inside, as_of, window_days, LEAST_USES), LEAST_USES, window_days, mode))
    seeds = seed_terms(trend)
    give_back()
    line = seed_timeline(inside, as_of, seeds, window_days)
    masked = with_seed_mask(inside, [s for s, _ in seeds])
    main = cut_lineage(topics(topic_papers(inside, seeds, 5, masked), line, as_of, window_days))
    wide = cut_lineage(topics(topic_papers(inside, seeds, 3, masked), line, as_of, window_days))

    def ranked(df: DataFrame, section: str, name: str, value: Column, order: list, n: int) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        w = W.orderBy(*order)  # at most n rows
        return top.select(
            F.lit(section).alias("section"), F.row_number().over(w).alias("rank"),
            F.col(name).alias("name"), value.alias("value"),
        )

    best = [F.col("trend_score").desc(), F.col("seed_no")]
    top10 = main.orderBy(*best).limit(10)
    parts = [
        ranked(main, "trending", "name", F.col("trend_score"), best, 10),
        ranked(
            citation_velocity(papers, as_of, None).withColumn("name", F.col("paper_id").cast("string")),
            "rapidly_cited", "name", F.col("velocity"), [F.col("velocity").desc(), F.col("paper_id")], 20,
        ),
        ranked(trend, "emerging_keywords", "term", F.col("score"), [F.round("score", 9).desc(), F.col("term")], 20),
        ranked(
            wide.orderBy(*best).limit(50).where(F.col("momentum") < -0.2), "declining", "name", F.col("momentum"),
            [F.col("momentum"), F.col("seed_no")], 5,
        ),
        ranked(relevant_topics(top10, interests), "relevant", "name", F.col("trend_score"), best, 10),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_summary(report: DataFrame) -> DataFrame:
    """Template summary of a trend report; the report has at most 65 rows."""

    def names(section: str, n: int) -> Column:
        rows = F.sort_array(F.collect_list(F.when(
            (F.col("section") == section) & (F.col("rank") <= n), F.struct("rank", "name"))))
        return F.array_join(F.transform(rows, lambda x: x["name"]), ", ")

    a = report.agg(
        names("trending", 3).alias("t"), names("emerging_keywords", 5).alias("e"), names("relevant", 3).alias("r"),
        F.least(F.count_if(F.col("section") == "rapidly_cited"), F.lit(5)).alias("c"),
    )
    text = F.concat_ws(
        " ",
        F.when(F.col("t") != "", F.concat(F.lit("Top trending topics: "), "t", F.lit("."))),
        F.when(F.col("c") > 0, F.concat(F.lit("Found "), F.col("c").cast("string"), F.lit(" rapidly-cited papers."))),
        F.when(F.col("e") != "", F.concat(F.lit("Emerging keywords: "), "e", F.lit("."))),
        F.when(F.col("r") != "", F.concat(F.lit("Relevant to your interests: "), "r", F.lit("."))),
    )
    return a.select(F.when(text == "", "No significant trends detected.").otherwise(text).alias("summary"))


def export_topics(topic_table: DataFrame) -> DataFrame:
    """Columns of the topic export, ready for ``write.csv`` or ``write.json``."""
    return topic_table.select(
        "topic_id", "name", F.format_string("%.2f", "trend_score").alias("trend_score"),
        F.format_string("%.3f", "momentum").alias("momentum"), F.col("n_papers").alias("paper_count"),
        F.array_join(F.slice("keywords", 1, 5), ";").alias("keywords"),
    )
