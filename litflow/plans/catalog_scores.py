"""Queries for the per-row scores, totals, priorities and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litflow.functions import text as tx
from litflow.functions import vectors as vx
from litflow.operators.digest import high_priority as top_priority
from litflow.operators import ranking, scoring, selection
from litflow.operators.scoring import ScoringConfig, score_papers
from litflow.plans.registry import register
from litflow.plans.views import AS_OF, AUTHORS_SQL, INTERESTS, PAPERS_SQL, papers, phrase_sql, sql, table
from litflow.session import cut_lineage

CFG = ScoringConfig()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _union(make) -> str:
    return "\n UNION ALL ".join(make(i) for i in INTERESTS)


def _in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


TEXT_SQL = """
ptext AS (SELECT paper_id, title, abstract, lower(title || ' ' || abstract) AS txt FROM papers)"""

KEYWORD_SQL = "kw_hits AS (" + _union(
    lambda i: f"SELECT paper_id, '{i.interest_id}' AS interest_id, {len(i.keywords)} AS n_kw, list_filter(["
    + ", ".join(f"CASE WHEN {phrase_sql('txt', k)} THEN {q(k)} END" for k in i.keywords)
    + "], lambda x: x IS NOT NULL) AS matched, list_filter(["
    + ", ".join(f"CASE WHEN {phrase_sql('txt', k)} THEN {q(k)} END" for k in i.excluded_keywords)
    + "], lambda x: x IS NOT NULL) AS excluded FROM ptext"
) + """),
kw AS (SELECT paper_id, interest_id, matched, len(excluded) AS n_excluded,
  greatest(0e0, sqrt(len(matched) / CAST(n_kw AS DOUBLE)) - least(0.5e0, len(excluded) * 0.2e0)) AS keyword_score
  FROM kw_hits)"""

_FOLLOWED = [
    f"('{i.interest_id}', {q(n)}, {q(la)}, {q(fi)})"
    for i in INTERESTS for n, la, fi in map(scoring.author_parts, i.followed_authors)
]
AUTHOR_PARTS_SQL = """
names AS (SELECT paper_id, a, pos, regexp_replace(regexp_replace(trim(lower(a)), '\\s+(jr\\.?|sr\\.?|iii?|iv)$', ''), '\\s+', ' ', 'g') AS norm
  FROM (SELECT paper_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS pos FROM paper_authors)),
parts AS (SELECT *, CASE WHEN contains(norm, ',') THEN trim(split_part(norm, ',', 1)) ELSE regexp_extract(norm, '([^ ]*)$', 1) END AS last,
  CASE WHEN contains(norm, ',') THEN trim(regexp_replace(norm, '^[^,]*,', '')) WHEN contains(norm, ' ') THEN regexp_replace(norm, ' [^ ]*$', '') ELSE '' END AS first FROM names)"""
AUTHOR_SQL = AUTHOR_PARTS_SQL + f""",
followed(interest_id, norm, last, first) AS (VALUES {', '.join(_FOLLOWED)}),
author_hits AS (SELECT p.paper_id, f.interest_id, p.a, p.pos FROM parts p JOIN followed f ON p.norm = f.norm OR (p.last = f.last AND
   CASE WHEN p.first <> '' AND f.first <> '' THEN CASE WHEN length(p.first) <= 2 OR length(f.first) <= 2 THEN p.first[1] = f.first[1] ELSE p.first = f.first END ELSE TRUE END)
   GROUP BY ALL),
author_n AS (SELECT paper_id, interest_id, count(*) AS n, arg_min(a, pos) AS first_author, list(a ORDER BY pos) AS names FROM author_hits GROUP BY ALL),
ids(interest_id, n_followed) AS (VALUES {', '.join(f"('{i.interest_id}', {len(i.followed_authors)})" for i in INTERESTS)}),
au AS (SELECT pa.paper_id, ids.interest_id, n.first_author, coalesce(n.n, 0) AS n_matched, n.names,
   CASE WHEN n_followed = 0 THEN 0.5e0 WHEN n.n IS NULL THEN 0e0 ELSE least(1e0, 0.7e0 + 0.1e0 * n.n) END AS author_score
   FROM paper_authors pa CROSS JOIN ids LEFT JOIN author_n n ON n.paper_id = pa.paper_id AND n.interest_id = ids.interest_id)"""


def _count_sql(phrases) -> str:
    return " + ".join(f"CAST(contains(txt, {q(p)}) AS INTEGER)" for p in phrases)


NOVELTY_SQL = f"""
nov AS (SELECT paper_id, least(1e0, least(1e0, ({_count_sql(scoring.NOVELTY_PHRASES)}) * 0.15e0)
   + least(0.5e0, ({_count_sql(scoring.METHOD_PHRASES)}) * 0.1e0)) AS novelty_score FROM ptext)"""

CITATION_SQL = """
cit AS (SELECT paper_id, CASE WHEN citation_count IS NULL THEN 0.5e0 ELSE least(1e0,
   (CASE WHEN citation_count = 0 THEN 0.3e0 ELSE least(1e0, ln(1 + citation_count) / ln(201e0)) END) * 0.8e0
   + (CASE WHEN influential_citation_count > 0 THEN least(0.2e0, influential_citation_count / CAST(greatest(citation_count, 1) AS DOUBLE) * 0.5e0) ELSE 0e0 END)
   + 0.1e0) END AS citation_score FROM papers)"""

RECENCY_SQL = """
age AS (SELECT paper_id, greatest(0, floor((epoch(TIMESTAMP '2024-01-31') - epoch(coalesce(published_date, make_timestamp(year, 7, 1, 0, 0, 0)))) / 86400)) AS a FROM papers),
rec AS (SELECT paper_id, CASE WHEN a IS NULL THEN 0.5e0 WHEN a > 730 THEN 0.1e0 ELSE least(1e0, exp(a * (-0.693e0 / 90))
   + CASE WHEN a < 7 THEN 0.1e0 * (1 - a / 7) ELSE 0e0 END) END AS recency_score FROM age)"""

FIELD_SQL = "fos AS (" + _union(
    lambda i: f"SELECT paper_id, '{i.interest_id}' AS interest_id, CASE WHEN lower(lang) IN {_in_list(i.fields_of_study)} "
    f"THEN 0.4e0 / {len(i.fields_of_study)} + 0.6e0 ELSE 0e0 END AS field_of_study_score FROM papers"
) + ")"

JOURNAL_SQL = "jour AS (" + _union(
    lambda i: f"SELECT paper_id, '{i.interest_id}' AS interest_id, "
    + (
        "CASE WHEN " + " OR ".join(
            f"contains(lower(journal), {q(f)}) OR contains({q(f)}, lower(journal))" for f in i.followed_journals
        ) + " THEN 1e0 ELSE 0e0 END"
        if i.followed_journals else "0.5e0"
    ) + " AS journal_score FROM papers"
) + ")"

_INTEREST_TEXTS = ", ".join(
    f"('{i.interest_id}', {q(vx.interest_text(i.name, i.description, i.keywords))})" for i in INTERESTS
)
SEMANTIC_SQL = f"""
emb_text AS (SELECT 'p' || paper_id AS id, regexp_replace(lower(title || chr(10) || chr(10) || abstract), '^\\s+|\\s+$', '', 'g') AS t FROM papers
   UNION ALL SELECT id, lower(t) FROM (VALUES {_INTEREST_TEXTS}) v(id, t)),
emb_words AS (SELECT id, w, md5(w) AS h FROM (SELECT DISTINCT id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM emb_text)
   WHERE regexp_full_match(w, '[a-z]{{3,}}')),
emb_cells AS (SELECT id, CAST('0x' || substr(h, 1 + 4 * i, 4) AS INTEGER) % 768 AS slot,
     (CASE WHEN CAST('0x' || substr(h, 17 + 2 * i, 2) AS INTEGER) > 127 THEN 1e0 ELSE -1e0 END) * (0.5e0 + CAST('0x' || substr(h, 25 + 2 * i, 2) AS INTEGER) / 512e0) AS v
   FROM emb_words, (SELECT CAST(i AS INTEGER) AS i FROM range(4) r(i))
   UNION ALL SELECT id, i, CAST('0x' || substr(sha256(t), 1 + 2 * i, 2) AS INTEGER) / 2550e0 - 0.05e0 FROM emb_text, (SELECT CAST(i AS INTEGER) AS i FROM range(32) r(i))),
emb AS (SELECT id, slot, sum(v) AS v FROM emb_cells GROUP BY ALL),
emb_norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM emb GROUP BY id),
cos AS (SELECT CAST(substr(a.id, 2) AS BIGINT) AS paper_id, b.id AS interest_id, sum(a.v * b.v) / any_value(na.n * nb.n) AS cos
   FROM emb a JOIN emb b ON a.slot = b.slot AND a.id LIKE 'p%' AND b.id LIKE 'i%' JOIN emb_norm na ON na.id = a.id JOIN emb_norm nb ON nb.id = b.id GROUP BY ALL),
sem AS (SELECT paper_id, interest_id, cos, least(1e0, greatest(0e0, cos) * 2.5e0) AS semantic_score FROM cos)"""

_STOP_SQL = _in_list(tx.TFIDF_STOP)
_PROFILE_TEXTS = ", ".join(f"('{i.interest_id}', {q(scoring.interest_profile_text(i))})" for i in INTERESTS)
PAIR_SQL = f"""
pt_text AS (SELECT 'p' || paper_id AS id, title || ' ' || abstract AS t FROM papers UNION ALL SELECT * FROM (VALUES {_PROFILE_TEXTS}) v(id, t)),
pt_tok AS (SELECT id, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP_SQL}) AS w FROM pt_text),
pt_term AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM pt_tok) GROUP BY ALL),
pt_pair AS (SELECT p.id AS pid, i.id AS interest_id FROM pt_text p, pt_text i WHERE p.id LIKE 'p%' AND i.id LIKE 'i%'),
pt_all AS (SELECT x.pid, x.interest_id, t.term, sum(CASE WHEN t.id = x.pid THEN t.n ELSE 0 END) AS np, sum(CASE WHEN t.id <> x.pid THEN t.n ELSE 0 END) AS nq
   FROM pt_pair x JOIN pt_term t ON t.id = x.pid OR t.id = x.interest_id GROUP BY ALL),
pt_cut AS (SELECT * FROM pt_all QUALIFY row_number() OVER (PARTITION BY pid, interest_id ORDER BY np + nq DESC, term) <= 1000),
pt_sum AS (SELECT pid, interest_id, CAST(sum(np * nq) AS DOUBLE) AS dot,
   sum(power(np * CASE WHEN nq > 0 THEN 1e0 ELSE ln(1.5e0) + 1 END, 2)) AS n1, sum(power(nq * CASE WHEN np > 0 THEN 1e0 ELSE ln(1.5e0) + 1 END, 2)) AS n2 FROM pt_cut GROUP BY ALL),
tfi AS (SELECT CAST(substr(pid, 2) AS BIGINT) AS paper_id, interest_id, CASE WHEN dot = 0 THEN 0e0 ELSE dot / sqrt(n1 * n2) END AS tfidf_score FROM pt_sum)"""


def _weights(i) -> dict[str, float]:
    return {**CFG.weights, **(i.weights or {})}


TOTAL_SQL = """
scored0 AS (SELECT kw.paper_id, kw.interest_id, kw.matched, au.first_author, semantic_score, keyword_score, author_score, novelty_score, citation_score, recency_score, tfidf_score, field_of_study_score
  FROM kw JOIN au USING (paper_id, interest_id) JOIN sem USING (paper_id, interest_id) JOIN tfi USING (paper_id, interest_id) JOIN fos USING (paper_id, interest_id)
  JOIN nov USING (paper_id) JOIN cit USING (paper_id) JOIN rec USING (paper_id)),
scored1 AS (SELECT *, greatest(0e0, least(1e0, CASE interest_id """ + " ".join(
    f"WHEN '{i.interest_id}' THEN " + " + ".join(f"{n}_score * {w!r}e0" for n, w in _weights(i).items())
    for i in INTERESTS
) + """ END)) AS total_score FROM scored0),
scored AS (SELECT *, CASE WHEN total_score >= CASE interest_id """ + " ".join(
    f"WHEN '{i.interest_id}' THEN {i.threshold_immediate or CFG.threshold_immediate!r}" for i in INTERESTS
) + """ END THEN 'immediate' WHEN total_score >= CASE interest_id """ + " ".join(
    f"WHEN '{i.interest_id}' THEN {i.threshold_weekly or CFG.threshold_weekly!r}" for i in INTERESTS
) + """ END THEN 'weekly' WHEN total_score >= 0.3e0 THEN 'monthly' ELSE 'low' END AS priority FROM scored1)"""

SCORED_CTES = (
    PAPERS_SQL, TEXT_SQL, AUTHORS_SQL, KEYWORD_SQL, AUTHOR_SQL, NOVELTY_SQL, CITATION_SQL, RECENCY_SQL,
    FIELD_SQL, SEMANTIC_SQL, PAIR_SQL, TOTAL_SQL,
)


def scored(spark, sf_dir, keep=("paper_id",), cfg=CFG) -> DataFrame:
    return score_papers(papers(spark, sf_dir, authors=True), INTERESTS, AS_OF, cfg, keep)


def one(name: str, spark, sf_dir) -> DataFrame:
    """Scores of one component for every paper and interest."""
    others = frozenset(n for n in CFG.weights if n != name)
    cfg = ScoringConfig(weights={**CFG.weights, name: 1.0}, disabled=others)
    return score_papers(papers(spark, sf_dir, authors=True), INTERESTS, AS_OF, cfg)


@register("x1_x2_x16_x17_semantic_score", sql(PAPERS_SQL, SEMANTIC_SQL, body=
    "SELECT paper_id, interest_id, round(semantic_score, 6) AS semantic_score FROM sem"))
def semantic(spark, sf_dir):
    return one("semantic", spark, sf_dir).select(
        "paper_id", "interest_id", F.round("semantic_score", 6).alias("semantic_score"))


@register("x3_keyword_score", sql(PAPERS_SQL, TEXT_SQL, KEYWORD_SQL, body=
    "SELECT paper_id, interest_id, array_to_string(matched, ',') AS matched, round(keyword_score, 6) AS keyword_score FROM kw"))
def keyword(spark, sf_dir):
    return one("keyword", spark, sf_dir).select(
        "paper_id", "interest_id", F.array_join("matched_keywords", ",").alias("matched"),
        F.round("keyword_score", 6).alias("keyword_score"))


@register("x4_author_score", sql(PAPERS_SQL, AUTHORS_SQL, AUTHOR_SQL, body=
    "SELECT paper_id, interest_id, coalesce(array_to_string(names, ';'), '') AS matched, round(author_score, 6) AS author_score FROM au"))
def author(spark, sf_dir):
    return one("author", spark, sf_dir).select(
        "paper_id", "interest_id", F.array_join("matched_authors", ";").alias("matched"),
        F.round("author_score", 6).alias("author_score"))


@register("x5_novelty_score", sql(PAPERS_SQL, TEXT_SQL, NOVELTY_SQL, body=
    "SELECT paper_id, round(novelty_score, 6) AS novelty_score FROM nov"))
def novelty(spark, sf_dir):
    text = tx.joined_text(F.col("title"), F.col("abstract"))
    return papers(spark, sf_dir).select("paper_id", F.round(scoring.novelty_score(text), 6).alias("novelty_score"))


@register("x6_journal_score", sql(PAPERS_SQL, JOURNAL_SQL, body=
    "SELECT paper_id, interest_id, journal_score FROM jour"))
def journal(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", F.inline(F.array(*[
        F.struct(F.lit(i.interest_id).alias("interest_id"),
                 scoring.journal_score(F.col("journal"), i.followed_journals).alias("journal_score"))
        for i in INTERESTS])))


@register("x7_citation_score", sql(PAPERS_SQL, CITATION_SQL, body=
    "SELECT paper_id, round(citation_score, 6) AS citation_score FROM cit"))
def citation(spark, sf_dir):
    s = scoring.citation_score(F.col("citation_count"), F.col("influential_citation_count"))
    return papers(spark, sf_dir).select("paper_id", F.round(s, 6).alias("citation_score"))


@register("x8_recency_score", sql(PAPERS_SQL, RECENCY_SQL, body=
    "SELECT paper_id, round(recency_score, 6) AS recency_score FROM rec"))
def recency(spark, sf_dir):
    s = scoring.recency_score(F.col("published_date"), F.col("year"), F.lit(AS_OF).cast("timestamp"), CFG)
    return papers(spark, sf_dir).select("paper_id", F.round(s, 6).alias("recency_score"))


@register("x9_field_score", sql(PAPERS_SQL, FIELD_SQL, body=
    "SELECT paper_id, interest_id, round(field_of_study_score, 6) AS field_of_study_score FROM fos"))
def fields(spark, sf_dir):
    return one("field_of_study", spark, sf_dir).select(
        "paper_id", "interest_id", F.round("field_of_study_score", 6).alias("field_of_study_score"))


@register("x14_tfidf_pair_score", sql(PAPERS_SQL, PAIR_SQL, body=
    "SELECT paper_id, interest_id, round(tfidf_score, 6) AS tfidf_score FROM tfi"))
def tfidf_pair(spark, sf_dir):
    return one("tfidf", spark, sf_dir).select(
        "paper_id", "interest_id", F.round("tfidf_score", 6).alias("tfidf_score"))


@register("j1_a1_x19_x20_x21_score_papers", sql(*SCORED_CTES, body=
    "SELECT paper_id, interest_id, round(total_score, 6) AS total_score, priority FROM scored"))
def totals(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "paper_id", "interest_id", F.round("total_score", 6).alias("total_score"), "priority")


@register("x21_failing_scorer", sql(PAPERS_SQL, body="""
SELECT paper_id, interest_id, round(s, 6) AS brittle_score, round(s, 6) AS total_score
FROM (SELECT paper_id, CASE WHEN title IS NULL OR length(title) % 7 = 0 THEN 0.5e0 ELSE 1e0 / (length(title) % 7) END AS s FROM papers), (VALUES """
    + ", ".join(f"({q(i.interest_id)})" for i in INTERESTS) + ") AS i(interest_id)"))
def failing_scorer(spark, sf_dir):
    """A scorer in Python that raises for some rows: these count as 0.5, the others keep their score."""
    def brittle(rows, interest, cfg):
        return rows["title"].map(lambda t: 1 / (len(t) % 7))

    scoring.register_python_scorer("brittle", ["title"], brittle)
    try:
        s = score_papers(papers(spark, sf_dir, authors=True), INTERESTS, AS_OF, ScoringConfig(weights={"brittle": 1.0}))
    finally:
        scoring.SCORERS.pop("brittle")
    return s.select("paper_id", "interest_id", F.round("brittle_score", 6).alias("brittle_score"), F.round("total_score", 6).alias("total_score"))


@register("u2_embedding_backlog", sql(PAPERS_SQL, "t AS (SELECT paper_id, concat_ws(chr(10) || chr(10), title, nullif(abstract, '')) AS t FROM papers)", body="""
SELECT paper_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(length(t) - length(replace(t, ' ', '')) AS BIGINT) AS n_spaces
FROM t WHERE paper_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL)"""))
def embedding_backlog(spark, sf_dir):
    """Papers without an embedding go through a model in batches; here one of two plain features."""
    def model(texts):
        return [[len(t), t.count(" ")] for t in texts]

    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")
    e = selection.embed_missing(papers(spark, sf_dir), held, model)
    return e.select("paper_id", *[F.get("embedding", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("n_chars", "n_spaces"))])


@register("u1_score_components", sql(*SCORED_CTES, body="SELECT paper_id, interest_id, name, round(score, 6) AS score, weight FROM (" +
    " UNION ALL ".join(
        f"SELECT paper_id, interest_id, '{n}' AS name, {n}_score AS score, {w!r}e0 AS weight FROM scored" for n, w in CFG.weights.items()
    ) + ")"))
def component_rows(spark, sf_dir):
    return scoring.components(scored(spark, sf_dir), CFG).select(
        "paper_id", "interest_id", F.inline("components")).withColumn("score", F.round("score", 6))


@register("w1_rank_all", sql(*SCORED_CTES, body=
    "SELECT paper_id, interest_id, row_number() OVER (PARTITION BY interest_id ORDER BY round(total_score, 6) DESC, paper_id) AS rank FROM scored"))
def rank_all(spark, sf_dir):
    s = scored(spark, sf_dir).select("paper_id", "interest_id", F.round("total_score", 6).alias("total_score"))
    # the quantile probes and the ranking read the scores; written once, the text pass stays single
    s = cut_lineage(s)
    return ranking.row_number_desc(s, ["interest_id"], "total_score", "paper_id").select(
        "paper_id", "interest_id", "rank")


@register("w2_digest_top_k", sql(*SCORED_CTES, body=
    "SELECT interest_id, rank, paper_id, round(total_score, 6) AS total_score, priority FROM (SELECT *, row_number() OVER (PARTITION BY interest_id ORDER BY total_score DESC, paper_id) AS rank FROM scored) WHERE rank <= 10"))
def digest_top_k(spark, sf_dir):
    return scoring.top_per_interest(scored(spark, sf_dir), 10).select(
        "interest_id", "rank", "paper_id", F.round("total_score", 6).alias("total_score"), "priority")


@register("w10_section_top5", sql(*SCORED_CTES, body=
    "SELECT interest_id, rank, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY interest_id ORDER BY total_score DESC, paper_id) AS rank FROM scored) WHERE rank <= 5"))
def section_top5(spark, sf_dir):
    return scoring.top_per_interest(scored(spark, sf_dir), 5).select("interest_id", "rank", "paper_id")


@register("f3_min_priority", sql(*SCORED_CTES, body=
    "SELECT paper_id, interest_id, priority FROM scored WHERE priority IN ('immediate', 'weekly')"))
def min_priority(spark, sf_dir):
    return scoring.at_least_priority(scored(spark, sf_dir), "weekly").select("paper_id", "interest_id", "priority")


@register("f4_a2_section_counts", sql(*SCORED_CTES, body="""SELECT interest_id, count(*) FILTER (WHERE total_score >= 0.35e0) AS found,
  count(*) FILTER (WHERE total_score >= 0.35e0 AND priority = 'immediate') AS immediate, count(*) FILTER (WHERE total_score >= 0.35e0 AND priority = 'weekly') AS weekly FROM scored GROUP BY ALL"""))
def section_counts(spark, sf_dir):
    from litflow.operators.digest import section_counts as op

    return op(scored(spark, sf_dir), 0.35).select("interest_id", "found", "immediate", "weekly")


@register("f5_high_priority", sql(*SCORED_CTES, body=
    "SELECT interest_id, paper_id, round(total_score, 6) AS total_score FROM scored WHERE priority IN ('immediate', 'weekly') AND total_score >= 0.1e0"))
def high_priority(spark, sf_dir):
    s = scored(spark, sf_dir)
    return top_priority(s).select(
        "interest_id", "paper_id", F.round("total_score", 6).alias("total_score"))


@register("x22_relevance_tags", sql(*SCORED_CTES, body="""SELECT paper_id, interest_id, array_to_string(list_slice(
  CASE WHEN keyword_score >= 0.5 THEN list_slice(matched, 1, 3) ELSE [] END
  || CASE WHEN author_score >= 0.5 AND first_author IS NOT NULL THEN ['Author: ' || first_author] ELSE [] END
  || CASE WHEN novelty_score >= 0.5 THEN ['Novel method'] ELSE [] END || CASE WHEN citation_score >= 0.7 THEN ['Highly cited'] ELSE [] END
  || CASE WHEN recency_score >= 0.8 THEN ['Recent'] ELSE [] END, 1, 5), '|') AS tags FROM scored"""))
def tags(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "paper_id", "interest_id", F.array_join(scoring.relevance_tags(), "|").alias("tags"))
