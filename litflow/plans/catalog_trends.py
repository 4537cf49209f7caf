"""Queries for tokens, TF-IDF, timelines, topics and trends."""

from __future__ import annotations


from pyspark.sql import functions as F

from litflow.functions import text as tx
from litflow.operators import scoring, tfidf, trends
from litflow.plans.catalog_scores import _in_list, q
from litflow.plans.registry import register
from litflow.plans.views import INTERESTS, PAPERS_SQL, as_of, papers, sql, table
from litflow.session import give_back
from litflow.streaming.jobs import scratch_path

WINDOW = 800  # spans every publication date, so trends read the whole corpus
EDGE = q(tx.TOKEN_EDGE)


def toks_sql(src: str, stop, n: int) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({src}, '\\s+'), lambda w: trim(w, {EDGE})), "
        f"lambda w: length(w) > {n} AND regexp_full_match(w, '\\p{{L}}+') AND w NOT IN {_in_list(stop)})"
    )


TEXT_SQL = f"""
tt AS (SELECT paper_id, title, lower(title || ' ' || abstract) AS txt, coalesce(published_date, TIMESTAMP '2024-01-01') AS pub, citation_count FROM papers),
toks AS (SELECT paper_id, txt, date_diff('day', pub, TIMESTAMP '2024-01-31') AS day, {toks_sql('txt', tx.TIMELINE_STOP, 3)} AS w FROM tt),
timeline AS (SELECT term, day, count(*) AS n FROM (SELECT day, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks WHERE day BETWEEN 0 AND {WINDOW}) GROUP BY ALL)"""
TRENDING_SQL = f"""
halves AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY day DESC) AS i, count(*) OVER (PARTITION BY term) AS c FROM timeline),
sums AS (SELECT term, sum(n) AS total, coalesce(sum(n) FILTER (WHERE i <= c // 2), 0) AS f, coalesce(sum(n) FILTER (WHERE i > c // 2), 0) AS s, sum(n * (1 - day / {WINDOW}e0)) AS wt FROM halves GROUP BY term HAVING sum(n) >= 3),
trending AS (SELECT term, CAST(total AS BIGINT) AS total, (CASE WHEN f > 0 THEN (s - f) / CAST(f AS DOUBLE) ELSE 1e0 END) * (1 + wt / total) AS score FROM sums QUALIFY score > 0)""".replace("QUALIFY score > 0", "WHERE (CASE WHEN f > 0 THEN (s - f) / CAST(f AS DOUBLE) ELSE 1e0 END) * (1 + wt / total) > 0")
SEEDS_SQL = """
seeds AS (SELECT term, score, row_number() OVER (ORDER BY round(score, 9) DESC, term) - 1 AS i FROM trending QUALIFY i < 30),
hits AS (SELECT t.paper_id, s.i FROM tt t, seeds s WHERE contains(t.txt, s.term)),
masks AS (SELECT paper_id, CAST(sum(CAST(1 AS BIGINT) << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM hits GROUP BY paper_id),
mask_n AS (SELECT mask, count(*) AS n FROM masks GROUP BY mask)"""


def greedy_sql(name: str, min_papers: int) -> str:
    return f"""
{name}_g AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS used UNION ALL
  SELECT g.i + 1, CASE WHEN (SELECT coalesce(sum(n), 0) FROM mask_n WHERE (mask & (CAST(1 AS BIGINT) << g.i)) <> 0 AND (mask & g.used) = 0) >= {min_papers}
    THEN g.used | (CAST(1 AS BIGINT) << g.i) ELSE g.used END FROM {name}_g g WHERE g.i < 30),
{name}_m AS (SELECT h.paper_id, min(h.i) AS seed_no FROM hits h WHERE ((SELECT max(used) FROM {name}_g) & (CAST(1 AS BIGINT) << CAST(h.i AS INTEGER))) <> 0 GROUP BY h.paper_id)"""


def topics_sql(name: str) -> str:
    return f"""
{name}_rel AS (SELECT seed_no, word, n, row_number() OVER (PARTITION BY seed_no ORDER BY n DESC, word) AS rank FROM (SELECT seed_no, word, count(*) AS n FROM (
   SELECT DISTINCT m.seed_no, m.paper_id, unnest({toks_sql('txt', tx.RELATED_STOP, 3)}) AS word FROM {name}_m m JOIN tt USING (paper_id)) x JOIN seeds s ON s.i = x.seed_no WHERE word <> s.term GROUP BY ALL)),
{name}_kw AS (SELECT seed_no, list(word ORDER BY rank) AS related FROM {name}_rel WHERE rank <= 9 GROUP BY seed_no),
{name}_t AS (SELECT m.seed_no, s.term AS keyword, s.score AS growth, count(*) AS n_papers, min(t.pub) AS first_seen, avg(date_diff('day', t.pub, TIMESTAMP '2024-01-31')) AS avg_age
   FROM {name}_m m JOIN tt t USING (paper_id) JOIN seeds s ON s.i = m.seed_no GROUP BY ALL),
{name}_mom AS (SELECT term, CASE WHEN count(*) < 2 THEN 0e0 ELSE -regr_slope(n, day) / avg(n) END AS momentum FROM timeline WHERE term IN (SELECT keyword FROM {name}_t) GROUP BY term),
{name} AS (SELECT 'trend_' || substr(md5(keyword), 1, 8) AS topic_id, seed_no, keyword, [keyword] || coalesce(related, []) AS keywords, n_papers, first_seen, growth,
   least(1e0, ln(1 + n_papers) / ln(51e0)) * 40 + greatest(0e0, least(1e0, growth)) * 30 + greatest(0e0, 1 - avg_age / {WINDOW}e0) * 20 + least(1e0, (1 + coalesce(len(related), 0)) / 10e0) * 10 AS trend_score,
   coalesce(momentum, 0e0) AS momentum, n_papers / {WINDOW}e0 AS velocity FROM {name}_t LEFT JOIN {name}_kw USING (seed_no) LEFT JOIN {name}_mom ON term = keyword)"""


def rsql(*ctes: str, body: str) -> str:
    return sql(*ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


TOPIC_CTES = (PAPERS_SQL, TEXT_SQL, TRENDING_SQL, SEEDS_SQL, greedy_sql("main", 5), topics_sql("main"))


def line(spark, sf_dir):
    return trends.keyword_timeline(papers(spark, sf_dir), as_of(), WINDOW)


def seeds(spark, sf_dir):
    often = trends.keyword_timeline(papers(spark, sf_dir), as_of(), WINDOW, trends.LEAST_USES)
    found = trends.seed_terms(trends.trending_keywords(often, trends.LEAST_USES, WINDOW))
    del often
    give_back()
    return found


def members(spark, sf_dir, min_papers=5):
    return trends.topic_papers(papers(spark, sf_dir), seeds(spark, sf_dir), min_papers)


def topic_table(spark, sf_dir):
    p = papers(spark, sf_dir)
    chosen = seeds(spark, sf_dir)
    tl = trends.seed_timeline(p, as_of(), chosen, WINDOW)
    return trends.topics(trends.topic_papers(p, chosen, 5), tl, as_of(), WINDOW)


@register("x10_tokens", sql(PAPERS_SQL, TEXT_SQL, body="SELECT paper_id, word, count(*) AS n FROM (SELECT paper_id, unnest(w) AS word FROM toks) GROUP BY ALL"))
def tokens(spark, sf_dir):
    t = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.TIMELINE_STOP, 3)
    return papers(spark, sf_dir).select("paper_id", F.explode(t).alias("word")).groupBy("paper_id", "word").agg(F.count("*").alias("n"))


@register("x11_bigrams", sql(PAPERS_SQL, TEXT_SQL, body=
    "SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM toks) GROUP BY ALL"))
def bigrams(spark, sf_dir):
    t = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.TIMELINE_STOP, 3)
    b = papers(spark, sf_dir).select(t.alias("t")).select(F.explode(tx.bigrams(F.col("t"))).alias("bigram"))
    return b.groupBy("bigram").agg(F.count("*").alias("n"))


_PROFILES = ", ".join(f"({q(i.interest_id)}, {q(scoring.interest_profile_text(i))})" for i in INTERESTS)


def fit_terms_sql(src: str, key: str, text: str) -> str:
    plain = f"regexp_replace(strip_accents(lower({text})), '[A-Za-z0-9]*(?:_|[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\PN])[\\p{{L}}\\p{{N}}_]*', '.', 'g')"
    w = f"list_filter(regexp_extract_all({plain}, '\\b[a-zA-Z][a-zA-Z0-9-]*[a-zA-Z0-9]\\b|\\b[a-zA-Z]\\b'), lambda x: x NOT IN {_in_list(tx.TFIDF_STOP)})"
    return f"SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT {key}, {w} AS w FROM {src})"


FIT_SQL = f"""
dt AS (SELECT paper_id, term, count(*) AS tf FROM ({fit_terms_sql('papers', 'paper_id', "title || ' ' || abstract")}) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM papers),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY term HAVING count(*) <= 0.95e0 * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT 5000),
model AS (SELECT *, ln((1 + (SELECT n FROM nd)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM vocab)"""
FITTED_SQL = f"""
pt AS (SELECT interest_id, term, count(*) AS tf FROM ({fit_terms_sql('(SELECT * FROM (VALUES ' + _PROFILES + ') v(interest_id, p))', 'interest_id', 'p')}) GROUP BY ALL),
pw AS (SELECT interest_id, term, tf * idf AS w FROM pt JOIN model USING (term)),
dw AS (SELECT paper_id, term, tf * idf AS w FROM dt JOIN model USING (term)),
pn AS (SELECT interest_id, sqrt(sum(w * w)) AS n FROM pw GROUP BY 1), dn AS (SELECT paper_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1),
dots AS (SELECT paper_id, interest_id, sum(d.w * p.w) AS s FROM dw d JOIN pw p USING (term) GROUP BY ALL)"""


def raw_text():
    return F.concat_ws(" ", "title", "abstract")


@register("x12_tfidf_fit", sql(PAPERS_SQL, FIT_SQL, body="SELECT term, df, cf, round(idf, 6) AS idf FROM model"))
def fit(spark, sf_dir):
    return tfidf.fit(papers(spark, sf_dir), "paper_id", raw_text()).withColumn("idf", F.round("idf", 6))


@register("x13_x15_tfidf_fitted_score", sql(PAPERS_SQL, FIT_SQL, FITTED_SQL, body="""
SELECT p.paper_id, i.interest_id, round(coalesce(s / (dn.n * i.n), 0e0), 6) AS tfidf_score FROM papers p CROSS JOIN pn i LEFT JOIN dots d ON d.paper_id = p.paper_id AND d.interest_id = i.interest_id LEFT JOIN dn ON dn.paper_id = p.paper_id"""))
def fitted(spark, sf_dir):
    p = papers(spark, sf_dir)
    path = scratch_path(spark, "tfidf")
    tfidf.save(tfidf.fit(p, "paper_id", raw_text()), path)
    model = tfidf.load(spark, path)
    return tfidf.score(p, "paper_id", raw_text(), model, INTERESTS).withColumn("tfidf_score", F.round("tfidf_score", 6))


@register("a10_keyword_timeline", sql(PAPERS_SQL, TEXT_SQL, body="SELECT * FROM timeline"))
def timeline(spark, sf_dir):
    return line(spark, sf_dir)


@register("a11_trending_keywords", sql(PAPERS_SQL, TEXT_SQL, TRENDING_SQL, body="SELECT term, total, round(score, 12) AS score FROM trending"))
def trending(spark, sf_dir):
    return trends.trending_keywords(line(spark, sf_dir), 3, WINDOW).withColumn("score", F.round("score", 12))


@register("a11_trending_offsets_ascending", sql(PAPERS_SQL, TEXT_SQL, TRENDING_SQL.replace("ORDER BY day DESC", "ORDER BY day"), body="SELECT term, total, round(score, 12) AS score FROM trending"))
def trending_reference(spark, sf_dir):
    return trends.trending_keywords(line(spark, sf_dir), 3, WINDOW, "reference").withColumn("score", F.round("score", 12))


@register("a14_keyword_momentum", sql(PAPERS_SQL, TEXT_SQL, body=
    "SELECT term, round(CASE WHEN count(*) < 2 THEN 0e0 ELSE -regr_slope(n, day) / avg(n) END, 6) AS momentum FROM timeline GROUP BY term"))
def momentum(spark, sf_dir):
    return trends.momentum(line(spark, sf_dir)).select("term", F.round("momentum", 6).alias("momentum"))


@register("j15_seed_matches", sql(PAPERS_SQL, TEXT_SQL, TRENDING_SQL, SEEDS_SQL, body="SELECT term AS seed, paper_id FROM hits JOIN seeds USING (i)"))
def seed_matches(spark, sf_dir):
    return trends.seed_matches(papers(spark, sf_dir), [s for s, _ in seeds(spark, sf_dir)])


@register("m8_topic_papers", rsql(*TOPIC_CTES, body="SELECT paper_id, CAST(seed_no AS INTEGER) AS seed_no FROM main_m"))
def topic_papers(spark, sf_dir):
    return members(spark, sf_dir).select("paper_id", "seed_no")


@register("a12_related_keywords", rsql(*TOPIC_CTES, body="SELECT s.term AS keyword, word, n, rank FROM main_rel JOIN seeds s ON s.i = seed_no WHERE rank <= 10"))
def related(spark, sf_dir):
    return trends.related_keywords(members(spark, sf_dir))


@register("a13_a15_m8_trending_topics", rsql(*TOPIC_CTES, body="""
SELECT topic_id, keyword, n_papers, array_to_string(keywords, ',') AS keywords, strftime(first_seen, '%Y-%m-%d') AS first_seen, round(trend_score, 6) AS trend_score, round(momentum, 6) AS momentum, round(velocity, 6) AS velocity FROM main"""))
def trending_topics(spark, sf_dir):
    return topic_table(spark, sf_dir).select(
        "topic_id", "keyword", "n_papers", F.array_join("keywords", ",").alias("keywords"),
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.round("trend_score", 6).alias("trend_score"),
        F.round("momentum", 6).alias("momentum"), F.round("velocity", 6).alias("velocity"))


@register("j12_related_trends", rsql(*TOPIC_CTES, body="""
SELECT topic_id, other_id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY sim DESC, other_id) AS rank FROM (
  SELECT a.topic_id, b.topic_id AS other_id, len(list_intersect(a.keywords, b.keywords)) / CAST(len(list_distinct(a.keywords || b.keywords)) AS DOUBLE) AS sim FROM main a, main b WHERE a.topic_id <> b.topic_id) WHERE sim > 0) WHERE rank <= 5"""))
def related_trends(spark, sf_dir):
    return trends.related_trends(topic_table(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@register("f18_relevant_topics", rsql(*TOPIC_CTES, body="SELECT topic_id, keyword FROM main WHERE list_has_any(keywords, ['tion', 'rewh', 'pour', 'avec', 'ther'])"))
def relevant(spark, sf_dir):
    return trends.relevant_topics(topic_table(spark, sf_dir), ["Tion rewh", "pour avec ther"]).select("topic_id", "keyword")


@register("f19_declining_topics", rsql(*TOPIC_CTES, body="SELECT topic_id, round(momentum, 6) AS momentum FROM main WHERE momentum < -0.0001 ORDER BY momentum, seed_no LIMIT 5"))
def declining(spark, sf_dir):
    return trends.declining_topics(topic_table(spark, sf_dir), 5, -0.0001).select("topic_id", F.round("momentum", 6).alias("momentum"))


@register("s13_trend_export", rsql(*TOPIC_CTES, body="""
SELECT topic_id, keyword, format('{:.2f}', trend_score) AS trend_score, format('{:.3f}', momentum) AS momentum, n_papers AS paper_count, array_to_string(list_slice(keywords, 1, 5), ';') AS keywords FROM main"""))
def trend_export(spark, sf_dir):
    t = topic_table(spark, sf_dir)
    return trends.export_topics(t).join(t.select("topic_id", "keyword"), "topic_id").drop("name")


VELOCITY_SQL = """
vel AS (SELECT paper_id, citation_count / CAST(greatest(date_diff('day', pub, TIMESTAMP '2024-01-31'), 1) AS DOUBLE) AS velocity FROM tt
   WHERE coalesce(citation_count, 0) > 0 AND greatest(date_diff('day', pub, TIMESTAMP '2024-01-31'), 1) <= 365)"""


@register("w3_citation_velocity", sql(PAPERS_SQL, TEXT_SQL, VELOCITY_SQL, body="SELECT paper_id, round(velocity, 6) AS velocity, round(cume_dist() OVER (ORDER BY velocity) * 100, 6) AS percentile FROM vel"))
def velocity(spark, sf_dir):
    v = trends.citation_velocity(papers(spark, sf_dir), as_of(), None)
    return v.select("paper_id", F.round("velocity", 6).alias("velocity"), F.round("percentile", 6).alias("percentile"))


def snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("topic_id"), F.col("user_id").alias("paper_id"), F.col("event_id").alias("snapshot_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("trend_score"), F.col("value").alias("velocity"),
    )


@register("w4_velocity_acceleration", sql("""
l AS (SELECT user_id AS paper_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)""", body="""
SELECT paper_id, round(value, 6) AS velocity, round(CASE WHEN coalesce(prev, 0) = 0 THEN 0e0 ELSE value - prev END, 6) AS acceleration FROM l WHERE rn = 1"""))
def accel(spark, sf_dir):
    a = trends.acceleration(snapshots(spark, sf_dir))
    return a.select("paper_id", F.round("velocity", 6).alias("velocity"), F.round("acceleration", 6).alias("acceleration"))


KEPT_SQL = "kept AS (SELECT event_type AS topic_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 30)"


@register("w5_keep_snapshots", sql(KEPT_SQL, body="SELECT topic_id, event_id AS snapshot_id, value AS trend_score FROM kept"))
def keep(spark, sf_dir):
    return trends.keep_snapshots(snapshots(spark, sf_dir)).select("topic_id", "snapshot_id", "trend_score")


@register("a16_topic_history", sql(KEPT_SQL, body="SELECT topic_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value AS trend_score, event_id % 97 AS paper_count FROM kept"))
def history(spark, sf_dir):
    counted = snapshots(spark, sf_dir).withColumn("paper_count", F.col("snapshot_id") % 97)
    h = trends.topic_history(counted, values=("trend_score", "paper_count"))
    return h.select("topic_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "trend_score", "paper_count")


@register("a16_topic_evolution", sql(KEPT_SQL, """
o AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY topic_id) AS c FROM kept),
g AS (SELECT topic_id, arg_max(value, i) AS current_score, avg(value) AS average_score, max(value) AS peak_score, min(value) AS min_score, count(*) AS data_points,
  arg_min(ts, (-value, i)) AS peak_date, avg(value) FILTER (WHERE i > c - 3) - avg(value) FILTER (WHERE i <= 3) AS d FROM o GROUP BY topic_id)""", body="""
SELECT topic_id, current_score, round(average_score, 6) AS average_score, peak_score, min_score, data_points, strftime(peak_date, '%Y-%m-%d %H:%M:%S') AS peak_date,
  CASE WHEN data_points < 3 THEN 'emerging' WHEN d > 5 THEN 'growing' WHEN d < -5 THEN 'declining' ELSE 'stable' END AS phase FROM g"""))
def evolution(spark, sf_dir):
    e = trends.topic_evolution(snapshots(spark, sf_dir))
    return e.withColumn("average_score", F.round("average_score", 6)).withColumn("peak_date", F.date_format("peak_date", "yyyy-MM-dd HH:mm:ss"))


REPORT_CTES = (*TOPIC_CTES, greedy_sql("wide", 3), topics_sql("wide"), VELOCITY_SQL, """
top_main AS (SELECT *, row_number() OVER (ORDER BY trend_score DESC, seed_no) AS rank FROM main QUALIFY rank <= 10),
top_wide AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY trend_score DESC, seed_no) AS r FROM wide) WHERE r <= 50 AND momentum < -0.2),
report AS (SELECT 'trending' AS section, rank, keyword AS name, trend_score AS value FROM top_main
 UNION ALL SELECT * FROM (SELECT 'rapidly_cited', row_number() OVER (ORDER BY velocity DESC, paper_id) AS rank, CAST(paper_id AS VARCHAR), velocity FROM vel QUALIFY rank <= 20)
 UNION ALL SELECT * FROM (SELECT 'emerging_keywords', row_number() OVER (ORDER BY round(score, 9) DESC, term) AS rank, term, score FROM trending QUALIFY rank <= 20)
 UNION ALL SELECT * FROM (SELECT 'declining', row_number() OVER (ORDER BY momentum, seed_no) AS rank, keyword, momentum FROM top_wide QUALIFY rank <= 5)
 UNION ALL SELECT 'relevant', row_number() OVER (ORDER BY trend_score DESC, seed_no), keyword, trend_score FROM top_main WHERE list_has_any(keywords, ['tion', 'that']))""")


@register("f17_recent_papers", sql(PAPERS_SQL, "dated AS (SELECT paper_id, coalesce(published_date, TIMESTAMP '2024-01-01') AS d FROM papers)", body="""
SELECT 'window' AS branch, paper_id FROM dated WHERE d >= TIMESTAMP '2024-01-01'
UNION ALL (SELECT 'newest', paper_id FROM dated ORDER BY d DESC, paper_id LIMIT 100)"""))
def recent_papers(spark, sf_dir):
    """Both branches of the rule: enough papers inside the window, and too few."""
    p = papers(spark, sf_dir)
    inside = trends.recent(p, as_of(), 30, min_papers=1).select(F.lit("window").alias("branch"), "paper_id")
    newest = trends.recent(p, as_of(), 30, min_papers=1 << 30).select(F.lit("newest").alias("branch"), "paper_id")
    return inside.unionByName(newest)


@register("a23_f17_trend_report", rsql(*REPORT_CTES, body="SELECT section, rank, lower(name) AS name, round(value, 6) AS value FROM report"))
def report(spark, sf_dir):
    r = trends.trend_report(papers(spark, sf_dir), as_of(), ["tion that"], WINDOW)
    return r.select("section", "rank", F.lower("name").alias("name"), F.round("value", 6).alias("value"))


@register("a23_report_summary", rsql(*REPORT_CTES, """
named AS (SELECT section, rank, CASE WHEN section IN ('trending', 'relevant') THEN array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE name END AS name FROM report),
parts AS (SELECT string_agg(name, ', ' ORDER BY rank) FILTER (WHERE section = 'trending' AND rank <= 3) AS t, string_agg(name, ', ' ORDER BY rank) FILTER (WHERE section = 'emerging_keywords' AND rank <= 5) AS e,
  string_agg(name, ', ' ORDER BY rank) FILTER (WHERE section = 'relevant' AND rank <= 3) AS r, least(count(*) FILTER (WHERE section = 'rapidly_cited'), 5) AS c FROM named),
line AS (SELECT concat_ws(' ', 'Top trending topics: ' || t || '.', CASE WHEN c > 0 THEN 'Found ' || c || ' rapidly-cited papers.' END, 'Emerging keywords: ' || e || '.', 'Relevant to your interests: ' || r || '.') AS text FROM parts)""", body="SELECT CASE WHEN text = '' THEN 'No significant trends detected.' ELSE text END AS summary FROM line"))
def summary(spark, sf_dir):
    return trends.report_summary(trends.trend_report(papers(spark, sf_dir), as_of(), ["tion that"], WINDOW))
