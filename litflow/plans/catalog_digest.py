"""Queries for digests, alerts, templates and topic clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from litflow.functions import keys
from litflow.functions import text as tx
from litflow.functions import vectors as vx
from litflow.operators import digest, selection, topics
from litflow.plans.catalog_graph import vectors
from litflow.plans.catalog_scores import CFG, SCORED_CTES, q, scored
from litflow.plans.catalog_trends import toks_sql
from litflow.plans.registry import register
from litflow.plans.views import AS_OF, AUTHORS_SQL, INTERESTS, PAPERS_SQL, as_of, papers, sql, table

CAP, FLOOR = 10, 0.1
N = len(INTERESTS)
DIGEST_CTES = (*SCORED_CTES, "cand AS (SELECT interest_id, trim(lower(title), ' \t\n\r') AS tk, arg_min(paper_id, (-total_score, paper_id)) AS paper_id, max(total_score) AS s FROM scored JOIN papers USING (paper_id) WHERE total_score >= 0.1e0 GROUP BY ALL)", *[
    f"sec{n} AS (SELECT *, row_number() OVER (ORDER BY s DESC, paper_id) AS position FROM cand WHERE interest_id = '{i.interest_id}'"
    + "".join(f" AND tk NOT IN (SELECT tk FROM sec{m})" for m in range(n)) + f" QUALIFY position <= {CAP})"
    for n, i in enumerate(INTERESTS)], "items AS (" + " UNION ALL ".join(f"SELECT * FROM sec{n}" for n in range(N)) + ")")


def rows(spark, sf_dir, keep=("paper_id", "title")):
    return scored(spark, sf_dir, keep)


def items(spark, sf_dir, keep=("paper_id", "title")):
    return digest.digest_items(rows(spark, sf_dir, keep), FLOOR, CAP)


@register("k10_w16_digest_items", sql(*DIGEST_CTES, body="SELECT interest_id, position, paper_id, round(s, 6) AS total_score FROM items"))
def digest_items(spark, sf_dir):
    return items(spark, sf_dir).select("interest_id", "position", "paper_id", F.round("total_score", 6).alias("total_score"))


@register("a3_x32_digest_totals", sql(*DIGEST_CTES, body="""
SELECT 'u0' AS user_id, count(*) AS total_papers, CAST(3 AS BIGINT) AS n_sections, count(*) > 0 AS has_content, 'Weekly Digest: ' || count(*) || ' papers across 3 interests' AS subject FROM items"""))
def totals(spark, sf_dir):
    s = rows(spark, sf_dir)
    return digest.digest_totals(digest.sections(digest.digest_items(s, FLOOR, CAP), s, FLOOR))


@register("a2_section_stats", sql(*DIGEST_CTES, body="""
SELECT interest_id, f AS total_papers_found, n AS shown, im AS immediate_count, wk AS weekly_count FROM (SELECT interest_id, count(*) AS f FROM scored WHERE total_score >= 0.1e0 GROUP BY 1)
JOIN (SELECT i.interest_id, count(*) AS n, count(*) FILTER (WHERE priority = 'immediate') AS im, count(*) FILTER (WHERE priority = 'weekly') AS wk FROM items i JOIN scored USING (paper_id, interest_id) GROUP BY 1) USING (interest_id)"""))
def section_stats(spark, sf_dir):
    s = rows(spark, sf_dir)
    return digest.sections(digest.digest_items(s, FLOOR, CAP), s, FLOOR).drop("user_id")


@register("w16_nested_digest", sql(*DIGEST_CTES, body="""
SELECT 'u0' AS user_id, string_agg(said, '/' ORDER BY interest_id) AS sections FROM
(SELECT interest_id, interest_id || '=' || string_agg(position || ':' || paper_id, ',' ORDER BY position) AS said FROM items GROUP BY interest_id)"""))
def nested(spark, sf_dir):
    n = digest.nested_digest(items(spark, sf_dir))
    listed = lambda s: F.array_join(F.transform(s["papers"], lambda p: F.concat_ws(":", p["position"].cast("string"), p["paper_id"].cast("string"))), ",")
    return n.select("user_id", F.array_join(F.transform("sections", lambda s: F.concat_ws("=", s["interest_id"], listed(s))), "/").alias("sections"))


SUMMARY_SQL = r"""
sents AS (SELECT paper_id, title, abstract, list_slice(list_filter(regexp_split_to_array(regexp_replace(trim(abstract, ' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: TRUE), 1, 3) AS s FROM papers),
summ AS (SELECT paper_id, CASE WHEN length(abstract) > 100 AND length(s[1]) < 400 THEN s[1] || CASE WHEN length(s[1]) + length(s[2]) < 400 THEN ' ' || s[2] || CASE WHEN length(s[1]) + length(s[2]) + length(s[3]) < 400 THEN ' ' || s[3] ELSE '' END ELSE '' END
   ELSE 'This paper explores ' || regexp_replace(lower(title), '\.+$', '') || '. See abstract for details.' END AS summary FROM sents)""".replace(r"' \t\n\r'", "' \t\n\r'")


@register("x28_extractive_summary", sql(PAPERS_SQL, SUMMARY_SQL.replace("|| CASE WHEN length(s[1]) + length(s[2]) < 400", "|| CASE WHEN len(s) >= 2 AND length(s[1]) + length(s[2]) < 400").replace("|| CASE WHEN length(s[1]) + length(s[2]) + length(s[3]) < 400", "|| CASE WHEN len(s) >= 3 AND length(s[1]) + length(s[2]) + length(s[3]) < 400"), body="SELECT * FROM summ"))
def summaries(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", tx.extractive_summary(F.col("title"), F.col("abstract")).alias("summary"))


def _note(i) -> str:
    hit = "list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(abstract), {q(k)}) THEN {q(k)} END" for k in i.keywords) + "], lambda x: x IS NOT NULL), 1, 3)"
    return (
        f"SELECT i.paper_id, i.interest_id, CASE WHEN len({hit}) > 0 THEN 'Relevant to {i.name}: discusses ' || array_to_string({hit}, ', ') || '.' "
        f"WHEN i.s >= 0.5 THEN 'Connects to your interest in {i.name}.' ELSE 'Some overlap with {i.name}.' END AS why FROM items i JOIN papers USING (paper_id) WHERE interest_id = '{i.interest_id}'")


@register("x29_x31_x32_enriched_items", sql(*DIGEST_CTES, body=f"""
SELECT i.interest_id, i.position, CASE WHEN position <= 4 THEN why END AS why_relevant, CASE WHEN len(authors) = 0 THEN 'Unknown' ELSE array_to_string(authors, ', ') END AS authors_display, CAST(floor(s * 100) AS INTEGER) AS score_percent
FROM items i JOIN ({' UNION ALL '.join(_note(i) for i in INTERESTS)}) USING (paper_id, interest_id) JOIN paper_authors USING (paper_id)"""))
def enriched(spark, sf_dir):
    it = items(spark, sf_dir)
    text = papers(spark, sf_dir, authors=True).select("paper_id", "abstract", "authors")
    e = digest.enrich(text.join(it, "paper_id"), INTERESTS, 4)
    return e.select("interest_id", "position", "why_relevant", "authors_display", "score_percent")


@register("x30_section_templates", sql(PAPERS_SQL, body="""
SELECT journal, 'This week brings ' || count(*) || ' new papers relevant to ' || journal || '. Several papers show promising advances in key areas of interest.' AS highlight,
 'Hi ' || 'Dr' || '! Your weekly research digest is ready with ' || count(*) || ' papers across ' || count(DISTINCT lang) || ' research interest' || CASE WHEN count(DISTINCT lang) > 1 THEN 's' ELSE '' END || '. Here are the highlights curated just for you.' AS intro
FROM papers GROUP BY journal"""))
def templates(spark, sf_dir):
    n = papers(spark, sf_dir).groupBy("journal").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("s"))
    return n.select("journal", tx.section_highlight(F.col("journal"), F.col("n")).alias("highlight"),
                    tx.digest_intro(F.lit("Dr Who"), F.lit("weekly"), F.col("n"), F.col("s")).alias("intro"))


FOLLOWED = ("Supplier#000000001", "HOUSEHOLD Customer")


@register("a7_suggested_authors", sql(*DIGEST_CTES, body="""
SELECT author, count(*) AS paper_count, arg_min(title, (o, position)) AS sample_paper FROM (SELECT title, position, CAST(substr(interest_id, 2) AS INTEGER) AS o, unnest(list_slice(authors, 1, 3)) AS author
  FROM items JOIN paper_authors USING (paper_id) JOIN papers USING (paper_id) WHERE s >= 0.3e0)
WHERE NOT (contains(lower(author), 'supplier#000000001') OR contains('supplier#000000001', lower(author)) OR contains(lower(author), 'household customer') OR contains('household customer', lower(author)))
GROUP BY author ORDER BY paper_count DESC, author LIMIT 5"""))
def suggested(spark, sf_dir):
    return digest.suggested_authors(items(spark, sf_dir, ("paper_id", "title", "authors")), FOLLOWED, 0.3)


@register("w15_immediate_alerts", sql(*SCORED_CTES, body=
    "SELECT interest_id, paper_id, round(total_score, 6) AS total_score FROM scored JOIN papers USING (paper_id) WHERE created_at >= TIMESTAMP '2024-01-29' AND total_score >= 0.4e0"))
def alerts(spark, sf_dir):
    from litflow.operators.scoring import score_papers

    p = selection.since(papers(spark, sf_dir, authors=True), as_of() - F.expr("INTERVAL 2 DAYS"))
    return digest.alerts(score_papers(p, INTERESTS, AS_OF, CFG), 0.4).select("interest_id", "paper_id", F.round("total_score", 6).alias("total_score"))


@register("j6_author_match_join", sql(AUTHORS_SQL, """
f AS (SELECT c_custkey AS follower, substr(c_mktsegment, 1, 1) || '. ' || c_name AS followed FROM customer UNION ALL SELECT s_suppkey, s_name || ', A' FROM supplier),
a AS (SELECT DISTINCT paper_id, unnest(authors) AS author FROM paper_authors),
ap AS (SELECT *, lower(regexp_extract(author, '([^ ]*)$', 1)) AS last, CASE WHEN contains(author, ' ') THEN lower(regexp_extract(author, '^(.*) [^ ]*$', 1)) ELSE '' END AS first FROM a),
fp AS (SELECT *, CASE WHEN contains(followed, ',') THEN lower(split_part(followed, ',', 1)) ELSE lower(regexp_extract(followed, '([^ ]*)$', 1)) END AS last, CASE WHEN contains(followed, ',') THEN 'a' ELSE lower(split_part(followed, ' ', 1)) END AS first FROM f)""", body="""
SELECT paper_id, author, follower, followed FROM ap JOIN fp USING (last) WHERE ap.first = '' OR ap.first[1] = fp.first[1]"""))
def author_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("follower"), F.concat(F.substring("c_mktsegment", 1, 1), F.lit(". "), "c_name").alias("followed"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("follower"), F.concat("s_name", F.lit(", A")).alias("followed"))
    return digest.author_join(papers(spark, sf_dir, authors=True), c.unionByName(s))


# ---------------------------------------------------------------- clusters


def language_members(spark, sf_dir):
    return papers(spark, sf_dir).withColumn("cluster_id", F.col("lang"))


KEYWORDS_SQL = f"""
ct AS (SELECT lang AS cluster_id, paper_id, unnest({toks_sql("lower(title || ' ' || abstract)", tx.CLUSTER_STOP, 2)}) AS term FROM papers),
cf AS (SELECT cluster_id, term, count(*) AS tf, count(DISTINCT paper_id) AS df FROM ct GROUP BY ALL HAVING count(DISTINCT paper_id) >= 2),
cn AS (SELECT lang AS cluster_id, count(*) AS n FROM papers GROUP BY 1),
ck AS (SELECT cluster_id, term, tf, df, tf * ln(n / CAST(df AS DOUBLE)) AS score FROM cf JOIN cn USING (cluster_id)),
kw AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term) AS rank FROM ck QUALIFY rank <= 10),
kl AS (SELECT cluster_id, list(term ORDER BY rank) AS keywords FROM kw GROUP BY 1)"""


@register("a17_cluster_keywords", sql(PAPERS_SQL, KEYWORDS_SQL, body="SELECT cluster_id, term, tf, df, round(score, 6) AS score, rank FROM kw"))
def cluster_keywords(spark, sf_dir):
    return topics.cluster_keywords(language_members(spark, sf_dir)).withColumn("score", F.round("score", 6))


def described(spark, sf_dir):
    kl = topics.keyword_lists(topics.cluster_keywords(language_members(spark, sf_dir)))
    return kl.withColumn("label", tx.keyword_label(F.col("keywords")))


@register("x33_cluster_labels", sql(PAPERS_SQL, KEYWORDS_SQL, body="""
SELECT cluster_id, upper(keywords[1][1]) || keywords[1][2:] || ' & ' || upper(keywords[2][1]) || keywords[2][2:] AS label,
 'cluster_' || cluster_id || '_' || substr(md5('[''' || array_to_string(list_slice(keywords, 1, 3), ''', ''') || ''']'), 1, 8) AS ref FROM kl"""))
def labels(spark, sf_dir):
    d = described(spark, sf_dir)
    return d.select("cluster_id", "label", topics.cluster_ref("cluster", F.col("cluster_id"), F.col("keywords")).alias("ref"))


@register("j14_assign_to_cluster", sql(PAPERS_SQL, KEYWORDS_SQL, """
pw AS (SELECT DISTINCT paper_id, unnest(regexp_split_to_array(trim(lower(title || ' ' || abstract), ' \t\n\r'), '\\s+')) AS w FROM papers),
h AS (SELECT paper_id, cluster_id, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM pw JOIN (SELECT cluster_id, len(keywords) AS n, unnest(keywords) AS w FROM kl) USING (w) GROUP BY ALL)""", body="""
SELECT paper_id, cluster_id, round(share, 6) AS share FROM h WHERE share >= 0.3 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY share DESC, cluster_id) = 1"""))
def assign(spark, sf_dir):
    c = described(spark, sf_dir).withColumn("cluster_ord", F.ascii("cluster_id") * 256 + F.ascii(F.substring("cluster_id", 2, 1)))
    return topics.assign_to_clusters(papers(spark, sf_dir), c, 0.3).withColumn("share", F.round("share", 6))


COH_SQL = """
u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)"""


@register("a18_cluster_coherence", sql(COH_SQL, body="""
SELECT label AS cluster_id, count(DISTINCT a.vec_id) + 1 AS size, round(avg(list_inner_product(a.e, b.e)), 6) AS coherence FROM u a JOIN u b USING (label) WHERE a.vec_id < b.vec_id GROUP BY label"""))
def coherence(spark, sf_dir):
    return topics.coherence(vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id")).withColumn("coherence", F.round("coherence", 6))


SIL_SQL = """
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(CASE WHEN a.vec_id <> b.vec_id THEN list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ELSE 0 END) AS t, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
s AS (SELECT vec_id, own, coalesce(max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END), 0) AS a, coalesce(min(CASE WHEN own <> other THEN t / n END), 0) AS b FROM d GROUP BY ALL)"""


@register("a19_silhouette", sql(SIL_SQL, body="SELECT vec_id AS paper_id, own AS cluster_id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM s"))
def silhouette(spark, sf_dir):
    s = topics.silhouette(vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    return s.withColumn("silhouette", F.round("silhouette", 5))


@register("a19_silhouette_squared", sql(SIL_SQL.replace("list_distance(", "power(list_distance(").replace("AS DOUBLE[])) ELSE", "AS DOUBLE[])), 2) ELSE"), body="SELECT vec_id AS paper_id, own AS cluster_id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM s"))
def silhouette_squared(spark, sf_dir):
    s = topics.silhouette_squared(vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    return s.withColumn("silhouette", F.round("silhouette", 5))


@register("m1_kmeans_clusters")
def kmeans(spark, sf_dir):
    return topics.cluster_embeddings(vectors(spark, sf_dir))[0]


@register("m1_kmeans_facts", "SELECT count(*) AS points, count(*) AS nearest_to_own, true AS large_enough FROM embeddings")
def kmeans_facts(spark, sf_dir):
    """Every point is assigned once, and to the centroid nearest to it; no kept cluster is below the least size."""
    a, c = topics.cluster_embeddings(vectors(spark, sf_dir), min_size=1)
    v = vectors(spark, sf_dir).select("paper_id", "embedding")
    centre = F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("centres")  # at most 20 centroids
    gap = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    near = v.crossJoin(c.agg(centre)).select("paper_id", F.array_min(F.transform("centres", lambda k: F.struct(gap(F.col("embedding"), k["centroid"]).alias("gap"), k["cluster_id"].alias("id")))).alias("best"))
    both = a.join(near, "paper_id")
    size = topics.cluster_embeddings(vectors(spark, sf_dir))[0].where("cluster_id IS NOT NULL").groupBy("cluster_id").count().agg((F.min("count") >= topics.MIN_SIZE).alias("large_enough"))
    return both.agg(F.count("*").alias("points"), F.count_if(F.col("best.id") == F.col("cluster_id")).alias("nearest_to_own")).crossJoin(size)


@register("m3_lda_facts", "SELECT count(*) AS papers, 5 AS topics, true AS shares_sum_to_one, 50 AS keywords FROM documents")
def lda_facts(spark, sf_dir):
    """Every paper has one topic, shares are a distribution, each topic has ten words."""
    a, t = topics.lda_topics(papers(spark, sf_dir), 5, min_size=1)
    n = a.where("cluster_id IS NOT NULL").agg(F.count("*").alias("papers"))
    return n.crossJoin(t.agg(F.count("*").alias("topics"), F.sum("share").between(0.99, 1.0 + 1e-6).alias("shares_sum_to_one"), F.sum(F.size("keywords")).alias("keywords")))


@register("x18_embedding_facts", "SELECT count(*) AS papers, 768 AS dims, true AS unit_length, count(DISTINCT lower(trim(text))) AS texts FROM documents")
def embedding_facts(spark, sf_dir):
    """Vectors of one length and norm 1, equal for equal texts only."""
    p = papers(spark, sf_dir).select(F.col("abstract").alias("t"))
    e = p.select(vx.hashed_embedder()(F.col("t")).alias("e"))
    return e.agg(F.count("*").alias("papers"), F.max(F.size("e")).alias("dims"), (F.max(F.abs(vx.norm(F.col("e")) - 1)) < 1e-5).alias("unit_length"), F.countDistinct("e").alias("texts"))


@register("m2_auto_k_clusters")
def auto_k(spark, sf_dir):
    return topics.cluster_auto_k(vectors(spark, sf_dir))[0]


@register("m2_k_sweep_facts", "SELECT least(21, count(*) // 3 + 1) - 2 AS candidates, true AS same_by_point FROM embeddings")
def k_sweep_facts(spark, sf_dir):
    """Every k is a candidate, and the best one's silhouette is the mean over points assigned to its nearest centroid."""
    v = vectors(spark, sf_dir).select("paper_id", "embedding")
    sweep, centres = topics.k_sweep(v)
    best = sweep.orderBy(F.col("silhouette").desc(), "k").first()
    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in c]).alias("c"), F.lit(i).alias("id")) for i, c in enumerate(centres[best["k"]])])
    gap = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    near = F.array_min(F.transform(rows, lambda r: F.struct(gap(F.col("embedding"), r["c"]).alias("gap"), r["id"].alias("id"))))
    s = topics.silhouette_squared(v.withColumn("cluster_id", near["id"]))
    s = s.join(s.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    alone = F.when(F.col("size") > 1, F.col("silhouette")).otherwise(0.0)  # a point alone in its cluster counts as 0 in the sweep
    same = F.abs(F.avg(alone) - best["silhouette"]) < 1e-6
    return s.agg(same.alias("same_by_point")).select(F.lit(sweep.count()).cast("long").alias("candidates"), "same_by_point")


@register("m3_lda_topics")
def lda(spark, sf_dir):
    return topics.lda_topics(papers(spark, sf_dir), 5)[1]


@register("m4_hybrid_clusters")
def hybrid(spark, sf_dir):
    return topics.cluster_hybrid(papers(spark, sf_dir), vectors(spark, sf_dir))


@register("j13_match_topics", sql("""
n AS (SELECT l.label AS cluster_id, d.source AS topic_id, count(*) AS overlap FROM embeddings l JOIN documents d ON d.doc_id = l.vec_id GROUP BY ALL)""", body=
    "SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY overlap DESC, topic_id) = 1"))
def match(spark, sf_dir):
    a = vectors(spark, sf_dir).select("paper_id", F.col("label").alias("cluster_id"))
    return topics.match_topics(a, papers(spark, sf_dir).select("paper_id", F.col("journal").alias("cluster_id")))


def keyed(spark, sf_dir):
    return papers(spark, sf_dir).withColumn("paper_key", keys.paper_key("topic", F.col("doi"), F.col("arxiv_id"), F.col("title")))


KEY_SQL = "coalesce('doi:' || doi, 'arxiv:' || arxiv_id, 'title:' || substr(md5(title), 1, 12))"


@register("s11_cluster_export", sql(PAPERS_SQL, KEYWORDS_SQL, body=f"""
SELECT lang AS cluster_id, array_to_string(list_slice(keywords, 1, 2), '&') AS cluster_label, {KEY_SQL} AS paper_id, substr(title, 1, 100) AS paper_title FROM papers JOIN kl ON cluster_id = lang"""))
def export(spark, sf_dir):
    d = described(spark, sf_dir).select("cluster_id", F.array_join(F.slice("keywords", 1, 2), "&").alias("label"))
    a = papers(spark, sf_dir).select("paper_id", F.col("lang").alias("cluster_id"))
    return topics.export_rows(a, keyed(spark, sf_dir), d)


@register("s12_cluster_graph_export", sql(PAPERS_SQL, body=f"""
SELECT lang AS id, 'c ' || lang AS label, 'cluster' AS type, count(*) AS size FROM papers GROUP BY lang UNION ALL SELECT {KEY_SQL}, substr(title, 1, 50), 'paper', NULL FROM papers"""))
def graph_export(spark, sf_dir):
    a = papers(spark, sf_dir).select("paper_id", F.col("lang").alias("cluster_id"))
    lab = a.select("cluster_id").distinct().withColumn("label", F.concat(F.lit("c "), "cluster_id"))
    return topics.export_graph(a, keyed(spark, sf_dir), lab)[0]


@register("s12_cluster_graph_links", sql(PAPERS_SQL, body=f"SELECT lang AS source, {KEY_SQL} AS target FROM papers"))
def graph_links(spark, sf_dir):
    a = papers(spark, sf_dir).select("paper_id", F.col("lang").alias("cluster_id"))
    lab = a.select("cluster_id").distinct().withColumn("label", F.concat(F.lit("c "), "cluster_id"))
    return topics.export_graph(a, keyed(spark, sf_dir), lab)[1]


@register("x16_x18_embeddings")
def embeddings(spark, sf_dir):
    p = papers(spark, sf_dir).select("paper_id", vx.paper_text(F.col("title"), F.col("abstract")).alias("t"))
    return p.select("paper_id", vx.hashed_embedder()(F.col("t")).alias("embedding"))
