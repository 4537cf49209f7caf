"""Queries for sent history, feedback and reading lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow import schemas
from litflow.functions import keys
from litflow.operators import feedback as fb
from litflow.operators import history, reading
from litflow.plans.registry import register
from litflow.plans.views import ORDERS_AS_OF, PAPERS_SQL, as_of, papers, sql, table
from litflow.session import give_back, stored

# ---------------------------------------------------------------- history

HISTORY_SQL = """
keyed AS (SELECT *, coalesce('doi:' || doi, 'arxiv:' || arxiv_id, 'title:' || substr(trim(lower(title), ' \t\n\r'), 1, 100)) AS paper_key FROM papers),
sent AS (SELECT k.paper_key, e.ts AS sent_at FROM events e JOIN keyed k ON k.paper_id = e.event_id WHERE e.event_type IN ('view', 'click'))"""


def keyed_papers(spark, sf_dir) -> DataFrame:
    key = keys.paper_key("history", F.col("doi"), F.col("arxiv_id"), F.col("title"))
    return papers(spark, sf_dir).select("paper_id", key.alias("paper_key"))


def sent_history(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return keyed_papers(spark, sf_dir).join(
        e.select(F.col("event_id").alias("paper_id"), F.col("ts").cast("timestamp").alias("sent_at")), "paper_id"
    ).select("paper_key", "sent_at")


@register("j3_unsent_papers", sql(PAPERS_SQL, HISTORY_SQL, body=
    "SELECT paper_id, paper_key FROM keyed WHERE paper_key NOT IN (SELECT paper_key FROM sent)"))
def never_sent(spark, sf_dir):
    return history.unsent(keyed_papers(spark, sf_dir), sent_history(spark, sf_dir), as_of()).select("paper_id", "paper_key")


@register("j4_unsent_lookback", sql(PAPERS_SQL, HISTORY_SQL, body=
    "SELECT paper_id, paper_key FROM keyed WHERE paper_key NOT IN (SELECT paper_key FROM sent WHERE sent_at > TIMESTAMP '2024-01-31' - to_days(29))"))
def unsent_lookback(spark, sf_dir):
    return history.unsent(keyed_papers(spark, sf_dir), sent_history(spark, sf_dir), as_of(), 29).select("paper_id", "paper_key")


@register("j5_sent_flag", sql(PAPERS_SQL, HISTORY_SQL, body=
    "SELECT paper_id, paper_key IN (SELECT paper_key FROM sent) AS is_sent FROM keyed"))
def sent_flag(spark, sf_dir):
    return history.with_sent_flag(keyed_papers(spark, sf_dir), sent_history(spark, sf_dir), as_of()).select("paper_id", "is_sent")


@register("t5_history_retention", sql(PAPERS_SQL, HISTORY_SQL, body="""
SELECT paper_key, strftime(max(sent_at), '%Y-%m-%d %H:%M:%S') AS sent_at FROM sent WHERE sent_at > TIMESTAMP '2024-01-31' - to_days(30) GROUP BY paper_key"""))
def retention(spark, sf_dir):
    kept = history.retain(history.last_sent(sent_history(spark, sf_dir)), as_of(), 30)
    return kept.select("paper_key", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))


@register("t5_last_run", sql(PAPERS_SQL, HISTORY_SQL, body=
    "SELECT strftime(max(sent_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM sent"))
def last_run(spark, sf_dir):
    return history.last_run(sent_history(spark, sf_dir)).select(
        F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


# ---------------------------------------------------------------- feedback

FEEDBACK_SQL = """
feedback AS (SELECT p.paper_id, p.title, TIMESTAMP '2024-01-31' - to_days(CAST(p.paper_id % 45 AS INTEGER)) - to_hours(CAST(p.paper_id % 7 AS INTEGER)) AS sent_at,
   p.paper_id % 3 <> 0 AS read, CASE l.quality WHEN 1 THEN 'up' WHEN 0 THEN 'down' END AS rating, (p.paper_id % 100) / 100e0 AS relevance_score, p.journal
   FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id)"""


def feedback(spark, sf_dir) -> DataFrame:
    k = F.col("paper_id")
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("paper_id"),
        F.when(F.col("quality") == 1, "up").when(F.col("quality") == 0, "down").alias("rating"),
    )
    sent = as_of() - F.make_dt_interval((k % 45).cast("int"), (k % 7).cast("int"))
    return papers(spark, sf_dir).select(
        "paper_id", "title", "journal", sent.alias("sent_at"), (k % 3 != 0).alias("read"),
        ((k % 100) / 100).alias("relevance_score"),
    ).join(lab, "paper_id", "left")


@register("a5_feedback_stats", sql(PAPERS_SQL, FEEDBACK_SQL, body="""
SELECT count(*) AS total_sent, count(*) FILTER (WHERE read) AS total_read, count(*) FILTER (WHERE rating = 'up') AS thumbs_up, count(*) FILTER (WHERE rating = 'down') AS thumbs_down,
  round(avg(relevance_score) FILTER (WHERE rating = 'up'), 6) AS avg_score_up, round(avg(relevance_score) FILTER (WHERE rating = 'down'), 6) AS avg_score_down,
  round(count(*) FILTER (WHERE read) / count(*)::DOUBLE, 6) AS read_rate, round(count(*) FILTER (WHERE rating = 'up') / count(rating)::DOUBLE, 6) AS positive_rate
FROM feedback WHERE sent_at >= TIMESTAMP '2024-01-31' - to_days(30)"""))
def feedback_stats(spark, sf_dir):
    s = fb.feedback_stats(feedback(spark, sf_dir), as_of(), 30)
    return s.select("total_sent", "total_read", "thumbs_up", "thumbs_down", *[
        F.round(c, 6).alias(c) for c in ("avg_score_up", "avg_score_down", "read_rate", "positive_rate")])


@register("a6_keyword_feedback", sql(PAPERS_SQL, FEEDBACK_SQL, body="""
SELECT word, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down FROM (
  SELECT DISTINCT paper_id, rating, unnest(regexp_split_to_array(trim(lower(title), ' \t\n\r'), '\\s+')) AS word FROM feedback WHERE rating IS NOT NULL) WHERE length(word) >= 4 GROUP BY word"""))
def keyword_feedback(spark, sf_dir):
    return fb.keyword_feedback(feedback(spark, sf_dir))


@register("f14_unread_recent", sql(PAPERS_SQL, FEEDBACK_SQL, body=
    "SELECT paper_id, relevance_score FROM feedback WHERE NOT read AND sent_at > TIMESTAMP '2024-01-31' - to_days(7)"))
def unread(spark, sf_dir):
    return fb.unread(feedback(spark, sf_dir), as_of(), 7).select("paper_id", "relevance_score")


@register("w17_weekly_wrapup", sql(PAPERS_SQL, FEEDBACK_SQL, body="""
SELECT journal, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY relevance_score DESC, paper_id) AS rank FROM feedback
  WHERE NOT read AND sent_at > TIMESTAMP '2024-01-31' - to_days(7)) WHERE rank <= 10"""))
def wrapup(spark, sf_dir):
    return fb.weekly_wrapup(feedback(spark, sf_dir), as_of(), 10, by="journal").select("journal", "paper_id", "rank")


# ---------------------------------------------------------------- reading lists

LISTS_SQL = """
lists AS (SELECT o_orderkey AS list_id, o_custkey AS user_id, 'list ' || o_orderkey AS name, o_orderstatus = 'P' AS is_archived, o_orderkey % 5 = 0 AS is_default, o_orderdate AS updated_at FROM orders),
lines AS (SELECT l.*, o.*, p.p_name, p.p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position
   FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey LEFT JOIN part p ON p_partkey = l_partkey),
items AS (SELECT l_orderkey AS list_id, o_custkey AS user_id, 'list ' || l_orderkey AS list_name, o_orderstatus = 'P' AS is_archived, l_orderkey || '-' || position AS item_id, CAST(l_partkey AS VARCHAR) AS paper_id,
   p_name AS title, p_brand || ' {notes} on ' || p_name AS abstract, ['Ann ' || p_brand, 'Bo Lee'] AS authors, 'https://x.example/' || l_partkey AS url,
   CASE WHEN l_partkey % 2 = 0 THEN '10.2000/' || l_partkey END AS doi, CASE WHEN l_partkey % 3 = 0 THEN 'a' || l_partkey END AS arxiv_id,
   CASE WHEN l_returnflag = 'A' THEN 'finished' WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'skipped' ELSE 'reference' END WHEN l_linenumber = 3 THEN 'reading' ELSE 'to_read' END AS status,
   CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
   o_orderdate AS added_at, CASE WHEN l_partkey % 10 > 0 THEN o_orderdate END AS started_at, CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS finished_at,
   'line ' || l_linenumber AS notes, ['st' || l_linestatus, 'q' || CAST(floor(l_quantity / 10) AS INTEGER)] AS tags,
   CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber - 1 AS INTEGER) END AS rating, position, CASE WHEN l_partkey % 4 = 0 THEN l_shipdate END AS due_date, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'feed' END AS source, l_discount AS relevance_score FROM lines)"""


def lists(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("list_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("list "), k.cast("string")).alias("name"),
        (F.col("o_orderstatus") == "P").alias("is_archived"), (k % 5 == 0).alias("is_default"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def items(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x = (
        li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                  "l_returnflag", "l_linestatus", "l_shipdate")
        .withColumn("position", F.row_number().over(w) - 1)
        .join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"), "left")
    )
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    flag = F.col("l_returnflag")
    status = (
        F.when(flag == "A", "finished")
        .when(flag == "R", F.when(line % 2 == 0, "skipped").otherwise("reference"))
        .when(line == 3, "reading").otherwise("to_read")
    )
    pr = F.substring("o_orderpriority", 1, 1)
    text = lambda *cs: F.concat(*cs)
    return x.select(
        key.alias("list_id"), F.col("o_custkey").alias("user_id"), text(F.lit("list "), key.cast("string")).alias("list_name"),
        (F.col("o_orderstatus") == "P").alias("is_archived"),
        text(key.cast("string"), F.lit("-"), F.col("position").cast("string")).alias("item_id"),
        part.cast("string").alias("paper_id"), F.col("p_name").alias("title"),
        text("p_brand", F.lit(" {notes} on "), "p_name").alias("abstract"),
        F.array(text(F.lit("Ann "), "p_brand"), F.lit("Bo Lee")).alias("authors"),
        text(F.lit("https://x.example/"), part.cast("string")).alias("url"),
        F.when(part % 2 == 0, text(F.lit("10.2000/"), part.cast("string"))).alias("doi"),
        F.when(part % 3 == 0, text(F.lit("a"), part.cast("string"))).alias("arxiv_id"),
        status.alias("status"),
        F.when(pr == "1", "urgent").when(pr == "2", "high").when(pr == "3", "medium").otherwise("low").alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("added_at"),
        F.when(part % 10 > 0, F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.when(flag == "A", F.col("l_shipdate").cast("timestamp")).alias("finished_at"),
        text(F.lit("line "), line.cast("string")).alias("notes"),
        F.array(text(F.lit("st"), "l_linestatus"), text(F.lit("q"), F.floor(F.col("l_quantity") / 10).cast("string"))).alias("tags"),
        F.when(line < 6, (line - 1).cast("int")).alias("rating"), "position",
        F.when(part % 4 == 0, F.col("l_shipdate").cast("timestamp")).alias("due_date"),
        F.when(line % 2 == 0, "").otherwise("feed").alias("source"), F.col("l_discount").alias("relevance_score"),
    )


def now():
    return F.lit(ORDERS_AS_OF).cast("timestamp")


@register("f11_search_items", sql(LISTS_SQL, body="""
SELECT list_id, item_id FROM items WHERE NOT is_archived AND contains(lower(title || ' ' || abstract || ' ' || notes), 'widget') AND status IN ('to_read', 'finished') AND list_has_any(tags, ['q2', 'q3'])"""))
def search(spark, sf_dir):
    return reading.search(items(spark, sf_dir), "Widget", statuses=["to_read", "finished"], tags=["q2", "q3"]).select("list_id", "item_id")


@register("f12_items_by_attribute", sql(LISTS_SQL, body="""
SELECT 'status' AS kind, item_id FROM items WHERE status = 'reading' UNION ALL SELECT 'tag', item_id FROM items WHERE list_contains(tags, 'q4') UNION ALL SELECT 'priority', item_id FROM items WHERE priority = 'urgent'"""))
def by_attribute(spark, sf_dir):
    x = items(spark, sf_dir)
    parts = [("status", reading.by_status(x, "reading")), ("tag", reading.by_tag(x, "q4")), ("priority", reading.by_priority(x, "urgent"))]
    out = [d.select(F.lit(k).alias("kind"), "item_id") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("f13_open_lists", sql(LISTS_SQL, body="SELECT list_id, name FROM lists WHERE NOT is_archived"))
def open_lists(spark, sf_dir):
    return reading.open_lists(lists(spark, sf_dir)).orderBy(F.col("updated_at").desc(), "list_id").select("list_id", "name")


@register("f13_default_list", sql(LISTS_SQL, body="""
SELECT user_id, list_id FROM lists QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, is_archived, list_id) = 1"""))
def default_list(spark, sf_dir):
    return reading.default_list(lists(spark, sf_dir)).select("user_id", "list_id")


@register("a8_list_stats", sql(LISTS_SQL, body="""
SELECT list_id, count(*) AS total_papers, count(*) FILTER (WHERE status = 'to_read') AS to_read, count(*) FILTER (WHERE status = 'reading') AS reading, count(*) FILTER (WHERE status = 'finished') AS finished,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'reference') AS reference,
  round(avg(floor((epoch(finished_at) - epoch(started_at)) / 86400)) FILTER (WHERE status = 'finished'), 6) AS avg_days_to_finish,
  count(*) FILTER (WHERE status = 'finished' AND finished_at >= TIMESTAMP '2001-07-25') AS finished_week, count(*) FILTER (WHERE status = 'finished' AND finished_at >= TIMESTAMP '2001-07-01') AS finished_month,
  round(avg(rating), 6) AS avg_rating, round(count(*) FILTER (WHERE status = 'finished') / count(*)::DOUBLE, 6) AS completion_rate FROM items GROUP BY list_id"""))
def list_stats(spark, sf_dir):
    s = reading.list_stats(items(spark, sf_dir), now())
    for c in ("avg_days_to_finish", "avg_rating", "completion_rate"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@register("a8_top_tags", sql(LISTS_SQL, body="""
SELECT list_id, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY n DESC, tag) AS rank
  FROM (SELECT list_id, tag, count(*) AS n FROM (SELECT list_id, unnest(tags) AS tag FROM items) GROUP BY ALL)) WHERE rank <= 10"""))
def top_tags(spark, sf_dir):
    return reading.top_tags(items(spark, sf_dir)).select("list_id", "tag", F.col("count").alias("n"), "rank")


@register("a9_global_stats", sql(LISTS_SQL, body="""
SELECT (SELECT count(*) FROM lists WHERE NOT is_archived) AS total_lists, count(*) AS total_papers, count(*) FILTER (WHERE status = 'to_read') AS to_read, count(*) FILTER (WHERE status = 'reading') AS reading,
  count(*) FILTER (WHERE status = 'finished') AS finished, count(*) FILTER (WHERE status = 'skipped') AS skipped, round(avg(rating) FILTER (WHERE rating <> 0), 6) AS avg_rating,
  round(count(*) FILTER (WHERE status = 'finished') / count(*)::DOUBLE, 6) AS completion_rate FROM items WHERE NOT is_archived"""))
def global_stats(spark, sf_dir):
    s = reading.global_stats(items(spark, sf_dir), lists(spark, sf_dir))
    return s.withColumn("avg_rating", F.round("avg_rating", 6)).withColumn("completion_rate", F.round("completion_rate", 6))


@register("a9_global_tags", sql(LISTS_SQL, body="""
SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY n DESC, tag) AS rank
  FROM (SELECT list_id, tag, count(*) AS n FROM (SELECT list_id, unnest(tags) AS tag FROM items WHERE NOT is_archived) GROUP BY ALL)) WHERE rank <= 10 GROUP BY tag ORDER BY n DESC, tag LIMIT 20"""))
def global_tags(spark, sf_dir):
    return reading.global_top_tags(items(spark, sf_dir))


@register("w9_suggest_next", sql(LISTS_SQL, body="""
SELECT user_id, item_id, round(s, 6) AS next_score FROM (SELECT *, CASE priority WHEN 'urgent' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 ELSE 5 END
   + CASE WHEN due_date IS NULL THEN 0 WHEN d < 0 THEN 200 WHEN d < 7 THEN 50 WHEN d < 30 THEN 20 ELSE 0 END + coalesce(relevance_score * 0.5e0, 0) + least(w * 0.5e0, 20) AS s
   FROM (SELECT *, floor((epoch(due_date) - epoch(TIMESTAMP '2001-08-01')) / 86400) AS d, floor((epoch(TIMESTAMP '2001-08-01') - epoch(added_at)) / 86400) AS w FROM items WHERE status = 'to_read' AND NOT is_archived))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) = 1"""))
def suggest(spark, sf_dir):
    return reading.suggest_next(items(spark, sf_dir), now()).select(
        "user_id", "item_id", F.round("next_score", 6).alias("next_score"))


@register("k11_add_to_list", sql(LISTS_SQL, body="""
, inc AS (SELECT list_id + 1 AS list_id, item_id, paper_id, title, position FROM items),
fresh AS (SELECT * FROM inc n WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.list_id = n.list_id AND (i.paper_id = n.paper_id OR i.title = n.title)))
SELECT list_id, item_id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM fresh g WHERE g.list_id = f.list_id AND g.paper_id = f.paper_id AND g.position < f.position)
 AND NOT EXISTS (SELECT 1 FROM fresh g WHERE g.list_id = f.list_id AND g.title = f.title AND g.position < f.position)""".strip().replace(", inc AS", "SELECT * FROM (WITH inc AS", 1) + ")"))
def add_to_list(spark, sf_dir):
    x = stored(items(spark, sf_dir).select("list_id", "item_id", "paper_id", "title", "position"))
    give_back()
    return reading.add_new(x, x.withColumn("list_id", F.col("list_id") + 1), ["position"]).select("list_id", "item_id")


@register("w11_reorder_items", sql(LISTS_SQL, body="""
SELECT list_id, item_id, row_number() OVER (PARTITION BY list_id ORDER BY CASE WHEN rating >= 2 THEN 10 - rating END NULLS LAST, position) - 1 AS position FROM items"""))
def reorder(spark, sf_dir):
    x = items(spark, sf_dir).select("list_id", "item_id", "position", "rating")
    wanted = x.where("rating >= 2").select("list_id", "item_id", (10 - F.col("rating")).alias("want"))
    return reading.reorder(x.drop("rating"), wanted).select("list_id", "item_id", "position")


@register("w11_renumber_after_removal", sql(LISTS_SQL, body="""
SELECT list_id, item_id, row_number() OVER (PARTITION BY list_id ORDER BY position) - 1 AS position FROM items WHERE status <> 'skipped'"""))
def renumber(spark, sf_dir):
    x = items(spark, sf_dir).where("status <> 'skipped'").select("list_id", "item_id", "position")
    return reading.renumber(x).select("list_id", "item_id", "position")


@register("w12_merge_lists", sql(LISTS_SQL, """
o AS (SELECT *, row_number() OVER (ORDER BY list_name, position, item_id) AS rn FROM items),
walk(rn, ids, titles) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
  SELECT x.rn, list_append(w.ids, x.paper_id), list_append(w.titles, x.title) FROM walk w,
    LATERAL (SELECT arg_min(paper_id, rn) AS paper_id, arg_min(title, rn) AS title, min(rn) AS rn FROM o WHERE o.rn > w.rn AND NOT list_contains(w.ids, o.paper_id) AND NOT list_contains(w.titles, o.title)) x WHERE x.rn IS NOT NULL)""", body="""
SELECT item_id, paper_id, title, CASE WHEN source = '' THEN list_name ELSE source END AS source, array_to_string(tags, ',') || ',from:' || list_name AS tags,
  CAST(NULL AS INTEGER) AS rating, CAST(NULL AS TIMESTAMP) AS started_at, row_number() OVER (ORDER BY rn) - 1 AS position FROM o JOIN walk USING (rn)""").replace("WITH ", "WITH RECURSIVE ", 1))
def merge_lists(spark, sf_dir):
    x = items(spark, sf_dir)
    m = reading.merge_lists(x, "merged", ["list_name", "position", "item_id"])
    return m.select("item_id", "paper_id", "title", "source", F.array_join("tags", ",").alias("tags"), "rating", "started_at", "position")


@register("w13_split_by_tag", sql(LISTS_SQL, body="""
SELECT item_id, CASE WHEN list_contains(tags, 'q3') THEN -list_id ELSE list_id END AS list_id FROM items"""))
def split(spark, sf_dir):
    return reading.split_by_tag(items(spark, sf_dir), "q3", -F.col("list_id")).select("item_id", "list_id")


@register("w13_move_items", sql(LISTS_SQL, body="""
SELECT item_id, to_list AS list_id, row_number() OVER (PARTITION BY to_list ORDER BY moved, list_id, position, item_id) - 1 AS position
FROM (SELECT *, status = 'reading' AS moved, CASE WHEN status = 'reading' THEN list_id + 1 ELSE list_id END AS to_list FROM items)"""))
def move(spark, sf_dir):
    x = items(spark, sf_dir)
    return reading.move_items(x, F.col("status") == "reading", F.col("list_id") + 1).select("item_id", "list_id", "position")


@register("w13_copy_items", sql(LISTS_SQL, body="""
SELECT list_id, item_id, coalesce(source, '') AS source FROM items UNION ALL
SELECT list_id, item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY list_id, paper_id ORDER BY position, item_id) AS r1, row_number() OVER (PARTITION BY list_id, title ORDER BY position, item_id) AS r2 FROM
 (SELECT list_id + 1 AS list_id, item_id, paper_id, title, position, 'Copied from ' || list_name AS source FROM items n WHERE status = 'reading'
  AND NOT EXISTS (SELECT 1 FROM items i WHERE i.list_id = n.list_id + 1 AND (i.paper_id = n.paper_id OR i.title = n.title)))) WHERE r1 = 1 AND r2 = 1"""))
def copy(spark, sf_dir):
    x = items(spark, sf_dir)
    c = reading.copy_items(x, F.col("status") == "reading", F.col("list_id") + 1, ["position", "item_id"])
    return c.select("list_id", "item_id", F.coalesce("source", F.lit("")).alias("source"))


@register("w14_tag_union", sql(LISTS_SQL, body="""
SELECT list_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT list_id, unnest(tags) AS tag FROM items) GROUP BY list_id"""))
def tag_union(spark, sf_dir):
    return reading.tag_union(items(spark, sf_dir)).select("list_id", F.array_join("tags", ",").alias("tags"))


@register("s9_bibtex", sql(LISTS_SQL, body="""
SELECT item_id, '@article{' || lower(regexp_extract(authors[1], '([^ ]*)$', 1) || year(added_at) || split_part(title, ' ', 1)) || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {' || title || '}',
  '  author = {' || array_to_string(authors, ' and ') || '}', '  doi = {' || doi || '}', '  url = {' || url || '}', '  eprint = {' || arxiv_id || '}', CASE WHEN arxiv_id IS NOT NULL THEN '  archiveprefix = {arXiv}' END,
  '  abstract = {' || substr(replace(replace(abstract, '{', ''), '}', ''), 1, 500) || '}', '  note = {' || notes || '}', '  keywords = {' || array_to_string(tags, ', ') || '}') || chr(10) || '}' AS value FROM items"""))
def bibtex(spark, sf_dir):
    return reading.bibtex(items(spark, sf_dir), ["position", "item_id"]).select("item_id", "value")


@register("s10_ris", sql(LISTS_SQL, body="""
SELECT item_id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)), 'DO  - ' || doi, 'UR  - ' || url, 'AB  - ' || substr(abstract, 1, 1000),
  array_to_string(list_transform(tags, lambda t: 'KW  - ' || t), chr(10)), 'N1  - ' || notes, 'ER  -') AS value FROM items"""))
def ris(spark, sf_dir):
    return reading.ris(items(spark, sf_dir), ["position", "item_id"]).select("item_id", "value")


@register("s8_json_round_trip", sql(LISTS_SQL, body="""
SELECT substr(sha256('me|' || list_id || '|import'), 1, 8) AS list_id, item_id, title, status, array_to_string(tags, ',') AS tags, rating, position FROM items"""))
def json_round_trip(spark, sf_dir):
    exported = reading.item_json(items(spark, sf_dir))
    back = reading.import_items(exported, F.lit("me"), schemas.LIST_ITEM)
    return back.select("list_id", "item_id", "title", "status", F.array_join("tags", ",").alias("tags"), "rating", "position")
