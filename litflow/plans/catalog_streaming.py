"""Streaming queries: a table is replayed as a stream and its output read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from litflow.functions import keys
from litflow.operators.scoring import ScoringConfig
from litflow.plans.catalog_scores import SCORED_CTES
from litflow.plans.catalog_trends import TEXT_SQL
from litflow.plans.registry import register
from litflow.plans.views import AS_OF, AUTHORS_SQL, INTERESTS, PAPERS_SQL, paper_columns, papers, sql, table, with_authors
from litflow.streaming import jobs


def stream_papers(spark, sf_dir, authors=False, repeated=True):
    """Documents over several micro-batches; a seventh of them comes twice."""
    docs = table(spark, sf_dir, "documents")
    p = paper_columns(jobs.landed_stream(docs, 3, docs.where("doc_id % 7 = 0") if repeated else None))
    return with_authors(spark, sf_dir, p) if authors else p


def hashed(p):
    h = keys.content_hash(*[F.col(c) for c in ("doi", "semantic_scholar_id", "pubmed_id", "arxiv_id", "title", "authors")])
    return p.select("paper_id", "doi", h.alias("content_hash"), F.col("paper_id").alias("ord"), "created_at")


HASH_SQL = """
h AS (SELECT p.paper_id, doi, sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN semantic_scholar_id IS NOT NULL THEN 's2:' || semantic_scholar_id WHEN pubmed_id IS NOT NULL THEN 'pmid:' || pubmed_id
   WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id ELSE 'title:' || lower(title) || '|author:' || coalesce(lower(authors[1]), '') END) AS c FROM papers p JOIN paper_authors USING (paper_id)),
store AS (SELECT * FROM h JOIN labels ON doc_id = paper_id)"""


@register("t1_stream_ingest", sql(PAPERS_SQL, AUTHORS_SQL, HASH_SQL, body=
    "SELECT DISTINCT c AS content_hash FROM h WHERE c NOT IN (SELECT c FROM store) AND (doi IS NULL OR doi NOT IN (SELECT doi FROM store WHERE doi IS NOT NULL))"))
def ingest(spark, sf_dir):
    path = jobs.scratch_path(spark, "ingest")
    held = hashed(papers(spark, sf_dir, authors=True)).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi")
    jobs.ingest(hashed(stream_papers(spark, sf_dir, True)), path, held, "5 days")
    return jobs.read_out(spark, path).select("content_hash")


@register("t2_stream_alerts", sql(*SCORED_CTES, body="SELECT interest_id, paper_id, round(total_score, 6) AS total_score FROM scored WHERE total_score >= 0.4e0"))
def alerts(spark, sf_dir):
    path = jobs.scratch_path(spark, "alerts")
    jobs.run_to(jobs.stream_alerts(stream_papers(spark, sf_dir, True), INTERESTS, AS_OF, 0.4, ScoringConfig(), lookback="5 days"), path)
    return jobs.read_out(spark, path).select("interest_id", "paper_id", F.round("total_score", 6).alias("total_score"))


@register("t3_stream_timeline", sql(PAPERS_SQL, TEXT_SQL, body="""
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, term, count(*) AS n FROM (SELECT created_at, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks JOIN papers USING (paper_id)) GROUP BY ALL"""))
def timeline(spark, sf_dir):
    path = jobs.scratch_path(spark, "timeline")
    jobs.run_timeline(stream_papers(spark, sf_dir, repeated=False), path)
    out = jobs.timeline(jobs.read_out(spark, path))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "term", "n")


@register("t3_stream_timeline_sliding", sql(PAPERS_SQL, TEXT_SQL, body="""
SELECT strftime(d - to_days(CAST(b AS INTEGER)), '%Y-%m-%d') AS day, term, count(*) AS n
FROM (SELECT date_trunc('day', created_at) AS d, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks JOIN papers USING (paper_id)), unnest(range(3)) AS u(b) GROUP BY ALL"""))
def sliding(spark, sf_dir):
    path = jobs.scratch_path(spark, "sliding")
    jobs.run_timeline(stream_papers(spark, sf_dir, repeated=False), path, size="3 days", slide="1 day")
    out = jobs.timeline(jobs.read_out(spark, path), "3 days", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "term", "n")


LOG_SQL = """
log AS (SELECT user_id AS item_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'rating' WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'priority' ELSE 'note' END AS kind,
  CASE WHEN event_type = 'signup' THEN ['to_read', 'reading', 'finished'][CAST(event_id % 3 + 1 AS INTEGER)] ELSE props END AS value, ts, event_id AS seq FROM events
  UNION ALL SELECT user_id, ['untag', 'tag', 'tag', 'tag', 'highlight', 'skip_reason'][CAST(event_id % 6 + 1 AS INTEGER)],
    CASE WHEN event_id % 6 < 4 THEN 't' || (event_id // 6 % 5) WHEN event_id % 7 > 0 THEN props ELSE '' END, ts, event_id FROM events WHERE event_type = 'view'),
tagged AS (SELECT item_id, coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE kind = 'tag'), '') AS tags
  FROM (SELECT item_id, value, arg_max(kind, (ts, seq)) AS kind FROM log WHERE kind IN ('tag', 'untag') GROUP BY item_id, value) GROUP BY item_id)"""
STATE_BODY = """
SELECT item_id, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'status') AS status, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'rating') AS rating, arg_max(value, (ts, seq)) FILTER (WHERE kind = 'priority') AS priority,
  arg_max(value, (ts, seq)) FILTER (WHERE kind = 'read') AS read, strftime(max(ts) FILTER (WHERE kind = 'status' AND value = 'finished'), '%Y-%m-%d %H:%M:%S') AS finished_at, count(*) FILTER (WHERE kind = 'note') AS n_notes,
  count(*) FILTER (WHERE kind = 'highlight') AS n_highlights, coalesce(any_value(tags), '') AS tags FROM log LEFT JOIN tagged USING (item_id) GROUP BY item_id"""


def log(events):
    k = F.col("event_type")
    kind = F.when(k == "view", "read").when(k == "click", "rating").when(k == "signup", "status").when(k == "purchase", "priority").otherwise("note")
    value = F.when(k == "signup", F.element_at(F.array(F.lit("to_read"), F.lit("reading"), F.lit("finished")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.col("props"))
    # a view also tags, untags, highlights or gives a reason to skip
    n = F.col("event_id")
    other = F.element_at(F.array(*[F.lit(x) for x in ("untag", "tag", "tag", "tag", "highlight", "skip_reason")]), (n % 6 + 1).cast("int"))
    said = F.when(n % 6 < 4, F.concat(F.lit("t"), (F.floor(n / 6) % 5).cast("string"))).when(n % 7 > 0, F.col("props")).otherwise("")
    rows = F.array(F.struct(kind.alias("kind"), value.alias("value")), F.when(k == "view", F.struct(other.alias("kind"), said.alias("value"))))
    return events.select(F.col("user_id").alias("item_id"), F.explode(F.array_compact(rows)).alias("e"), F.col("ts").cast("timestamp").alias("ts"), n.alias("seq")).select(
        "item_id", "e.kind", "e.value", "ts", "seq")


def shown(s):
    return s.select("item_id", "status", "rating", "priority", "read", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "n_notes", "n_highlights", F.array_join("tags", ",").alias("tags"))


@register("t4_item_state", sql(LOG_SQL, body=STATE_BODY))
def state(spark, sf_dir):
    return shown(jobs.item_state(log(table(spark, sf_dir, "events"))))


@register("t4_stream_item_state", sql(LOG_SQL, body=STATE_BODY))
def stream_state(spark, sf_dir):
    path = jobs.scratch_path(spark, "state")
    jobs.run_to(jobs.item_parts(log(jobs.landed_stream(table(spark, sf_dir, "events"), 4))), path, "update")
    return shown(jobs.folded(jobs.latest_state(jobs.read_out(spark, path), "item_id", "tag")))


@register("x34_item_annotations", sql(LOG_SQL, body="""
SELECT item_id, kind, CASE kind WHEN 'note' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || value WHEN 'skip_reason' THEN 'Skipped: ' || value ELSE value END AS text, seq
FROM log WHERE kind IN ('note', 'highlight') OR (kind = 'skip_reason' AND value <> '')"""))
def annotations(spark, sf_dir):
    return jobs.annotations(log(table(spark, sf_dir, "events"))).select("item_id", "kind", "text", "seq")


@register("t5_stream_sent_once", sql(body="SELECT DISTINCT user_id, event_type FROM events").replace("WITH \n", ""))
def sent_once(spark, sf_dir):
    path = jobs.scratch_path(spark, "sent")
    e = jobs.landed_stream(table(spark, sf_dir, "events"), 4, table(spark, sf_dir, "events").where("event_id % 5 = 0")).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("sent_at"))
    jobs.run_to(jobs.sent_once(e, ["user_id", "event_type"]), path)
    return jobs.read_out(spark, path).select("user_id", "event_type")
