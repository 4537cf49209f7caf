"""Queries for landed payloads, feeds, filters, users and jobs. Payloads are composed from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litflow.functions import keys
from litflow.functions import text as tx
from litflow.operators import selection
from litflow.plans.registry import register
from litflow.plans.views import AUTHORS_SQL, ORDERS_AS_OF, PAPERS_SQL, as_of, papers, sql, table
from litflow.sources import feeds, records

WS = "' \t\n\r' || chr(11) || chr(12)"


def esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name.split(' ')[0]}>"))


def xml(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _k() -> Column:
    return F.col("paper_id")


def _ks() -> Column:
    return _k().cast("string")


def rss_payloads(spark, sf_dir):
    p = papers(spark, sf_dir, authors=True)
    d = F.concat(F.lit("10.1000/"), _ks())
    body = xml(
        tag("title", esc(F.col("title"))), tag("link", F.col("url")),
        F.when(_k() % 3 == 2, tag("link", F.concat(F.lit("https://doi.org/"), d))),
        tag("description", esc(F.concat(F.lit("<p>"), "abstract", F.lit("</p>")))),
        F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: tag("dc:creator", esc(a))), "")),
        F.when(_k() % 3 == 0, tag("prism:doi", d)), F.when(_k() % 3 == 1, tag("dc:identifier", F.concat(F.lit("https://doi.org/"), d))),
        F.when(_k() % 2 == 0, tag("prism:publicationName", F.col("journal"))),
        F.when(F.col("published_date").isNotNull(), tag("pubDate", F.concat(F.date_format("published_date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))),
    )
    return p.select("paper_id", F.col("journal").alias("feed_id"), F.concat(F.lit("<item>"), body, F.lit("</item>")).alias("payload"))


RSS_BODY = f"""
SELECT p.paper_id, trim(title, {WS}) AS title, CASE WHEN k % 3 = 2 THEN 'https://doi.org/10.1000/' || k ELSE url END AS url,
  md5(CASE WHEN length(a) > 50 THEN a END) AS abstract_md5, array_to_string(authors, ';') AS authors, '10.1000/' || k AS doi, CASE WHEN k % 2 = 0 THEN journal ELSE 'feed ' || journal END AS journal,
  strftime(published_date, '%Y-%m-%d') AS published FROM (SELECT *, trim(regexp_replace('<p>' || abstract || '</p>', '<[^>]+>', '', 'g'), {WS}) AS a FROM papers) p JOIN paper_authors USING (paper_id)"""


def shown(df):
    return df.select(
        "paper_id", "title", "url", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", ";").alias("authors"),
        "doi", "journal", F.date_format("published_date", "yyyy-MM-dd").alias("published"))


@register("s1_x23_x24_x25_x27_rss_items", sql(PAPERS_SQL, AUTHORS_SQL, body=RSS_BODY))
def rss(spark, sf_dir):
    p = rss_payloads(spark, sf_dir).withColumn("feed_name", F.concat(F.lit("feed "), "feed_id"))
    return shown(records.parse(p, "rss", "payload", keep=("paper_id",), journal="feed_name"))


@register("s2_atom_entries", sql(PAPERS_SQL, AUTHORS_SQL, body=f"""
SELECT p.paper_id, trim(title, {WS}) AS title, url, md5(CASE WHEN length(a) > 50 THEN a END) AS abstract_md5, array_to_string(authors, ';') AS authors, NULL AS doi, NULL AS journal,
  strftime(published_date, '%Y-%m-%d') AS published FROM (SELECT *, trim(regexp_replace(abstract, '<[^>]+>', '', 'g'), {WS}) AS a FROM papers) p JOIN paper_authors USING (paper_id)"""))
def atom(spark, sf_dir):
    p = papers(spark, sf_dir, authors=True)
    body = xml(
        tag("title", esc(F.col("title"))), F.concat(F.lit('<link href="'), F.col("url"), F.lit('"/>')),
        tag("summary", esc(F.col("abstract"))),
        F.array_join(F.transform("authors", lambda a: tag("author", tag("name", esc(a)))), ""),
        F.when(F.col("published_date").isNotNull(), tag("published", F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
    )
    pay = p.select("paper_id", F.concat(F.lit("<entry>"), body, F.lit("</entry>")).alias("payload"))
    return shown(records.parse(pay, "atom", "payload", keep=("paper_id",)))


@register("s3_scholar_json", sql(PAPERS_SQL, AUTHORS_SQL, body="""
SELECT p.paper_id, title, coalesce(CASE WHEN k % 2 = 0 THEN url END, 'https://www.semanticscholar.org/paper/s' || k) AS url, md5(abstract) AS abstract_md5, array_to_string(authors, ';') AS authors, doi, arxiv_id, pubmed_id,
  's' || k AS semantic_scholar_id, journal, strftime(published_date, '%Y-%m-%d') AS published, year, citation_count, influential_citation_count, lang AS fields FROM papers p JOIN paper_authors USING (paper_id)"""))
def scholar(spark, sf_dir):
    p = papers(spark, sf_dir, authors=True)
    ids = F.map_filter(
        F.create_map(F.lit("DOI"), "doi", F.lit("ArXiv"), "arxiv_id", F.lit("PubMed"), "pubmed_id"), lambda k, v: v.isNotNull())
    rec = F.struct(
        F.concat(F.lit("s"), _ks()).alias("paperId"), ids.alias("externalIds"), "title", "abstract",
        F.when(_k() % 2 == 0, F.col("url")).alias("url"), F.col("journal").alias("venue"), "year",
        F.date_format("published_date", "yyyy-MM-dd").alias("publicationDate"), F.col("citation_count").alias("citationCount"),
        F.col("influential_citation_count").alias("influentialCitationCount"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        F.transform("fields_of_study", lambda f: F.struct(f.alias("category"))).alias("s2FieldsOfStudy"),
    )
    out = records.parse(p.select("paper_id", F.to_json(rec).alias("payload")), "scholar", "payload", keep=("paper_id",))
    return out.select(
        "paper_id", "title", "url", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", ";").alias("authors"), "doi",
        "arxiv_id", "pubmed_id", "semantic_scholar_id", "journal", F.date_format("published_date", "yyyy-MM-dd").alias("published"),
        "year", "citation_count", "influential_citation_count", F.array_join("fields_of_study", ",").alias("fields"))


@register("s4_pubmed_articles", sql(PAPERS_SQL, AUTHORS_SQL, body=f"""
SELECT p.paper_id, trim(title, {WS}) || '2' AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || k || '/' AS url, CAST(k AS VARCHAR) AS pubmed_id, md5('BACKGROUND: ' || trim(title, {WS}) || ' On E. coli, ' || trim(abstract, {WS})) AS abstract_md5,
  coalesce(array_to_string(list_transform(authors, lambda a: 'Ann ' || a), ';'), '') AS authors, doi, journal, strftime(CASE WHEN k % 4 = 0 THEN date_trunc('month', published_date) ELSE published_date END, '%Y-%m-%d') AS published, lang AS fields
FROM papers p JOIN paper_authors USING (paper_id)"""))
def pubmed(spark, sf_dir):
    p = papers(spark, sf_dir, authors=True)
    pub = F.col("published_date")
    month = F.when(_k() % 2 == 0, F.date_format(pub, "MMM")).otherwise(F.date_format(pub, "MM"))
    date = F.when(pub.isNotNull(), tag("PubDate", xml(
        tag("Year", F.year(pub).cast("string")), tag("Month", month), F.when(_k() % 4 != 0, tag("Day", F.dayofmonth(pub).cast("string"))))))
    art = tag("Article", xml(
        tag("Journal", xml(tag("JournalIssue", xml(date)), tag("Title", F.col("journal")))), tag("ArticleTitle", F.concat(F.lit("<i>"), esc(F.col("title")), F.lit("</i><sub>2</sub>"))),
        tag("Abstract", xml(tag('AbstractText Label="BACKGROUND"', esc(F.col("title"))), tag("AbstractText", F.concat(F.lit("On <i>E. coli</i>, "), esc(F.col("abstract")))))),
        tag("AuthorList", F.array_join(F.transform("authors", lambda a: tag("Author", F.concat(tag("LastName", a), tag("ForeName", F.lit("Ann"))))), ""))))
    ids = F.when(F.col("doi").isNotNull(), tag("PubmedData", tag("ArticleIdList", F.concat(
        F.lit('<ArticleId IdType="pubmed">1</ArticleId>'), tag('ArticleId IdType="doi"', F.col("doi"))))))
    mesh = tag("MeshHeadingList", F.concat(F.lit('<MeshHeading><DescriptorName UI="D1">'), F.col("lang"), F.lit("</DescriptorName></MeshHeading>")))
    rec = tag("PubmedArticle", xml(tag("MedlineCitation", xml(tag('PMID Version="1"', _ks()), art, mesh)), ids))
    out = records.parse(p.select("paper_id", rec.alias("payload")), "pubmed", "payload", keep=("paper_id",))
    return out.select(
        "paper_id", "title", "url", "pubmed_id", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", ";").alias("authors"),
        "doi", "journal", F.date_format("published_date", "yyyy-MM-dd").alias("published"), F.array_join("fields_of_study", ",").alias("fields"))


@register("s5_arxiv_entries", sql(PAPERS_SQL, AUTHORS_SQL, body=f"""
SELECT p.paper_id, trim(title, {WS}) AS title, '2401.' || k AS arxiv_id, md5(trim(abstract, {WS})) AS abstract_md5, array_to_string(authors, ';') AS authors, doi, strftime(published_date, '%Y-%m-%d') AS published,
  CAST(year(published_date) AS INTEGER) AS year, CASE WHEN k % 2 = 0 THEN 'Machine Learning' ELSE 'Condensed Matter' END || ',x.' || lang AS fields FROM papers p JOIN paper_authors USING (paper_id)"""))
def arxiv(spark, sf_dir):
    p = papers(spark, sf_dir, authors=True)
    pub = F.col("published_date")
    cat = F.when(_k() % 2 == 0, "cs.LG").otherwise("cond-mat")
    rec = tag("entry", xml(
        tag("id", F.concat(F.lit("http://arxiv.org/abs/2401."), _ks(), F.lit("v2"))), tag("title", esc(F.col("title"))), tag("summary", esc(F.col("abstract"))),
        F.array_join(F.transform("authors", lambda a: tag("author", tag("name", esc(a)))), ""),
        F.when(pub.isNotNull(), tag("published", F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.when(F.col("doi").isNotNull(), tag("arxiv:doi", F.col("doi"))),
        F.concat(F.lit('<category term="'), cat, F.lit('"/><category term="x.'), F.col("lang"), F.lit('"/>'))))
    out = records.parse(p.select("paper_id", rec.alias("payload")), "arxiv", "payload", keep=("paper_id",))
    return out.select(
        "paper_id", "title", "arxiv_id", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", ";").alias("authors"), "doi",
        F.date_format("published_date", "yyyy-MM-dd").alias("published"), "year", F.array_join("fields_of_study", ",").alias("fields"))


@register("s6_papers_in_period", sql(PAPERS_SQL, body="SELECT paper_id FROM papers WHERE created_at BETWEEN TIMESTAMP '2024-01-28' AND TIMESTAMP '2024-01-29 12:00:00'"))
def period(spark, sf_dir):
    ts = lambda s: F.lit(s).cast("timestamp")
    return selection.in_period(papers(spark, sf_dir), ts("2024-01-28"), ts("2024-01-29 12:00:00")).select("paper_id")


@register("s7_papers_since", sql(PAPERS_SQL, body="SELECT paper_id FROM papers WHERE created_at >= TIMESTAMP '2024-01-30 06:00:00'"))
def since(spark, sf_dir):
    return selection.since(papers(spark, sf_dir), F.lit("2024-01-30 06:00:00").cast("timestamp")).select("paper_id")


@register("s15_store_new_papers", sql(PAPERS_SQL, AUTHORS_SQL, """
h AS (SELECT p.paper_id, doi, sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN semantic_scholar_id IS NOT NULL THEN 's2:' || semantic_scholar_id WHEN pubmed_id IS NOT NULL THEN 'pmid:' || pubmed_id
   WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id ELSE 'title:' || lower(title) || '|author:' || coalesce(lower(authors[1]), '') END) AS c FROM papers p JOIN paper_authors USING (paper_id)),
store AS (SELECT * FROM h JOIN labels ON doc_id = paper_id)""", body="""
SELECT min(paper_id) AS paper_id, c AS content_hash FROM h WHERE c NOT IN (SELECT c FROM store) AND (doi IS NULL OR doi NOT IN (SELECT doi FROM store WHERE doi IS NOT NULL)) GROUP BY c"""))
def store_new(spark, sf_dir):
    h = keys.content_hash(*[F.col(c) for c in ("doi", "semantic_scholar_id", "pubmed_id", "arxiv_id", "title", "authors")])
    p = papers(spark, sf_dir, authors=True).select("paper_id", "doi", h.alias("content_hash"), F.col("paper_id").alias("ord"))
    store = p.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi")
    return feeds.new_records(p, store).select("paper_id", "content_hash")


def catalogue(spark, sf_dir):
    """A feed catalogue made from the documents: one feed per source, categories from its languages."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("categories")).select(
        F.col("source").alias("code"), F.col("source").alias("journal_code"), F.upper("source").alias("journal_name"), "categories")


@register("s16_feeds_by_category", sql(body="""
SELECT source AS code, 'ACS - ' || upper(source) AS name, 'https://pubs.acs.org/action/showFeed?type=axatoc&feed=rss&jc=' || source AS url FROM documents
GROUP BY source HAVING bool_or(lang = 'fr') AND source IN ('src1', 'src2', 'src3', 'src12', 'none')""").replace("WITH \n", ""))
def feed_filter(spark, sf_dir):
    c = feeds.by_codes(feeds.by_category(catalogue(spark, sf_dir), "fr"), ["src1", "src2", "src3", "src12", "none"])
    u = feeds.feed_urls(c)
    return c.select("code", F.concat(F.lit("ACS - "), "journal_name").alias("name")).join(u, "name").select("code", "name", "url")


@register("s17_fetch_state", sql("""
s AS (SELECT user_id AS feed_id, max(ts) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1)""", body="""
SELECT feed_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_fetched, strftime(max(ok), '%Y-%m-%d %H:%M:%S') AS last_success, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR ts > ok)) AS consecutive_failures,
  arg_max(CASE WHEN event_type = 'error' AND (ok IS NULL OR ts > ok) THEN props END, ts) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR ts > ok)) AS last_error FROM events JOIN s ON feed_id = user_id GROUP BY feed_id"""))
def fetch_state(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("feed_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    f = "yyyy-MM-dd HH:mm:ss"
    return feeds.fetch_state(log).select(
        "feed_id", F.date_format("last_fetched_at", f).alias("last_fetched"), F.date_format("last_successful_fetch_at", f).alias("last_success"),
        "consecutive_failures", "last_error")


def landed(spark, sf_dir):
    cut = F.when(_k() % 100 == 13, F.expr("substring(payload, 1, length(payload) - 9)")).otherwise(F.col("payload"))
    pay = rss_payloads(spark, sf_dir).select("feed_id", cut.alias("payload"))
    return records.parse(pay, "rss", "payload", keep=("feed_id",)).select("feed_id", "is_valid")


@register("s18_feed_validity", sql(body="""
SELECT source AS feed_id, count(*) FILTER (WHERE doc_id % 100 <> 13) AS n_entries, NOT bool_or(doc_id % 100 = 13) AS is_valid, CASE WHEN bool_or(doc_id % 100 = 13) THEN 'Feed parsing error' END AS error FROM documents GROUP BY source""").replace("WITH \n", ""))
def validity(spark, sf_dir):
    known = catalogue(spark, sf_dir).select(F.col("code").alias("feed_id"))
    return feeds.validity(known, landed(spark, sf_dir))


@register("s19_collection_summary", sql(body="""
SELECT source AS feed_id, count(*) FILTER (WHERE doc_id % 100 <> 13) AS n_papers, CASE WHEN bool_or(doc_id % 100 = 13) THEN 'Feed parsing error' ELSE 'OK' END AS status FROM documents GROUP BY source""").replace("WITH \n", ""))
def summary(spark, sf_dir):
    known = catalogue(spark, sf_dir).select(F.col("code").alias("feed_id"))
    return feeds.collection_summary(known, landed(spark, sf_dir))


@register("x24_page_text", sql(body="""
SELECT page_id, md5(CASE WHEN length(t) > 50 THEN t END) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' \t\n\r') AS t FROM pages)""").replace("WITH \n", ""))
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.usable_abstract(F.col("html"))).alias("text_md5"))


@register("x27_page_links", sql(body="""
SELECT page_id, coalesce(list_filter(l, lambda h: contains(h, 'doi.org'))[1], url) AS url FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""").replace("WITH \n", ""))
def page_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", tx.preferred_url(F.col("url"), links).alias("url"))


DATED_SQL = """
d AS (SELECT paper_id, coalesce(published_date, TIMESTAMP '2020-02-03') AS p, paper_id % 6 AS f FROM papers)"""


@register("x26_parse_dates", sql(PAPERS_SQL, DATED_SQL, body="""
SELECT paper_id, strftime(CASE f WHEN 1 THEN date_trunc('month', p) WHEN 2 THEN date_trunc('year', p) WHEN 5 THEN TIMESTAMP '2024-01-01' ELSE p END, '%Y-%m-%d') AS d, f = 5 AS defaulted FROM d"""))
def parse_dates(spark, sf_dir):
    p = papers(spark, sf_dir).select("paper_id", F.coalesce("published_date", F.lit("2020-02-03").cast("timestamp")).alias("p"))
    fmt = F.when(_k() % 6 == 1, F.date_format("p", "yyyy-MM")).when(_k() % 6 == 2, F.date_format("p", "yyyy")).when(
        _k() % 6 == 3, F.date_format("p", "yyyy/MM/dd")).when(_k() % 6 == 4, F.date_format("p", "yyyy-MM-dd'T'HH:mm")).when(_k() % 6 == 5, F.lit("soon")).otherwise(F.date_format("p", "yyyy-MM-dd"))
    date, missing = tx.parse_trend_date(fmt, as_of())
    return p.select("paper_id", F.date_format(date, "yyyy-MM-dd").alias("d"), missing.alias("defaulted"))


# ---------------------------------------------------------------- filters and users


@register("f1_recent_or_undated", sql(PAPERS_SQL, body="SELECT paper_id FROM papers WHERE published_date IS NULL OR published_date >= TIMESTAMP '2024-01-31' - to_days(90)"))
def recent(spark, sf_dir):
    return selection.recent_or_undated(papers(spark, sf_dir), as_of(), 90).select("paper_id")


@register("f2_source_query", sql(PAPERS_SQL, body=r"""
SELECT paper_id FROM papers WHERE regexp_matches(lower(title || ' ' || abstract), '(^|[^\p{L}\p{N}_])with($|[^\p{L}\p{N}_])') AND year BETWEEN 2022 AND 2024 AND lang IN ('en', 'de') AND (published_date IS NULL OR published_date >= TIMESTAMP '2024-01-31' - to_days(600))"""))
def source_query(spark, sf_dir):
    return selection.source_query(papers(spark, sf_dir), "with", 2022, 2024, ["en", "de"], 600, as_of()).select("paper_id")


ZONES = ("UTC", "America/New_York", "Asia/Tokyo", "Europe/Berlin")
USERS_SQL = """
users AS (SELECT c_custkey AS user_id, c_acctbal > 0 AS digest_enabled, c_acctbal > 5000 AS immediate_alerts_enabled, ['weekly', 'daily', 'monthly'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS digest_frequency,
   CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 31 ELSE c_custkey % 7 END AS digest_day, c_custkey % 24 AS digest_hour, [0, -5, 9, 1][CAST(c_nationkey % 4 + 1 AS INTEGER)] AS off FROM customer),
local AS (SELECT *, TIMESTAMP '2024-01-31 19:00:00' + to_hours(CAST(off AS INTEGER)) AS t FROM users)"""


def users(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("digest_enabled"),
        (F.col("c_acctbal") > 5000).alias("immediate_alerts_enabled"),
        F.element_at(F.array(F.lit("weekly"), F.lit("daily"), F.lit("monthly")), (k % 3 + 1).cast("int")).alias("digest_frequency"),
        F.when(k % 3 == 2, k % 31).otherwise(k % 7).alias("digest_day"), (k % 24).alias("digest_hour"),
        F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("timezone"))


@register("f6_eligible_users", sql(USERS_SQL, body="""
SELECT user_id, digest_frequency FROM local WHERE digest_enabled AND digest_hour = hour(t) AND (digest_frequency = 'daily' OR (digest_frequency = 'weekly' AND digest_day = dayofweek(t)) OR (digest_frequency = 'monthly' AND digest_day = day(t)))"""))
def eligible(spark, sf_dir):
    at = F.lit("2024-01-31 19:00:00").cast("timestamp")
    u = users(spark, sf_dir)
    parts = [selection.eligible_users(u, kind, at).select("user_id", "digest_frequency") for kind in ("daily", "weekly", "monthly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("f7_alert_users", sql(USERS_SQL, body="SELECT user_id FROM users WHERE immediate_alerts_enabled"))
def alerts(spark, sf_dir):
    return selection.alert_users(users(spark, sf_dir)).select("user_id")


PROFILES_SQL = """
profiles AS (SELECT o_orderkey AS profile_id, o_custkey AS user_id, o_orderstatus <> 'P' AS is_active, o_orderdate AS created_at FROM orders),
interests AS (SELECT l_orderkey AS profile_id, l_orderkey || '-' || l_partkey || '-' || l_suppkey AS interest_id, regexp_split_to_array(p_name, ' ') AS keywords FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def profiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("profile_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") != "P").alias("is_active"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


def interests(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return li.join(p, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("profile_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("interest_id"), F.split("p_name", " ").alias("keywords"))


@register("f8_active_interests", sql(PROFILES_SQL, body="SELECT profile_id, interest_id FROM interests JOIN profiles USING (profile_id) WHERE is_active"))
def active(spark, sf_dir):
    return selection.active_interests(interests(spark, sf_dir), profiles(spark, sf_dir)).select("profile_id", "interest_id")


@register("f9_derived_queries", sql(PROFILES_SQL, body="SELECT DISTINCT unnest(list_slice(keywords, 1, 3)) AS query FROM interests JOIN profiles USING (profile_id) WHERE is_active"))
def derived(spark, sf_dir):
    return selection.derived_queries(selection.active_interests(interests(spark, sf_dir), profiles(spark, sf_dir)))


@register("j2_user_interests", sql(PROFILES_SQL, body="""
SELECT user_id, profile_id, interest_id FROM (SELECT * FROM profiles QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, profile_id) = 1) JOIN interests USING (profile_id) WHERE user_id IN (SELECT c_custkey FROM customer)"""))
def user_interests(spark, sf_dir):
    u = users(spark, sf_dir).select("user_id")
    return selection.user_interests(u, profiles(spark, sf_dir), interests(spark, sf_dir)).select("user_id", "profile_id", "interest_id")


@register("f10_missing_embeddings", sql(PAPERS_SQL, body="SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT vec_id FROM embeddings)"))
def missing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")
    return selection.missing_embeddings(papers(spark, sf_dir), e).select("paper_id")


@register("f10_stale_interests", sql(body="SELECT o_orderkey AS interest_id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderdate < TIMESTAMP '2001-08-01' - to_days(7)").replace("WITH \n", ""))
def stale(spark, sf_dir):
    k = F.col("o_orderkey")
    i = table(spark, sf_dir, "orders").select(k.alias("interest_id"), F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("embedding_updated_at"))
    return selection.stale_interests(i, F.lit(ORDERS_AS_OF).cast("timestamp")).select("interest_id")


JOBS_SQL = """
jobs AS (SELECT event_id AS job_id, event_type AS job_type, ts AS started_at, value, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'done' END AS status, k, user_id, ts
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events))"""


def jobs(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k).withColumn("started_at", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), "started_at",
        (F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round("value", 2).cast("decimal(18,6)"))).alias("completed_at"),
        F.when(F.col("k") % 5 == 0, "failed").otherwise("done").alias("status"), F.col("k").alias("items_processed"),
        F.floor(F.col("k") / 3).alias("items_created"), "user_id")


@register("f15_job_history", sql(JOBS_SQL, body="SELECT job_id, job_type, status FROM jobs WHERE job_type = 'click' ORDER BY started_at DESC, job_id LIMIT 20"))
def history(spark, sf_dir):
    return selection.job_history(jobs(spark, sf_dir), "click", 20).select("job_id", "job_type", "status")


@register("a25_job_stats", sql(JOBS_SQL, body="""
SELECT job_type, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(round(value, 2)), 4) AS avg_duration, round(max(round(value, 2)), 4) AS max_duration,
  CAST(sum(k) AS BIGINT) AS items_processed, CAST(sum(k // 3) AS BIGINT) AS items_created FROM jobs GROUP BY job_type"""))
def job_stats(spark, sf_dir):
    s = selection.job_stats(jobs(spark, sf_dir))
    return s.withColumn("avg_duration", F.round("avg_duration", 4)).withColumn("max_duration", F.round("max_duration", 4))


@register("a4_campaign_stats", sql(JOBS_SQL, body="""
SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(DISTINCT user_id) AS users_processed, count(*) FILTER (WHERE job_type IN ('view', 'click')) AS emails_sent, count(*) FILTER (WHERE job_type = 'error') AS emails_failed,
  CAST(coalesce(sum(k) FILTER (WHERE job_type IN ('view', 'click')), 0) AS BIGINT) AS papers_included, round(coalesce(count(*) FILTER (WHERE job_type IN ('view', 'click')) / nullif(CAST(count(*) FILTER (WHERE job_type IN ('view', 'click', 'error')) AS DOUBLE), 0), 0), 6) AS success_rate,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_seconds FROM jobs GROUP BY 1"""))
def campaigns(spark, sf_dir):
    j = jobs(spark, sf_dir)
    log = j.select(
        F.date_format("started_at", "yyyy-MM-dd").alias("run_id"), "user_id", F.col("started_at").alias("ts"), F.col("items_processed").alias("n_papers"),
        F.when(F.col("job_type").isin("view", "click"), "sent").when(F.col("job_type") == "error", "failed").otherwise("skipped").alias("status"))
    s = selection.campaign_stats(log)
    return s.withColumn("success_rate", F.round("success_rate", 6)).withColumn("duration_seconds", F.round("duration_seconds", 3))
