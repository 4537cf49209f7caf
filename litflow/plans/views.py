"""Views that give the driver's tables the shape the operators expect, with the same views in SQL.

Attributes the tables lack are derived by arithmetic on the key (publication date, citations, ids),
identically in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litflow.operators.scoring import Interest

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def papers(spark: SparkSession, sf_dir: str, authors: bool = False) -> DataFrame:
    """``documents`` as papers. Authors cost two joins, so they are added only on request."""
    p = paper_columns(table(spark, sf_dir, "documents"))
    return with_authors(spark, sf_dir, p) if authors else p


def paper_columns(d: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    pub = as_of() - F.make_dt_interval((k % 800).cast("int"))
    return d.select(
        k.alias("paper_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.concat(F.lit("https://papers.example/"), k.cast("string")).alias("url"),
        F.when(k % 3 == 1, F.concat(F.lit("10.1000/"), F.substring(F.md5("text"), 1, 12))).alias("doi"),
        F.when(k % 4 == 1, F.substring(F.md5(F.lower(F.substring_index("text", ".", 1))), 1, 10)).alias("arxiv_id"),
        F.when(k % 5 == 2, F.concat(F.lit("s"), (k % 97).cast("string"))).alias("semantic_scholar_id"),
        F.when(k % 7 == 3, F.concat(F.lit("p"), k.cast("string"))).alias("pubmed_id"),
        F.col("source").alias("journal"),
        F.array("lang").alias("fields_of_study"),
        F.col("lang"),
        F.when(k % 11 != 0, pub).alias("published_date"),
        F.when(k % 22 != 0, F.year(pub)).alias("year"),
        F.when(k % 10 != 0, (k * 7919 % 251).cast("int")).alias("citation_count"),
        F.when(k % 10 != 0, F.floor((k * 7919 % 251) / 10).cast("int")).alias("influential_citation_count"),
        F.element_at(
            F.array(F.lit("rss"), F.lit("semantic_scholar"), F.lit("pubmed"), F.lit("arxiv")),
            (k % 4 + 1).cast("int"),
        ).alias("source_type"),
        F.col("source").alias("source_feed_id"),
        (as_of() - F.make_dt_interval(F.lit(0), (k % 96).cast("int"))).alias("created_at"),
    )


def with_authors(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    cus = table(spark, sf_dir, "customer")
    n_sup = sup.select(F.count("*")).scalar()
    n_cus = cus.select(F.count("*")).scalar()
    first = sup.select(F.col("s_suppkey").alias("_s"), F.col("s_name").alias("_a1"))
    second = cus.select(
        F.col("c_custkey").alias("_c"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("_a2")
    )
    return (
        p.withColumn("_s", k_mod(n_sup)).withColumn("_c", k_mod(n_cus))
        .join(first, "_s", "left").join(second, "_c", "left")
        .withColumn(
            "authors",
            F.when(F.col("paper_id") % 9 == 0, F.array().cast("array<string>"))
            .otherwise(F.array("_a1", "_a2")),
        )
        .drop("_s", "_c", "_a1", "_a2")
    )


def k_mod(n: Column) -> Column:
    return F.col("paper_id") % n


PAPERS_SQL = """
papers AS (
  SELECT doc_id AS paper_id, split_part(text, '.', 1) AS title, text AS abstract,
    'https://papers.example/' || doc_id AS url,
    CASE WHEN doc_id % 3 = 1 THEN '10.1000/' || substr(md5(text), 1, 12) END AS doi,
    CASE WHEN doc_id % 4 = 1 THEN substr(md5(lower(split_part(text, '.', 1))), 1, 10) END AS arxiv_id,
    CASE WHEN doc_id % 5 = 2 THEN 's' || (doc_id % 97) END AS semantic_scholar_id,
    CASE WHEN doc_id % 7 = 3 THEN 'p' || doc_id END AS pubmed_id,
    source AS journal, lang,
    CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 800 AS INTEGER)) END AS published_date,
    CASE WHEN doc_id % 22 <> 0 THEN CAST(year(TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 800 AS INTEGER))) AS INTEGER) END AS year,
    CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id * 7919 % 251 AS INTEGER) END AS citation_count,
    CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id * 7919 % 251 // 10 AS INTEGER) END AS influential_citation_count,
    ['rss', 'semantic_scholar', 'pubmed', 'arxiv'][CAST(doc_id % 4 + 1 AS INTEGER)] AS source_type,
    TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 96 AS INTEGER)) AS created_at,
    doc_id AS k
  FROM documents
)"""

AUTHORS_SQL = """
paper_authors AS (
  SELECT d.doc_id AS paper_id,
    CASE WHEN d.doc_id % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE [s.s_name, c.c_mktsegment || ' ' || c.c_name] END AS authors
  FROM documents d
  LEFT JOIN supplier s ON s.s_suppkey = d.doc_id % (SELECT count(*) FROM supplier)
  LEFT JOIN customer c ON c.c_custkey = d.doc_id % (SELECT count(*) FROM customer)
)"""

INTERESTS = (
    Interest(
        "i1", "Tidal Models", ord=0, description="tion ther thth models",
        keywords=("tion", "ther", "thth", "rewh"), excluded_keywords=("nicht",),
        followed_authors=("Supplier#000000001", "H. Customer#000000013", "Customer#000000021, A."),
        followed_journals=("src1",), fields_of_study=("en",),
    ),
    Interest(
        "i2", "Clefs", ord=1, description=None, keywords=("pour", "dans", "avec"),
        excluded_keywords=("ment", "tion"), followed_authors=(), followed_journals=(),
        fields_of_study=("fr", "es"),
    ),
    Interest(
        "i3", "Mixed Signals", ord=2, description="sich para that", keywords=("sich", "para", "of the", "that"),
        excluded_keywords=("from",), followed_authors=("Supplier#000000003",),
        followed_journals=("src12", "src7"), fields_of_study=("de", "es", "en"),
        weights={"keyword": 0.25, "semantic": 0.20}, threshold_immediate=0.55, threshold_weekly=0.45,
    ),
)


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def phrase_sql(text: str, phrase: str) -> str:
    """Whole-word test on ``text``, Unicode aware."""
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){phrase}($|[^\\p{{L}}\\p{{N}}_])')"
