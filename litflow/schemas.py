"""Declared schemas of the tables the operators exchange."""

from __future__ import annotations

PAPERS = """
paper_id STRING, title STRING, url STRING, abstract STRING, authors ARRAY<STRING>, doi STRING,
arxiv_id STRING, semantic_scholar_id STRING, pubmed_id STRING, journal STRING, venue STRING,
published_date TIMESTAMP, year INT, citation_count INT, influential_citation_count INT,
fields_of_study ARRAY<STRING>, source_type STRING, source_feed_id STRING
"""

LIST_ITEM = """
item_id STRING, paper_id STRING, title STRING, authors ARRAY<STRING>, abstract STRING, url STRING,
doi STRING, arxiv_id STRING, status STRING, priority STRING, added_at STRING, started_at STRING,
finished_at STRING, notes STRING, tags ARRAY<STRING>,
highlights ARRAY<STRUCT<text: STRING, color: STRING, page: INT, timestamp: STRING>>,
rating INT, position INT, due_date STRING, source STRING, relevance_score DOUBLE
"""

READING_LIST = (
    "list_id STRING, name STRING, description STRING, tags ARRAY<STRING>, is_archived BOOLEAN, "
    "is_default BOOLEAN, items ARRAY<STRUCT<"
    + ", ".join(
        f"{name}: {kind}"
        for name, kind in (
            ("item_id", "STRING"), ("paper_id", "STRING"), ("title", "STRING"),
            ("authors", "ARRAY<STRING>"), ("abstract", "STRING"), ("url", "STRING"),
            ("doi", "STRING"), ("arxiv_id", "STRING"), ("status", "STRING"),
            ("priority", "STRING"), ("added_at", "STRING"), ("notes", "STRING"),
            ("tags", "ARRAY<STRING>"), ("rating", "INT"), ("position", "INT"),
            ("relevance_score", "DOUBLE"),
        )
    )
    + ">>"
)

STATUSES = ("to_read", "reading", "finished", "skipped", "reference")
PRIORITIES = ("urgent", "high", "medium", "low")
