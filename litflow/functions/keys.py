"""Identity keys of a paper record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litflow.functions.text import blank_to_null, strip


def _tagged(tag: str, c: Column) -> Column:
    return F.concat(F.lit(f"{tag}:"), blank_to_null(c))


def content_hash(
    doi: Column, s2: Column, pmid: Column, arxiv: Column, title: Column, authors: Column
) -> Column:
    """SHA-256 over the strongest identifier, else over title and first author."""
    first_author = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    by_title = F.concat(F.lit("title:"), F.lower(title), F.lit("|author:"), F.lower(first_author))
    content = F.coalesce(
        _tagged("doi", doi), _tagged("s2", s2), _tagged("pmid", pmid), _tagged("arxiv", arxiv), by_title
    )
    return F.sha2(content, 256)


def paper_key(
    scheme: str, doi: Column, arxiv: Column, title: Column, s2: Column | None = None
) -> Column:
    """Paper key under one of the schemes ``topic``, ``similar``, ``feedback``, ``history``, ``list``.

    The schemes differ in the title fallback, so keys of different schemes must not be compared.
    """
    folded = strip(F.lower(title))
    by_id = [_tagged("doi", doi), _tagged("arxiv", arxiv)]
    if scheme == "topic":
        tail = F.concat(F.lit("title:"), F.substring(F.md5(title), 1, 12))
    elif scheme in ("feedback", "similar"):
        tail = F.concat(F.lit("title:"), F.substring(F.md5(folded), 1, 16))
    elif scheme == "history":
        tail = F.concat(F.lit("title:"), F.substring(folded, 1, 100))
    elif scheme == "list":
        return F.coalesce(blank_to_null(doi), blank_to_null(arxiv), title)
    else:
        raise ValueError(f"unknown key scheme: {scheme}")
    if scheme == "similar":
        if s2 is None:
            raise ValueError("scheme 'similar' needs the s2 column")
        by_id = [_tagged("s2", s2), *by_id]
    return F.coalesce(*by_id, tail)
