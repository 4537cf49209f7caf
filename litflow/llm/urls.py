"""URL filters: rules by host and path; redirects and canonical links pass decisions on to aliases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import cut_lineage
from litflow.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or none: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule whose host is this one or above it and whose path begins this one; else null.

    Rules are a parameter and travel in the expression, by host; of two equally long ones the first by text wins.
    """
    kind = "struct<size:int,rule:string,verdict:string>"
    by_host: dict[str, list[UrlRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast(kind)
    entry = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    table = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(r) for r in rs]))])
    labels = F.split(host, r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = F.flatten(F.transform(above, lambda h: F.coalesce(table[h], F.array().cast("array<struct<path:string,rule:string,verdict:string>>"))))
    fits = F.filter(met, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_min(ranked).cast(kind)


def node_of(url: Column) -> Column:
    """Two urls that differ in scheme, fragment or default port only are one node (128 bits); null, and one without ``://``, has none."""
    rest = F.regexp_replace(_after_scheme(url), r"(?s)#.*$", "")
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    return F.when(F.contains(url, F.lit("://")), F.unhex(F.md5(F.concat(host, path_of(url), F.lit("?"), query))))


# A tag, its kind, and what it names: the first group that took part.
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b.*(?<![\w-])rel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"
REFRESH = r"(?is)^<meta\b.*(?<![\w-])http-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)(?<![\w-])href\s*=\s*(?:\"\s*([^\"]*?)\s*\"|'\s*([^']*?)\s*'|([^\"'\s>]+))"
GOES_TO = r"(?is)[;,\"'\s]url\s*=\s*(?:'\s*([^'>]*?)\s*'|\"\s*([^\">]*?)\s*\"|([^\"'\s>]+))"


def _named_by(tag: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x)),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolve(target: Column, page: Column) -> Column:
    """A link's target as a whole url, relative ones taken on ``page``; null if it names no other page.

    ``//host/x`` takes the page's scheme, ``/x`` its host, ``?x`` its path, and anything else its folder; ``.`` and
    ``..`` are resolved. Empty targets, mere fragments, schemes without ``://`` (mailto) and relative targets on a page
    that has none are null.
    """
    scheme = F.substring_index(page, "://", 1)
    authority = F.regexp_extract(_after_scheme(page), r"^[^/?#]*", 0)
    whole = F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    folder = F.regexp_extract(path_of(page), r"(?s)^.*/", 0)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    split = r"(?s)^([^?#]*)(.*)$"
    on_host = F.concat(scheme, F.lit("://"), authority, _without_dots(F.regexp_extract(path, split, 1)), F.regexp_extract(path, split, 2))
    return (
        F.when((target == "") | F.startswith(target, F.lit("#")), F.lit(None))
        .when(whole, F.when(F.contains(target, F.lit("://")), target))
        .when(~F.contains(page, F.lit("://")), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("?")), F.concat(scheme, F.lit("://"), authority, path_of(page), target))
        .otherwise(on_host)
    )


def links_in(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): every canonical link and every meta refresh named in a page outside comments, targets as whole urls.

    ``rel`` may list several words; ``&amp;`` stands for ``&``. Null pages and null urls have no links; repeated tags
    and repeated rows give repeated links; other columns play no part.
    """
    maybe = pages.select(F.col(url).alias("src"), F.col(html).alias("said")).where(F.col("said").rlike(r"(?i)canonical|http-equiv") & F.col("src").isNotNull())
    tags = F.regexp_extract_all(F.regexp_replace("said", r"(?s)<!--.*?-->", " "), F.lit(TAG), F.lit(0))
    tag = F.col("tag")
    target = F.when(tag.rlike(CANONICAL), _named_by(tag, HREF)).when(tag.rlike(REFRESH), _named_by(tag, GOES_TO))
    named = maybe.select("src", F.explode(tags).alias("tag")).select("src", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target"))
    return named.select("src", resolve(F.col("target"), F.col("src")).alias("dst")).where("dst IS NOT NULL")


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html",
    default: str = "allow",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    A fitting rule decides. Any other url takes the decision of its component under redirect and canonical links
    (``redirects``: src, dst): allow if a rule allows any alias, else block if a rule blocks one, else ``default``.
    Targets count as aliases also if no page of theirs is there. Null urls, and those without ``://``, have empty host
    and path and no aliases. Repeated rows are judged alike; output names replace columns.
    """
    outputs = ("host", "path", "rule", "verdict")
    kept = pages.drop(*[c for c in pages.columns if c.lower() in outputs])
    links = redirects.select("src", "dst") if redirects is not None else None
    if html is not None and html in pages.columns:
        found = links_in(pages, url, html)
        links = found if links is None else links.unionByName(found)
    rest = F.struct(*[F.col(c) for c in kept.columns]).alias("row")
    judged = _decided(kept.select(rest, F.col(url).alias("of")), rules)
    nodes = judged.select("node", "decision")
    if links is not None:
        links = cut_lineage(links.distinct())
        ends = links.select(F.explode(F.array("src", "dst")).alias("of"))
        nodes = nodes.unionByName(_decided(ends, rules).select("node", "decision"))
    known = nodes.where("node IS NOT NULL AND decision IS NOT NULL").groupBy("node").agg(F.max(F.col("decision") == "allow").alias("allowed"))
    if links is not None:
        parts = cut_lineage(connected_components(links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))))
        known = known.withColumnRenamed("node", "at")
        labelled = known.join(parts, F.col("at") == F.col("node"), "left").select(F.coalesce("component", "at").alias("component"), "allowed")
        by_part = labelled.groupBy("component").agg(F.max("allowed").alias("allowed"))
        # decisions reach every node of a component, and nodes without links are their own
        linked = parts.join(by_part, "component").select("node", "allowed")
        alone = by_part.join(parts.select(F.col("node").alias("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), "allowed")
        known = linked.unionByName(alone)
    known = known.select(F.col("node").alias("of_node"), "allowed")
    passed = F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block").otherwise(default)
    return (
        judged.join(known, F.col("node") == F.col("of_node"), "left")
        .select("row.*", "host", "path", "rule", F.coalesce("decision", passed).alias("verdict"))
    )


def _decided(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """Rows with ``of`` (a url) with host, path, rule, decision and node."""
    seen = urls.withColumns({"host": host_of(F.col("of")), "path": path_of(F.col("of")), "node": node_of(F.col("of"))})
    ruled = seen.withColumn("best", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.withColumns({"rule": F.col("best.rule"), "decision": F.col("best.verdict")}).drop("best")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
