"""Citation graph: degrees, PageRank, bounded BFS, influential and bridge papers, research fronts.

A graph is ``edges(src, dst)`` (src cites dst) and ``nodes(paper_id, year, citation_count)``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.operators import ranking
from litflow.operators.independent_set import greedy_representatives
from litflow.session import cut_lineage, discard, stored

HOT_TOKEN_ROWS = 5_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct references and citing papers of every node."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("paper_id")).agg(F.count("*").alias("out_degree"))
    inn = e.groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("in_degree"))
    return nodes.join(inn, "paper_id", "left").join(out, "paper_id", "left").na.fill(0, ["in_degree", "out_degree"])


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100,
    tolerance: float = 1e-6, distinct: bool = True,
) -> DataFrame:
    """``(paper_id, pagerank)``. Rank of nodes without references is not redistributed.

    A round is one join on the source and one map-side combined sum on the target; it ends after ``iterations`` rounds
    or with the first in which no rank moves by ``tolerance`` or more. Links stay partitioned by source on the
    executors, only ranks move; ranks are checkpointed every round. ``distinct=False`` lets repeated edges count
    repeatedly.
    """
    ids = nodes.select("paper_id").distinct()
    n = ids.count()
    if n == 0:
        return ids.withColumn("pagerank", F.lit(0.0))
    e = edges.select("src", "dst")
    e = e.distinct() if distinct else e
    out = e.groupBy("src").agg(F.count("*").alias("_out"))
    links = cut_lineage(e.join(out, "src").join(ids.withColumnRenamed("paper_id", "src"), "src", "left_semi"))
    links = links.repartition("src").persist(StorageLevel.DISK_ONLY)
    ranks = cut_lineage(ids.withColumn("pagerank", F.lit(1.0 / n)))
    for _ in range(iterations):
        flow = links.join(ranks, F.col("src") == F.col("paper_id")).groupBy("dst").agg(
            F.sum(F.col("pagerank") / F.col("_out")).alias("_in")
        )
        new = ranks.join(flow, F.col("paper_id") == F.col("dst"), "left").select(
            "paper_id", (F.lit((1 - damping) / n) + damping * F.coalesce("_in", F.lit(0.0))).alias("pagerank"),
            F.col("pagerank").alias("_old"),
        )
        new = cut_lineage(new)
        gap = new.agg(F.max(F.abs(F.col("pagerank") - F.col("_old")))).first()[0]
        ranks = new.drop("_old")
        if gap is not None and gap < tolerance:
            break
    links.unpersist()
    return ranks


def influential(metrics: DataFrame, method: str = "pagerank", limit: int = 10) -> DataFrame:
    """The top papers by ``pagerank``, ``citations`` or ``in_degree``."""
    column = {"pagerank": "pagerank", "citations": "citation_count", "in_degree": "in_degree"}.get(method)
    if column is None:
        raise ValueError(f"unknown ranking method: {method}")
    s = metrics.withColumn("score", F.col(column).cast("double"))
    return s.orderBy(F.col("score").desc(), "paper_id").limit(limit)


def bridges(nodes: DataFrame, edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """Papers by connectivity times (1 + spread of neighbour years / 10)."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("paper_id"), F.col("dst").alias("other")).unionByName(
        e.select(F.col("dst").alias("paper_id"), F.col("src").alias("other"))
    )
    year = nodes.select(F.col("paper_id").alias("other"), F.when(F.col("year") != 0, F.col("year")).alias("y"))
    spread = both.join(year, "other", "left").groupBy("paper_id").agg(
        F.count("*").alias("connectivity"), (F.max("y") - F.min("y")).alias("year_range")
    )
    s = nodes.join(spread, "paper_id", "left").withColumn(
        "bridge_score", F.coalesce(F.col("connectivity") * (1 + F.col("year_range") / 10), F.lit(0.0))
    )
    return s if limit is None else s.orderBy(F.col("bridge_score").desc(), "paper_id").limit(limit)


def neighbours(edges: DataFrame, paper_id, kind: str, limit: int | None = None) -> DataFrame:
    """References of a paper, or the papers that cite it."""
    own, other = ("src", "dst") if kind == "references" else ("dst", "src")
    rows = edges.where(F.col(own) == paper_id).select(F.col(other).alias("paper_id")).distinct()
    return rows if limit is None else rows.orderBy("paper_id").limit(limit)


def build_network(
    edges: DataFrame, seed, depth: int = 2, max_nodes: int = 100,
    include_references: bool = True, include_citations: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first network around a seed: ``nodes(paper_id, level, seq)`` and ``edges(src, dst)``.

    Papers are expanded in the order they were found; a paper's references come before its citations,
    each by id. Nodes and edges stop being added once ``max_nodes`` are held. Held nodes, frontier and
    links are tables: a level joins the edges with the frontier, leaves out what is held, and numbers
    what is new by ranges, so any ``max_nodes`` will do. The driver sees counts and the last place taken.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst")
    kinds = []
    if include_references:
        kinds.append(e.select(F.col("src").alias("own"), F.col("dst").alias("other"), F.lit(0).alias("kind")))
    if include_citations:
        kinds.append(e.select(F.col("dst").alias("own"), F.col("src").alias("other"), F.lit(1).alias("kind")))
    key = e.schema["src"].dataType
    # one written table for each level: a union of them is what is held so far
    held = spark.range(1).select(F.lit(seed).cast(key).alias("paper_id"), F.lit(0).alias("level"), F.lit(0).alias("seq"))
    links, n = e.where(F.lit(False)), 1
    if not kinds:
        return held, links
    steps = reduce(DataFrame.unionByName, kinds)
    for level in range(depth):
        room = max_nodes - n
        if room <= 0:
            break
        frontier = held.where(F.col("level") == level).select(F.col("paper_id").alias("own"), F.col("seq").alias("p"))
        found = stored(steps.join(frontier, "own").distinct().select("own", "other", "kind", F.struct("p", "kind", "other").alias("at")))
        first = found.join(held, found["other"] == held["paper_id"], "left_anti").groupBy("other").agg(F.min("at").alias("at"))
        new = stored(ranking.number_rows(first, ["at"], "seq", first=n).where(F.col("seq") < max_nodes))
        added = new.count()
        held = held.unionByName(new.select(
            F.col("other").alias("paper_id"), F.lit(level + 1).alias("level"), F.col("seq").cast("int").alias("seq")))
        inside = found.join(held, found["other"] == held["paper_id"], "left_semi")
        if added == room:
            last = new.agg(F.max("at").alias("at")).first()["at"]
            stop = F.struct(F.lit(last["p"]).alias("p"), F.lit(last["kind"]).alias("kind"), F.lit(last["other"]).alias("other"))
            inside = inside.where(F.col("at") <= stop)
        cites = F.col("kind") == 0
        links = links.unionByName(stored(inside.select(
            F.when(cites, F.col("own")).otherwise(F.col("other")).alias("src"),
            F.when(cites, F.col("other")).otherwise(F.col("own")).alias("dst"))))
        discard(found)
        n += added
        if added == 0:
            break
    return held, links.distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame, max_nodes: int = 100) -> DataFrame:
    """Totals, and the deepest level that was worked on: a network cut off at ``max_nodes`` was still on the level before."""
    e = edges.select(F.count("*")).scalar()
    deepest = F.when(F.count("*") >= max_nodes, F.greatest(F.max("level") - 1, F.lit(0))).otherwise(F.max("level"))
    return nodes.agg(F.count("*").alias("total_nodes"), deepest.alias("depth_reached")).withColumn("total_edges", e)


def recent_nodes(nodes: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    return nodes.where(F.coalesce("year", F.lit(0)) >= F.year(as_of) - years)


# ---------------------------------------------------------------- reference-set similarity


def reference_sets(refs: DataFrame) -> DataFrame:
    """``(paper_id, set_id, size)``: papers with equal reference sets share a set id.

    The id is built from sums of element hashes, so no reference list is gathered.
    """
    h = F.xxhash64("dst").cast("decimal(20,0)")
    h2 = F.xxhash64(F.lit(7), "dst").cast("decimal(20,0)")
    return refs.groupBy(F.col("src").alias("paper_id")).agg(
        F.count("*").alias("size"), F.sum(h).alias("_a"), F.sum(h2).alias("_b")
    ).select("paper_id", F.concat_ws("/", "size", "_a", "_b").alias("set_id"), "size")


def similar_sets(refs: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Exact Jaccard join of reference sets: ``pairs(set_a, set_b, jaccard)`` and set membership.

    Equal sets collapse to one row with its references, rare ones first, and a bitmap of 128 bits. Two sets that reach
    the threshold share a reference within their prefixes, at positions that still allow enough overlap, and their
    bitmaps differ in no more bits than the sets may in references; only pairs that pass all of these leave the join.
    They are verified on the two reference arrays. A reference held by very many prefixes is split into salted parts.
    """
    refs = refs.select("src", "dst").distinct()
    member = cut_lineage(reference_sets(refs))
    reps = member.groupBy("set_id", "size").agg(F.min("paper_id").alias("src"))
    tokens = refs.join(reps, "src").select("set_id", "size", "dst").withColumn("_slot", F.pmod(F.xxhash64(F.lit(3), "dst"), F.lit(128)).cast("int"))
    freq = tokens.groupBy("dst").agg(F.count("*").alias("_df"))
    sets = cut_lineage(
        tokens.join(freq, "dst").groupBy("set_id", "size").agg(
            F.array_sort(F.collect_list(F.struct("_df", F.xxhash64("dst").alias("_h"), "dst"))).alias("tokens"),
            F.bit_or(F.when(F.col("_slot") < 64, F.expr("shiftleft(1L, _slot)")).otherwise(0)).alias("low"),
            F.bit_or(F.when(F.col("_slot") >= 64, F.expr("shiftleft(1L, _slot - 64)")).otherwise(0)).alias("high"),
        )
    )
    prefix = (F.col("size") - F.ceil(F.col("size") * threshold) + 1).cast("int")
    # sets whose sizes differ by more than the threshold allows are never in neighbouring bands of size
    band = F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).cast("int")
    idx = sets.select("set_id", "size", "low", "high", band.alias("band"), F.posexplode(F.slice("tokens", 1, prefix)).alias("pos", "token"))
    idx = idx.select("set_id", "size", "low", "high", "band", (F.col("pos") + 1).alias("pos"), "token.dst")
    salts = idx.groupBy("dst").agg(F.ceil(F.count("*") / HOT_TOKEN_ROWS).cast("int").alias("k"))
    left = idx.join(salts, "dst").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int")).drop("k")
    right = idx.join(salts, "dst").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    right = right.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    a, b = left.alias("a"), right.alias("b")
    alpha = F.ceil((F.col("a.size") + F.col("b.size")) * (threshold / (1 + threshold)) - 1e-9)
    reachable = 1 + F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos")) >= alpha
    sizes = (F.col("a.size") >= F.col("b.size") * threshold) & (F.col("b.size") >= F.col("a.size") * threshold)
    apart = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    overlap = F.col("a.size") + F.col("b.size") - apart >= 2 * alpha
    cand = (
        a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.band") == F.col("b.band"))
               & (F.col("a.set_id") < F.col("b.set_id")) & sizes & reachable & overlap)
        .select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b")).distinct()
    )
    of = lambda end: sets.select(F.col("set_id").alias(f"set_{end}"), F.col("tokens.dst").alias(f"refs_{end}"))
    both = F.size(F.array_intersect("refs_a", "refs_b"))
    j = both / (F.size("refs_a") + F.size("refs_b") - both)
    met = cand.join(of("a"), "set_a").join(of("b"), "set_b")
    return met.select("set_a", "set_b", j.alias("jaccard")).where(F.col("jaccard") >= threshold), member


def coupled_papers(refs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Similar papers as rows ``(paper_a, paper_b, jaccard)``, each standing for its reference set."""
    pairs, member = similar_sets(refs, threshold)
    rep = member.groupBy("set_id").agg(F.min("paper_id").alias("p"))
    ra = rep.select(F.col("set_id").alias("set_a"), F.col("p").alias("_a"))
    rb = rep.select(F.col("set_id").alias("set_b"), F.col("p").alias("_b"))
    return pairs.join(ra, "set_a").join(rb, "set_b").select(
        F.least("_a", "_b").alias("paper_a"), F.greatest("_a", "_b").alias("paper_b"), "jaccard"
    )


def research_fronts(
    nodes: DataFrame, edges: DataFrame, as_of: Column, min_size: int = 3, threshold: float = 0.3
) -> DataFrame:
    """``(front, paper_id)`` with ``size``, ``mean_citations`` and rank by mean citations.

    Recent papers are taken in id order; each joins the first earlier leader it overlaps with, or
    leads itself. Decided on distinct reference sets: equal sets have equal neighbours.
    """
    recent = recent_nodes(nodes, as_of)
    refs = edges.join(recent.select(F.col("paper_id").alias("src")), "src", "left_semi")
    pairs, member = similar_sets(refs, threshold)
    pairs = cut_lineage(pairs)
    ords = member.groupBy("set_id").agg(F.min("paper_id").alias("ord"))
    pair_groups = pairs.select(
        F.concat_ws("~", "set_a", "set_b").alias("grp"), F.explode(F.array("set_a", "set_b")).alias("set_id")
    )
    groups = member.select("set_id", F.col("set_id").alias("grp")).distinct().unionByName(pair_groups.select("set_id", "grp"))
    picked = cut_lineage(greedy_representatives(groups.join(ords, "set_id").select(F.col("set_id").alias("node"), "ord", "grp")))
    lead = picked.where("is_leader").select(F.col("node").alias("leader"), F.col("ord").alias("front"))
    near = pairs.select(F.col("set_a").alias("node"), F.col("set_b").alias("leader")).unionByName(
        pairs.select(F.col("set_b").alias("node"), F.col("set_a").alias("leader"))
    )
    follow = picked.where("not is_leader").select("node").join(near, "node").join(lead, "leader").groupBy("node").agg(
        F.min("front").alias("front")
    )
    place = follow.unionByName(lead.select(F.col("leader").alias("node"), "front"))
    rows = member.join(place, F.col("set_id") == F.col("node")).join(
        nodes.select("paper_id", "citation_count"), "paper_id"
    )
    size = rows.groupBy("front").agg(
        F.count("*").alias("size"), F.avg("citation_count").alias("mean_citations")
    ).where(F.col("size") >= min_size)
    ranked = ranking.number_rows(size, [F.col("mean_citations").desc(), F.col("front")], "rank", first=1).withColumn("rank", F.col("rank").cast("int"))
    return rows.select("front", "paper_id").join(ranked, "front")


def node_table(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Node export with degrees and PageRank."""
    return degrees(nodes, edges).join(ranks, "paper_id", "left")
