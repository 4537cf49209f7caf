"""Topic clustering: k-means, k sweep, LDA, hybrid; keywords, coherence, silhouette, exports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.functions import text as tx
from litflow.functions.vectors import unit
from litflow.operators.similarity import matrix, tile_pairs
from litflow.session import cut_lineage

MAX_CLUSTERS = 20
MIN_SIZE = 3
POINTS_PER_TILE = 2_000
# Points of a tile at most where points meet points, and distances worked on at once.
MOST_PER_TILE, AT_ONCE = 20_000, 1 << 22
# Cells that stand for all points when k is chosen.
CELLS = 256


def default_k(n: int, most: int = MAX_CLUSTERS) -> int:
    return max(2, min(most, int(math.sqrt(n / 2))))


def _drop_small(assigned: DataFrame, min_size: int) -> DataFrame:
    """``cluster_id`` becomes NULL in clusters below the minimum size; cluster counts are few rows."""
    size = assigned.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size)
    return assigned.join(F.broadcast(size), F.col("label") == F.col("_l"), "left").withColumn(
        "cluster_id", F.when(F.col("_n").isNotNull(), F.col("label"))).drop("_l", "_n", "label")


def cluster_embeddings(
    vectors: DataFrame, k: int | None = None, min_size: int = MIN_SIZE, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """K-means: ``assignments(paper_id, cluster_id)`` and ``centroids(cluster_id, centroid)``."""
    v = vectors.select("paper_id", array_to_vector("embedding").alias("features"))
    k = default_k(v.count()) if k is None else k
    model = KMeans(k=k, seed=seed, maxIter=100, tol=1e-6, initMode="k-means||").fit(v)
    labelled = model.transform(v).select("paper_id", F.col("prediction").alias("label"))
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    return _drop_small(labelled, min_size), centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def _weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int, tries: int = 8, rounds: int = 100) -> np.ndarray:
    """Centroids of weighted points: the best of some starts drawn by squared distance. Equal points may leave fewer than k."""
    order = np.lexsort(x.T[::-1])  # the same rows in any order give the same centroids
    x, w = x[order], w[order]
    best, least = x[:1], np.inf
    for t in range(tries):
        rng = np.random.default_rng([seed, k, t])
        c, gap = x[rng.choice(len(x), p=w / w.sum())][None], np.full(len(x), np.inf)
        for _ in range(k - 1):
            gap = np.minimum(gap, ((x - c[-1]) ** 2).sum(1))
            far = w * gap
            if far.sum() <= 0:
                break
            c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            own = _nearest(x, c)
            new = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else c[i] for i in range(len(c))])
            moved, c = float(((new - c) ** 2).sum(1).max()), new
            if moved <= 1e-12:
                break
        cost = float((w * ((x - c[_nearest(x, c)]) ** 2).sum(1)).sum())
        if cost < least:
            best, least = c, cost
    return best


def _silhouettes(x: np.ndarray, own: np.ndarray, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Silhouette of points by squared distances: the mean one to a cluster is |x|^2 - 2 x.mean + mean |y|^2."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ mean.T + spread[None, :], 0.0)
    at = np.arange(len(x))
    a = d[at, own] * n[own] / np.maximum(n[own] - 1, 1)
    d[:, n == 0] = np.inf
    d[at, own] = np.inf
    b = d.min(1) if d.shape[1] > 1 else np.full(len(x), np.inf)
    top = np.maximum(a, b)
    alone = (n[own] < 2) | ~np.isfinite(b) | (top <= 0)
    return np.where(alone, 0.0, (b - a) / np.where(alone, 1.0, top))


def k_sweep(
    vectors: DataFrame, max_k: int = MAX_CLUSTERS, min_size: int = MIN_SIZE, seed: int = 42, cells: int = CELLS
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(k, silhouette)`` by squared distances for every candidate k, and the centroids of each.

    The table is read by one fit of ``cells`` small cells (fewer if there are fewer points), whose weighted means stand
    for it in the fits of all k, and by two passes for all k together: sizes and sums of the clusters, then the
    silhouette of every point, which is assigned to its nearest centroid; one alone in its cluster counts
    as 0. Sums leave a task as a row per cluster. An empty table, or one too small for two clusters of ``min_size``, has no
    candidates.
    """
    spark = vectors.sparkSession
    v = cut_lineage(vectors.select(F.col("embedding").cast("array<double>").alias("x")))
    n = v.count()
    ks = list(range(2, min(max_k + 1, n // min_size + 1)))
    schema = "k int, silhouette double"
    if not ks:
        return spark.createDataFrame([], schema), {}
    points = v.select(array_to_vector("x").alias("features"))
    cell = KMeans(k=min(cells, n), seed=seed, maxIter=10, initMode="random").fit(points).transform(points)
    means = cell.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("features"), F.count("*").cast("double").alias("weight"))
    # each k is fitted in a task of its own, on one row for each cell
    tasks = means.select(vector_to_array("features").alias("x"), "weight", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))

    def fit(cells_of: pd.DataFrame) -> pd.DataFrame:
        k = int(cells_of["k"].iloc[0])
        found = _weighted_kmeans(matrix(cells_of["x"]), cells_of["weight"].to_numpy(float), k, seed)
        return pd.DataFrame({"k": k, "centres": [list(found.ravel())], "n": len(found)})

    fits = tasks.groupBy("k").applyInPandas(fit, "k int, centres array<double>, n int").collect()  # a row for each k
    centres = {r["k"]: np.array(r["centres"]).reshape(r["n"], -1) for r in sorted(fits, key=lambda r: r["k"])}

    def sums(batches):
        held: dict = {}
        for b in batches:
            x = matrix(b["x"])
            for k, c in centres.items():
                own = _nearest(x, c)
                for i in np.unique(own):
                    mine = x[own == i]
                    m, s, q = held.get((k, i), (0, 0.0, 0.0))
                    held[k, i] = m + len(mine), s + mine.sum(0), q + float((mine**2).sum())
        if held:
            yield pd.DataFrame([(k, int(i), m, s, q) for (k, i), (m, s, q) in held.items()], columns=["k", "c", "n", "s", "q"])

    parts = v.mapInPandas(sums, "k int, c int, n long, s array<double>, q double")
    whole = parts.groupBy("k", "c").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("s")))).alias("s"), F.sum("q").alias("q"))
    facts = {k: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for k, c in centres.items()}
    for r in whole.collect():  # a row for each cluster of each k
        size, mean, spread = facts[r["k"]]
        size[r["c"]], mean[r["c"]], spread[r["c"]] = r["n"], np.array(r["s"]) / r["n"], r["q"] / r["n"]

    def scores(batches):
        total = dict.fromkeys(centres, 0.0)
        for b in batches:
            x = matrix(b["x"])
            for k, c in centres.items():
                total[k] += float(_silhouettes(x, _nearest(x, c), *facts[k]).sum())
        yield pd.DataFrame({"k": list(total), "s": list(total.values())})

    done = v.mapInPandas(scores, "k int, s double").groupBy("k").agg((F.sum("s") / n).alias("silhouette"))
    return spark.createDataFrame([tuple(r) for r in done.collect()], schema), centres


def best_k(vectors: DataFrame, max_k: int = MAX_CLUSTERS, min_size: int = MIN_SIZE, seed: int = 42) -> int:
    """The cluster count with the best silhouette, the smallest of equals; 2 if there is no candidate."""
    top = k_sweep(vectors, max_k, min_size, seed)[0].orderBy(F.col("silhouette").desc(), "k").first()
    return 2 if top is None else top["k"]


def cluster_auto_k(vectors: DataFrame, max_k: int = MAX_CLUSTERS, min_size: int = MIN_SIZE, seed: int = 42):
    return cluster_embeddings(vectors, best_k(vectors, max_k, min_size, seed), min_size, seed)


def cluster_keywords(members: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster_id, term, tf, df, score, rank)``: tf * ln(N / df) over terms in two papers or more."""
    toks = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.CLUSTER_STOP, 2)
    terms = members.select("cluster_id", "paper_id", F.explode(toks).alias("term"))
    per = terms.groupBy("cluster_id", "paper_id", "term").agg(F.count("*").alias("c"))
    freq = per.groupBy("cluster_id", "term").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).where("df >= 2")
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    s = freq.join(size, "cluster_id").withColumn("score", F.col("tf") * F.log(F.col("n") / F.col("df")))
    w = W.partitionBy("cluster_id").orderBy(F.round("score", 9).desc(), "term")
    return s.drop("n").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """``(cluster_id, keywords)`` from ranked keyword rows; at most ``k`` words each."""
    return keywords.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))


def coherence(vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine per ``cluster_id`` from one vector sum: (|sum u|^2 - sum |u|^2) / (n (n - 1))."""
    u = vectors.select("cluster_id", unit(F.col("embedding")).alias("u")).select(
        "cluster_id", array_to_vector("u").alias("v"), F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x).alias("sq"))
    s = u.groupBy("cluster_id").agg(Summarizer.sum(F.col("v")).alias("s"), F.sum("sq").alias("sq"), F.count("*").alias("n"))
    s = s.withColumn("a", vector_to_array("s"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x * x)
    pairs = F.col("n") * (F.col("n") - 1)
    return s.select(
        "cluster_id", F.col("n").alias("size"),
        F.when(F.col("n") < 2, 1.0).otherwise((total - F.col("sq")) / F.nullif(pairs, F.lit(0))).alias("coherence"))


def _distance_sums(pts: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """Summed distances of each point to the members of each cluster in one tile."""
    names = ["paper_id", "cluster_id", "other", "total", "n"]
    if pts.empty or other.empty:
        return pd.DataFrame(columns=names)
    p, c = matrix(pts["embedding"]), matrix(other["r_embedding"])
    ids, lab, r_ids = pts["paper_id"].to_numpy(), other["r_cluster_id"].to_numpy(), other["r_paper_id"].to_numpy()
    own = pts["cluster_id"].to_numpy()
    labels, step = np.unique(lab), max(1, AT_ONCE // len(c))
    members, length = [np.flatnonzero(lab == x) for x in labels], (c**2).sum(1)[None, :]
    total = np.empty((len(labels), len(p)))
    for lo in range(0, len(p), step):
        part = p[lo : lo + step]
        d2 = (part**2).sum(1)[:, None] + length - 2 * part @ c.T
        d2[ids[lo : lo + step, None] == r_ids[None, :]] = 0.0
        d = np.sqrt(np.maximum(d2, 0.0))
        for i, at in enumerate(members):
            total[i, lo : lo + step] = d[:, at].sum(1)
    return pd.concat([
        pd.DataFrame({"paper_id": ids, "cluster_id": own, "other": x, "total": total[i], "n": len(members[i])})
        for i, x in enumerate(labels)
    ])[names]


def silhouette(vectors: DataFrame, tile_rows: int = POINTS_PER_TILE) -> DataFrame:
    """Exact Euclidean silhouette per point, ``(paper_id, cluster_id, silhouette)``.

    Points meet tile by tile in separate tasks and only sums per point and cluster leave a tile. A side has 16 tiles
    until these hold ``MOST_PER_TILE`` points, so up to 320,000 points what is shuffled grows with the points; the
    work is quadratic. For large data use ``silhouette_squared``, which needs no pairs.
    """
    v = vectors.where("cluster_id IS NOT NULL").select(
        "paper_id", F.col("cluster_id").cast("long").alias("cluster_id"), "embedding")
    key = v.schema["paper_id"].dataType.simpleString()
    a, b = tile_pairs(v, v, "paper_id", "paper_id", tile_rows, MOST_PER_TILE)
    sums = a.groupBy("_tl", "_tr").cogroup(b.groupBy("_tl", "_tr")).applyInPandas(
        _distance_sums, f"paper_id {key}, cluster_id long, other long, total double, n long")
    per = sums.groupBy("paper_id", "cluster_id", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    same = F.col("cluster_id") == F.col("other")
    s = per.groupBy("paper_id", "cluster_id").agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("t") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~same, F.col("t") / F.col("n"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    top = F.greatest(a, b)
    return s.select("paper_id", "cluster_id", F.when(top > 0, (b - a) / F.nullif(top, F.lit(0.0))).otherwise(0.0).alias("silhouette"))


def _by_sums(pts: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
    """Mean squared distances of a tile's points: to their own cluster, and the least to another one of these clusters."""
    names = ["paper_id", "cluster_id", "own", "other"]
    if pts.empty or clusters.empty:
        return pd.DataFrame(columns=names)
    x, mean = matrix(pts["embedding"]), matrix(clusters["r_mean"])
    n = clusters["r_n"].to_numpy(float)
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ mean.T + clusters["r_spread"].to_numpy(float)[None, :], 0.0)
    same = pts["cluster_id"].to_numpy()[:, None] == clusters["r_cluster_id"].to_numpy()[None, :]
    own = np.where(same & (n > 1)[None, :], d * (n / np.maximum(n - 1, 1))[None, :], -np.inf).max(1)
    return pd.DataFrame({
        "paper_id": pts["paper_id"].to_numpy(), "cluster_id": pts["cluster_id"].to_numpy(),
        "own": own, "other": np.where(same, np.inf, d).min(1)})[names]


def silhouette_squared(vectors: DataFrame, tile_rows: int = POINTS_PER_TILE) -> DataFrame:
    """Silhouette per point by squared Euclidean distances, ``(paper_id, cluster_id, silhouette)``, without pairs of points.

    A cluster is its size, mean and mean squared length, from which the mean squared distance of any point follows. Tiles
    of points meet tiles of such rows, so the work is points times clusters. Points without a cluster are left out; one
    alone in its cluster, and all points if there is one cluster only, follow ``silhouette``.
    """
    v = vectors.where("cluster_id IS NOT NULL").select(
        "paper_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    key = v.schema["paper_id"].dataType.simpleString()
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    clusters = v.select("cluster_id", array_to_vector("embedding").alias("f"), length.alias("sq")).groupBy("cluster_id").agg(
        vector_to_array(Summarizer.mean(F.col("f"))).alias("mean"), F.avg("sq").alias("spread"), F.count("*").alias("n"))
    a, b = tile_pairs(v, cut_lineage(clusters), "paper_id", "cluster_id", tile_rows)
    met = a.groupBy("_tl", "_tr").cogroup(b.groupBy("_tl", "_tr")).applyInPandas(
        _by_sums, f"paper_id {key}, cluster_id long, own double, other double")
    s = met.groupBy("paper_id", "cluster_id").agg(F.max("own").alias("own"), F.min("other").alias("other"))
    a = F.when(F.col("own") >= 0, F.col("own")).otherwise(0.0)
    b = F.when(F.col("other") < float("inf"), F.col("other")).otherwise(0.0)
    top = F.greatest(a, b)
    return s.select("paper_id", "cluster_id", F.when(top > 0, (b - a) / F.nullif(top, F.lit(0.0))).otherwise(0.0).alias("silhouette"))


def lda_topics(
    papers: DataFrame, k: int = 10, iterations: int = 50, min_size: int = MIN_SIZE, seed: int = 42, vocab: int = 2**31 - 1
) -> tuple[DataFrame, DataFrame]:
    """LDA: ``assignments(paper_id, cluster_id)`` by dominant topic and
    ``topics(cluster_id, keywords, share)``; share is the topic's mean weight.

    Every iteration reads every paper, and every word belongs to the vocabulary unless ``vocab`` bounds it.
    """
    toks = tx.tokens(tx.joined_text(F.col("title"), F.col("abstract")), tx.TOPIC_STOP, 2)
    docs = papers.select("paper_id", toks.alias("toks"))
    cv = CountVectorizer(inputCol="toks", outputCol="features", vocabSize=vocab).fit(docs)
    feats = cut_lineage(cv.transform(docs).select("paper_id", "features"))
    model = LDA(
        k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0, docConcentration=[0.1] * k, topicConcentration=0.01).fit(feats)
    dist = cut_lineage(model.transform(feats).select("paper_id", vector_to_array("topicDistribution").alias("d")))
    label = (F.array_position("d", F.array_max("d")) - 1).cast("int")
    assigned = _drop_small(dist.select("paper_id", label.alias("label")), min_size)
    share = dist.select(F.posexplode("d").alias("cluster_id", "w")).groupBy("cluster_id").agg(F.avg("w").alias("share"))
    words = cv.vocabulary
    spark = papers.sparkSession
    # k topics of ten words each: a bounded driver-side table
    top = spark.createDataFrame(
        [(r["topic"], [words[i] for i in r["termIndices"]]) for r in model.describeTopics(10).collect()],
        "cluster_id int, keywords array<string>")
    return assigned, top.join(F.broadcast(share), "cluster_id")


def match_topics(clusters: DataFrame, topics: DataFrame) -> DataFrame:
    """``(cluster_id, topic_id, overlap)``: the topic that shares most papers with each cluster."""
    a = clusters.where("cluster_id IS NOT NULL").select("paper_id", "cluster_id")
    b = topics.where("cluster_id IS NOT NULL").select("paper_id", F.col("cluster_id").alias("topic_id"))
    n = a.join(b, "paper_id").groupBy("cluster_id", "topic_id").agg(F.count("*").alias("overlap"))
    w = W.partitionBy("cluster_id").orderBy(F.col("overlap").desc(), "topic_id")
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merged_keywords(first: Column, second: Column) -> Column:
    """Five and five keywords, distinct, ten at most."""
    some = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.slice(F.coalesce(first, some), 1, 5), F.slice(F.coalesce(second, some), 1, 5))), 1, 10)


def cluster_ref(prefix: str, label: Column, keywords: Column) -> Column:
    """Stable id from the cluster number and its first three keywords."""
    shown = F.concat(F.lit("['"), F.array_join(F.slice(keywords, 1, 3), "', '"), F.lit("']"))
    return F.concat(F.lit(f"{prefix}_"), label.cast("string"), F.lit("_"), F.substring(F.md5(shown), 1, 8))


def cluster_hybrid(papers: DataFrame, vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Embedding clusters described by their own and the best topic's keywords."""
    assigned, _ = cluster_embeddings(vectors, k, seed=seed)
    members = cut_lineage(papers.join(assigned.where("cluster_id IS NOT NULL"), "paper_id"))
    own = keyword_lists(cluster_keywords(members))
    n = members.select("cluster_id").distinct().count()
    topic_of, topic = lda_topics(members.drop("cluster_id"), n or 5, seed=seed)
    best = match_topics(members, topic_of).join(
        topic.select(F.col("cluster_id").alias("topic_id"), F.col("keywords").alias("topic_keywords")), "topic_id", "left")
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    out = size.join(own, "cluster_id", "left").join(best, "cluster_id", "left")
    kw = merged_keywords(F.col("keywords"), F.col("topic_keywords"))
    return out.select("cluster_id", "size", "topic_id", "overlap", kw.alias("keywords")).withColumn(
        "label", tx.keyword_label(F.col("keywords")))


def assign_to_clusters(papers: DataFrame, clusters: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(paper_id, cluster_id, share)``: the cluster with the largest share of its keywords among a
    paper's words, first cluster on ties; ``clusters(cluster_id, cluster_ord, keywords)``."""
    kw = clusters.select(
        "cluster_id", "cluster_ord", F.size("keywords").alias("n"), F.explode("keywords").alias("k")).withColumn("w", F.lower("k"))
    words = papers.select("paper_id", F.explode(F.array_distinct(
        F.split(tx.strip(tx.joined_text(F.col("title"), F.col("abstract"))), r"(?U)\s+"))).alias("w"))
    hits = words.join(kw, "w").groupBy("paper_id", "cluster_id", "cluster_ord", "n").agg(F.count("*").alias("h"))
    share = hits.withColumn("share", F.col("h") / F.col("n")).where(F.col("share") >= threshold)
    best = share.groupBy("paper_id").agg(F.min(F.struct(-F.col("share"), F.col("cluster_ord"), F.col("cluster_id"))).alias("b"))
    return best.select("paper_id", F.col("b.cluster_id").alias("cluster_id"), (-F.col("b.col1")).alias("share"))


def export_rows(assigned: DataFrame, papers: DataFrame, labels: DataFrame) -> DataFrame:
    """Flat cluster export for ``write.csv`` (quoted properly) or ``write.json``."""
    return (
        assigned.where("cluster_id IS NOT NULL").join(labels, "cluster_id")
        .join(papers.select("paper_id", "paper_key", "title"), "paper_id")
        .select("cluster_id", F.col("label").alias("cluster_label"), F.col("paper_key").alias("paper_id"), F.substring("title", 1, 100).alias("paper_title")))


def export_graph(assigned: DataFrame, papers: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and link tables: clusters and papers, and which paper is in which cluster."""
    flat = assigned.where("cluster_id IS NOT NULL").join(papers.select("paper_id", "paper_key", "title"), "paper_id")
    size = flat.groupBy("cluster_id").agg(F.count("*").alias("size"))
    top = labels.join(size, "cluster_id").select(
        F.col("cluster_id").cast("string").alias("id"), "label", F.lit("cluster").alias("type"), "size")
    low = flat.select(
        F.col("paper_key").alias("id"), F.substring("title", 1, 50).alias("label"), F.lit("paper").alias("type"), F.lit(None).cast("bigint").alias("size"))
    return top.unionByName(low), flat.select(F.col("cluster_id").cast("string").alias("source"), F.col("paper_key").alias("target"))
