"""Similar papers by embedding, citations, authors, or all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.session import stored

# Vectors of a block; a pair of blocks of 768 doubles takes 12 MB.
BLOCK_ROWS = 1_000
# Tiles of a side that may grow, until they are full.
TILES = 16
# Tasks over which the queries that share a reference are dealt, if they are more than so many.
SALTS, SHARED = 8, 20_000
# Citing papers of each reference from which a query's bound is taken.
FIRST = 4
# Base scores of the citation and author methods.
DIRECT = (0.8, 1.0)
COUPLED = (0.6, 0.7)
AUTHOR = (0.7, 1.0)
DEFAULT_WEIGHTS = {"embedding": 0.5, "citation": 0.3, "author": 0.2}
METHODS = ("embedding", "citation", "author", "combined")


def _best(df: DataFrame, k: int, *order) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def _best_pairs(ids: np.ndarray, q: np.ndarray, cand: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """For every query the ``k`` best candidates of one block, equal similarities (nine digits) by id."""
    if c.shape[1] != q.shape[1]:
        raise ValueError("vector dimensions must match")
    sim = q @ c.T
    sim[ids[:, None] == cand[None, :]] = -np.inf
    sim[np.isnan(sim)] = -np.inf
    near = np.round(sim, 9)
    least = np.partition(near, len(cand) - k, axis=1)[:, len(cand) - k, None] if len(cand) > k else -np.inf
    at, to = np.nonzero((near >= least) & np.isfinite(sim))
    # equal similarities may be more than k; only what is left is sorted
    place = np.empty(len(cand), dtype=np.int64)
    place[np.argsort(cand, kind="stable")] = np.arange(len(cand))
    order = np.lexsort((place[to], -near[at, to], at))
    at, to = at[order], to[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    at, to = at[first], to[first]
    return pd.DataFrame({"query_id": ids[at], "paper_id": cand[to], "similarity": sim[at, to]})


def _first_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query, equal similarities (nine digits) by id."""
    order = found.assign(_s=-found["similarity"].round(9)).sort_values(["query_id", "_s", "paper_id"], kind="stable")
    return order.groupby("query_id", sort=False, dropna=False).head(k).drop(columns="_s")


def tile_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into hash tiles of about ``rows`` rows, each placed with every tile of the other
    side under the key (``_tl``, ``_tr``): a group is one pair of tiles, whatever the table size.
    With ``most`` tiles grow up to so many rows before a side has more than ``TILES`` of them: a row is copied once for
    each tile of the other side, so the copies grow with the rows as long as the number of tiles stays.
    Right-hand columns are prefixed with ``r_``, since both sides may be the same table."""

    def tiles(side: DataFrame) -> Column:
        n = F.count("*")
        size = F.lit(rows) if most is None else F.greatest(F.lit(rows), F.least(F.lit(most), F.ceil(n / TILES)))
        return side.select(F.greatest(F.ceil(n / size), F.lit(1))).scalar()

    nl, nr = tiles(left), tiles(right)
    zero = F.lit(0).cast("long")
    a = left.withColumn("_tl", F.pmod(F.xxhash64(left_key), nl)).withColumn("_tr", F.explode(F.sequence(zero, nr - 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("_tr", F.pmod(F.xxhash64(f"r_{right_key}"), nr)).withColumn("_tl", F.explode(F.sequence(zero, nl - 1)))
    return a, b


def nearest(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine k-NN ``(query_id, paper_id, similarity, rank)``, without the query itself.

    Both sides are packed into blocks of about ``block`` vectors by a hash, one row each, and every query block meets
    every candidate block in a cartesian product: a task holds one pair of blocks and the best ``k`` so far of the query
    block, and the driver holds no vector. What is shuffled is ``k`` rows for each query and each part of the candidates'
    file, not for each pair of blocks. No queries give no rows. The work grows with queries times candidates.
    """
    key = candidates.schema["paper_id"].dataType.simpleString()

    def unit_rows(tile: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(tile[0], pdf["paper_id"], _unit(matrix(pdf["embedding"])))

    def pack(side: DataFrame) -> DataFrame:
        n = side.select(F.greatest(F.ceil(F.count("*") / block), F.lit(1))).scalar()
        tiles = side.select("paper_id", "embedding", F.pmod(F.xxhash64("paper_id"), F.lit(n)).alias("_tile"))
        return stored(tiles.groupBy("_tile").applyInPandas(unit_rows, f"no long, ids array<{key}>, v binary"))

    def pair(q_no: int, q_ids: np.ndarray, q: np.ndarray, c_no: int, c_ids: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        return _best_pairs(q_ids, q, c_ids, c, k)

    return _met(pack(queries), pack(candidates), pair, key, k)


def _packed(no: int, ids: pd.Series, m: np.ndarray) -> pd.DataFrame:
    """A block of vectors as one row."""
    return pd.DataFrame({"no": [no], "ids": [ids.to_numpy()], "v": [m.tobytes()]})


def _met(queries: DataFrame, candidates: DataFrame, pair: Callable[..., pd.DataFrame], key: str, k: int) -> DataFrame:
    """Blocks ``(no, ids, v)`` of both sides in a cartesian product, ranked: ``pair`` gives what a pair of blocks finds."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the pairs of a query block follow each other, so that the best so far are held for one block at a time
        held: list[pd.DataFrame] = []
        no, most = None, 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held and no != row.q_no:
                    yield _first_of(pd.concat(held), k)
                    held = []
                q, c = (np.frombuffer(v).reshape(len(i), -1) for i, v in ((row.q, row.qv), (row.c, row.cv)))
                held.append(pair(row.q_no, np.asarray(row.q), q, row.c_no, np.asarray(row.c), c))
                no, most = row.q_no, 16 * k * len(row.q)
                if sum(map(len, held)) > most:
                    held = [_first_of(pd.concat(held), k)]
        if held:
            yield _first_of(pd.concat(held), k)

    q, c = (side.select(*[F.col(x).alias(y) for x, y in (("no", f"{n}_no"), ("ids", n), ("v", f"{n}v"))]) for side, n in ((queries, "q"), (candidates, "c")))
    hits = q.crossJoin(c).mapInPandas(meet, f"query_id {key}, paper_id {key}, similarity double")
    return _best(hits, k, F.round("similarity", 9).desc(), "paper_id")


def nearest_probed(
    queries: DataFrame, candidates: DataFrame, k: int, lists: int | None = None, probes: int | None = None, list_rows: int = 4_000, seed: int = 1,
    visit_rows: int = 4_000,
) -> DataFrame:
    """Approximate k-NN for whole tables: unit vectors are listed by nearest centroid, a query visits ``probes`` lists.

    Three quarters of the lists (the default) are for vectors without clusters; clustered ones need a few.

    A list of more than ``list_rows`` vectors is split by a hash, and the queries are packed into blocks of about
    ``visit_rows``. Blocks and parts of lists meet in a cartesian product, in which a block's queries that do not visit the
    list are left out: a task holds a part and a block, whatever the number of queries, and a vector is not shuffled once
    for each list it visits. What a visit finds is ranked exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from litflow.functions.vectors import unit

    key = candidates.schema["paper_id"].dataType.simpleString()
    c = candidates.select("paper_id", unit(F.col("embedding")).alias("v"))
    n = c.count()
    lists = lists or max(1, min(4096, int(n**0.5)))
    probes = probes or -(-3 * lists // 4)
    points = c.select("paper_id", "v", array_to_vector("v").alias("features"))
    centres = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(points).clusterCenters()) if n else np.zeros((1, 1))
    half = (centres**2).sum(axis=1) / 2

    def visited(x: np.ndarray, how_many: int) -> np.ndarray:
        return np.argsort(half[None, :] - x @ centres.T, axis=1)[:, :how_many].astype("int32")

    def nearest_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=visited(matrix(pdf["v"]), 1)[:, 0])

    def rows(tile: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(tile[0], pdf["paper_id"], matrix(pdf["v"]))

    packed = f"no long, ids array<{key}>, v binary"
    listed = c.mapInPandas(nearest_list, f"paper_id {key}, v array<double>, list int")
    sizes = listed.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / list_rows), F.lit(1)).cast("int").alias("parts"))
    parts = listed.join(sizes, "list").select(
        F.col("list").cast("long").alias("list"), F.pmod(F.xxhash64("paper_id"), F.col("parts")).alias("part"), "paper_id", "v")
    asking = queries.select("paper_id", unit(F.col("embedding")).alias("v"))
    blocks = asking.select(F.greatest(F.ceil(F.count("*") / visit_rows), F.lit(1))).scalar()
    asking = asking.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "paper_id"), F.lit(blocks)))
    last: dict = {}

    def pair(q_no: int, q_ids: np.ndarray, q: np.ndarray, c_no: int, c_ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        if last.get("no") != q_no:  # which of the block's queries visit which list
            visits = np.zeros((len(q), len(half)), dtype=bool)
            for lo in range(0, len(q), 500):
                near = visited(q[lo : lo + 500], probes)
                visits[np.repeat(np.arange(lo, lo + len(near)), near.shape[1]), near.ravel()] = True
            last.update(no=q_no, visits=visits)
        here = last["visits"][:, c_no]
        found = [_best_pairs(q_ids[here][i : i + 1000], q[here][i : i + 1000], c_ids, x, k) for i in range(0, max(1, here.sum()), 1000)]
        return pd.concat(found)

    return _met(stored(asking.groupBy("block").applyInPandas(rows, packed)), stored(parts.groupBy("list", "part").applyInPandas(rows, packed)), pair, key, k)


def by_citations(queries: DataFrame, edges: DataFrame, k: int, refs: int | None = None, per_ref: int | None = None) -> DataFrame:
    """Papers that cite the query, then papers that cite its references.

    All references and all papers that cite them count, unless ``refs`` (first references of a query) or ``per_ref``
    (first citing papers of a reference) cut them, as a page of an id-ordered citation list. Of a reference's citing
    papers only the ``2k + 1`` smallest take part: the query itself and at most ``k`` that cite it directly
    are left out, so these hold the ``k`` smallest of the others, and the result is exact. For the same reason a query
    needs no more than its ``2k + 1`` smallest coupled papers: the first ``FIRST`` citing papers of each of its references give an
    upper bound for the largest of them, and only papers up to it are paired with the query. A reference that many queries share
    is dealt over ``SALTS`` tasks.
    """
    e = stored(edges.select("src", "dst").distinct())
    ids = queries.select(F.col("paper_id").alias("query_id")).distinct()
    citing = e.select(F.col("dst").alias("query_id"), F.col("src").alias("paper_id")).join(ids, "query_id", "left_semi")
    direct = stored(_best(citing.where("query_id <> paper_id"), k, "paper_id").drop("rank"))
    mine = e.select(F.col("src").alias("query_id"), F.col("dst").alias("ref")).join(ids, "query_id", "left_semi")
    if refs is not None:
        w = W.partitionBy("query_id").orderBy("ref")
        mine = mine.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= refs).drop("_r")
    wr = W.partitionBy("ref").orderBy("paper_id")
    most = 2 * k + 1 if per_ref is None else per_ref
    page = (
        e.select(F.col("dst").alias("ref"), F.col("src").alias("paper_id"))
        .withColumn("_r", F.row_number().over(wr)).where(F.col("_r") <= most).drop("_r")
        .groupBy("ref").agg(F.sort_array(F.collect_list("paper_id")).alias("page"))  # at most that many
    )
    hot = F.broadcast(mine.groupBy("ref").agg(F.count("*").alias("_n")).where(F.col("_n") > SHARED).select("ref", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("query_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    mine = stored(mine.join(hot, "ref", "left").select("query_id", "ref", salt.alias("_s")))
    page = stored(page.join(hot, "ref", "left").select("ref", "page", F.explode(salts).alias("_s")))
    some = mine.join(page.select("ref", "_s", F.slice("page", 1, FIRST).alias("page")), ["ref", "_s"]).select("query_id", F.explode("page").alias("paper_id"))
    at = W.partitionBy("query_id").orderBy("paper_id")
    bound = some.distinct().withColumn("_r", F.row_number().over(at)).where(F.col("_r") == 2 * k + 1).select("query_id", F.col("paper_id").alias("_to"))
    near = mine.join(bound, "query_id", "left").join(page, ["ref", "_s"]).select(
        "query_id", F.explode(F.filter("page", lambda x: F.col("_to").isNull() | (x <= F.col("_to")))).alias("paper_id"))
    coupled = near.where("query_id <> paper_id").distinct().join(direct, ["query_id", "paper_id"], "left_anti")

    def scored(df: DataFrame, s: tuple[float, float], why: str) -> DataFrame:
        return df.select(
            "query_id", "paper_id", F.lit(s[0]).alias("similarity"), F.lit(s[1]).alias("citation_similarity"),
            F.lit(why).alias("reason"),
        )

    both = scored(direct, DIRECT, "Cites this paper").unionByName(scored(coupled, COUPLED, "Cites same references"))
    return _best(both, k, F.col("similarity").desc(), "paper_id")


def by_authors(queries: DataFrame, papers: DataFrame, k: int, first: int = 3) -> DataFrame:
    """Other papers of the query's first authors, newest first.

    A query can show at most ``k`` papers of one author, and at most ``first`` of an author's papers
    are hidden from it, so only an author's newest ``k + 1`` papers take part in the join.
    """
    def names(df: DataFrame, key: str, a) -> DataFrame:
        return df.select(F.col("paper_id").alias(key), "year", F.posexplode(a).alias("pos", "author"))

    mine = names(queries, "query_id", F.slice("authors", 1, first)).drop("year")
    theirs = names(papers, "paper_id", F.array_distinct("authors")).drop("pos")
    newest = F.coalesce("year", F.lit(0)).desc()
    w = W.partitionBy("author").orderBy(newest, "paper_id")
    theirs = theirs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    hits = mine.join(theirs, "author").where("query_id <> paper_id").groupBy("query_id", "paper_id", "year").agg(
        F.min_by("author", "pos").alias("author")
    )
    out = hits.select(
        "query_id", "paper_id", "year", F.lit(AUTHOR[0]).alias("similarity"), F.lit(AUTHOR[1]).alias("author_similarity"),
        F.concat(F.lit("Same author: "), "author").alias("reason"),
    )
    return _best(out, k, newest, "paper_id")


def combine(emb: DataFrame, cit: DataFrame, aut: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum over the three methods, reasons united; at most five result lists meet per pair."""
    wt = {**DEFAULT_WEIGHTS, **(weights or {})}

    def part(df: DataFrame, name: str, value: str, reason) -> DataFrame:
        return df.select("query_id", "paper_id", F.lit(name).alias("m"), F.col(value).alias("v"), reason.alias("reason"))

    rows = part(emb, "embedding", "similarity", F.lit("High semantic similarity")).unionByName(
        part(cit, "citation", "citation_similarity", F.col("reason"))
    ).unionByName(part(aut, "author", "author_similarity", F.col("reason")))
    s = rows.groupBy("query_id", "paper_id").agg(
        *[F.coalesce(F.max(F.when(F.col("m") == m, F.col("v"))), F.lit(0.0)).alias(f"{m}_similarity") for m in DEFAULT_WEIGHTS],
        F.sort_array(F.collect_set("reason")).alias("reasons"),
    )
    total = sum(F.col(f"{m}_similarity") * F.lit(float(wt[m])) for m in DEFAULT_WEIGHTS)
    return _best(s.withColumn("similarity", total), k, F.round("similarity", 9).desc(), "paper_id")


def find_similar(
    queries: DataFrame, papers: DataFrame, edges: DataFrame, method: str = "combined", k: int = 20,
    weights: dict[str, float] | None = None, refs: int | None = None, per_ref: int | None = None,
) -> DataFrame:
    """Similar papers per query by one method or by all; ``refs`` and ``per_ref`` as in ``by_citations``."""
    if method not in METHODS:
        raise ValueError(f"unknown similarity method: {method}")
    if method == "embedding":
        return nearest(queries, papers, k)
    if method == "citation":
        return by_citations(queries, edges, k, refs, per_ref)
    if method == "author":
        return by_authors(queries, papers, k)
    return combine(
        nearest(queries, papers, 2 * k), by_citations(queries, edges, 2 * k, refs, per_ref), by_authors(queries, papers, k), k, weights
    )
