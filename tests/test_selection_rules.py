"""Greedy and iterative operators against plain loops on small random inputs."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from litflow import session
from litflow.operators import digest, graph, linkage, ranking, similarity, topics, trends
from litflow.operators.independent_set import components, greedy_representatives


def test_greedy_representatives_match_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 25
        groups = {i: {f"g{rng.randrange(18)}" for _ in range(rng.randrange(1, 4))} for i in range(n)}
        taken, held = set(), set()
        for i in range(n):
            if not groups[i] & held:
                taken.add(i)
                held |= groups[i]
        rows = [(i, i, g) for i, gs in groups.items() for g in gs]
        got = greedy_representatives(spark.createDataFrame(rows, "node int, ord int, grp string")).collect()
        assert {r["node"] for r in got if r["is_leader"]} == taken
        assert len(got) == n


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[j] == 100 for j in range(100, 130))


def _records(rng, n):
    words = ["deep", "graph", "model", "polymer", "study", "energy", "novel", "sampling", "of", "the"]
    rows = []
    base = []
    for i in range(n):
        if base and rng.random() < 0.5:
            t = list(rng.choice(base))
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
            title = "".join(t).strip() or "x"
        else:
            title = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9)))
        base.append(title)
        authors = [] if rng.random() < 0.3 else [f"A. {rng.choice(['Wang', 'Wang', 'Wang', 'Li'])}"]
        rows.append((i, title, authors, None if i % 4 else f"d{i % 12}", None, None, None))
    return rows


SCHEMA = "ord int, title string, authors array<string>, doi string, arxiv_id string, semantic_scholar_id string, pubmed_id string"


def _norm(t):
    return " ".join(t.lower().strip().strip(".,;:!?\"'").split())


def _same(a, b):
    r = SequenceMatcher(None, _norm(b[1]), _norm(a[1])).ratio()
    if a[2] and b[2]:
        return r >= 0.85 and a[2][0].lower().split()[-1] == b[2][0].lower().split()[-1]
    return r >= 0.95


def test_similar_titles_find_every_pair(spark, monkeypatch):
    rows = _records(random.Random(11), 70)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = {r["ord"]: r["node"] for r in linkage.title_nodes(df).collect()}
    first = {}
    for o in sorted(nodes):
        first.setdefault(nodes[o], o)
    reps = sorted(first.values())
    want = {
        (nodes[a], nodes[b]) for i, a in enumerate(reps) for b in reps[i + 1:] if _same(rows[a], rows[b])
    }
    got = {(r["node_a"], r["node_b"]) for r in linkage.similar_titles(df).collect()}
    assert got == want and want
    # a hot block cut into many tiles gives the same pairs
    original = linkage.tiled_similar
    monkeypatch.setattr(linkage, "tiled_similar", lambda le, ri, t, ordered: original(le, ri, t, ordered, tile_rows=5))
    assert {(r["node_a"], r["node_b"]) for r in linkage.similar_titles(df).collect()} == want


def test_greedy_grouping_matches_first_come_loop(spark):
    rows = _records(random.Random(5), 40)
    leaders, rep = [], {}
    for r in rows:
        by_id = [k for k in leaders if r[3] and r[3] == k[3]]
        by_title = [k for k in leaders if _same(k, r)]
        hit = by_id or by_title
        if hit:
            rep[r[0]] = hit[0][0]
        else:
            leaders.append(r)
            rep[r[0]] = r[0]
    got = {r["ord"]: r["rep"] for r in linkage.group_records(spark.createDataFrame(rows, SCHEMA), "greedy").collect()}
    assert got == rep


def test_ranks_survive_a_value_held_by_most_rows(spark):
    rng = random.Random(1)
    rows = [(f"p{i % 2}", 5.0 if rng.random() < 0.6 else float(rng.randrange(20)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "p string, v double, t int")
    got = {(r["p"], r["t"]): r["rank"] for r in ranking.row_number_desc(df, ["p"], "v", "t", ranges=16).collect()}
    for p in ("p0", "p1"):
        order = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[1], r[2]))
        assert [got[(p, r[2])] for r in order] == list(range(1, len(order) + 1))
    share = {r["t"]: r["share"] for r in ranking.share_at_most(df, "v", ranges=16).collect()}
    values = [r[1] for r in rows]
    for r in rows[::37]:
        assert abs(share[r[2]] - sum(v <= r[1] for v in values) / len(values)) < 1e-12


def test_research_fronts_match_leader_clustering(spark):
    rng = random.Random(9)
    sets = {i: {rng.randrange(6) + 10 * (i % 3) for _ in range(rng.randrange(1, 5))} for i in range(40)}
    used, fronts = set(), {}
    for i in sorted(sets):
        if i in used:
            continue
        used.add(i)
        members = [i]
        for j in sorted(sets):
            if j not in used and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.3:
                members.append(j)
                used.add(j)
        if len(members) >= 3:
            fronts[i] = set(members)
    edges = spark.createDataFrame([(i, 1000 + d) for i, s in sets.items() for d in s], "src int, dst int")
    nodes = spark.createDataFrame([(i, 2024, i) for i in sets], "paper_id int, year int, citation_count int")
    got: dict = {}
    for r in graph.research_fronts(nodes, edges, F.lit("2024-01-31").cast("timestamp")).collect():
        got.setdefault(r["front"], set()).add(r["paper_id"])
    assert got == fronts and fronts


def test_network_matches_queue_traversal(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(150)})
    pairs = [p for p in pairs if p[0] != p[1]]
    cap, depth = 25, 2
    nodes, edges, queue, seen = {0}, set(), [(0, 0)], set()
    while queue and len(nodes) < cap:
        cur, d = queue.pop(0)
        if cur in seen:
            continue
        seen.add(cur)
        if d < depth:
            step = [(o, (cur, o)) for s, o in pairs if s == cur] + [(s, (s, cur)) for s, o in sorted(pairs) if o == cur]
            for other, edge in step:
                if len(nodes) < cap:
                    nodes.add(other)
                    edges.add(edge)
                    if other not in seen:
                        queue.append((other, d + 1))
    n, e = graph.build_network(spark.createDataFrame(pairs, "src long, dst long"), 0, depth, cap)
    assert {r["paper_id"] for r in n.collect()} == nodes
    assert {(r["src"], r["dst"]) for r in e.collect()} == edges


def test_pagerank_matches_power_iteration(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(50)})
    r = np.full(15, 1 / 15)
    out = np.array([sum(1 for s, _ in edges if s == i) for i in range(15)])
    for _ in range(60):
        new = np.full(15, 0.15 / 15)
        for s, d in edges:
            new[d] += 0.85 * r[s] / out[s]
        r = new
    nodes = spark.createDataFrame([(i,) for i in range(15)], "paper_id int")
    got = graph.pagerank(nodes, spark.createDataFrame(edges, "src int, dst int"), iterations=60, tolerance=1e-9).collect()
    assert max(abs(x["pagerank"] - r[x["paper_id"]]) for x in got) < 1e-6


def test_seed_choice_by_passes(spark):
    rng = random.Random(6)
    counts: dict[int, int] = {}
    for _ in range(200):
        m = rng.randrange(256)
        counts[m] = counts.get(m, 0) + 1
    masks = spark.createDataFrame(list(counts.items()), "mask long, n long")
    used, want = 0, []
    for i in range(8):
        if sum(n for m, n in counts.items() if m >> i & 1 and not m & used) >= 12:
            want.append(i)
            used |= 1 << i
    assert trends.accepted_seeds(masks, 8, 12) == want
    assert trends.accepted_seeds(masks, 8, 12, per_pass=3) == want


def test_digest_sections_match_sequential_pick(spark):
    rng = random.Random(8)
    rows = [("u", f"i{k}", k, p, f"Title {p % 30}", round(rng.random(), 2)) for k in range(3) for p in range(60)]
    used, want = set(), []
    for k in range(3):
        n = 0
        for r in sorted((r for r in rows if r[2] == k), key=lambda r: (-r[5], r[3])):
            if r[5] < 0.2 or r[4] in used or n == 7:
                continue
            used.add(r[4])
            n += 1
            want.append((r[1], n, r[3]))
    df = spark.createDataFrame(rows, "user_id string, interest_id string, interest_ord int, paper_id int, title string, total_score double")
    got = [(r["interest_id"], r["position"], r["paper_id"]) for r in digest.digest_items(df, 0.2, 7).collect()]
    assert sorted(got) == sorted(want)


def test_vector_blocks_give_the_same_neighbours_and_silhouette(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    v = spark.createDataFrame(rows, "paper_id long, cluster_id int, embedding array<double>")
    one = {tuple(r)[:2] + (r["rank"],) for r in similarity.nearest(v, v, 4).collect()}
    many = {tuple(r)[:2] + (r["rank"],) for r in similarity.nearest(v, v, 4, block=13).collect()}
    assert one == many and len(one) == 240
    a = {r["paper_id"]: r["silhouette"] for r in topics.silhouette(v).collect()}
    b = {r["paper_id"]: r["silhouette"] for r in topics.silhouette(v, tile_rows=11).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in range(60))
    x = np.array([r[2] for r in rows])
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    lab = np.array([r[1] for r in rows])
    own = d[0][lab == 0].sum() / 19
    other = min(d[0][lab == c].mean() for c in (1, 2))
    assert abs(a[0] - (other - own) / max(own, other)) < 1e-9


def test_silhouette_tiles_grow_before_their_number_does(spark, monkeypatch):
    monkeypatch.setattr(topics, "MOST_PER_TILE", 12)
    monkeypatch.setattr(topics, "AT_ONCE", 50)
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(i % 3, 1, 4)]) for i in range(160)], "paper_id long, cluster_id int, embedding array<double>")
    copies = {}
    for n in (80, 160, 320):
        side = spark.range(n).withColumnRenamed("id", "paper_id")
        copies[n] = [x.count() for x in similarity.tile_pairs(side, side, "paper_id", "paper_id", 2, 1_000)]
    # 16 tiles of growing size: the copies grow with the rows
    assert copies == {n: [16 * n, 16 * n] for n in (80, 160, 320)}
    a = {r["paper_id"]: r["silhouette"] for r in topics.silhouette(v).collect()}
    b = {r["paper_id"]: r["silhouette"] for r in topics.silhouette(v, tile_rows=3).collect()}
    assert len(a) == 160 and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_keyword_timeline_deals_the_rows_of_one_file(spark, tmp_path):
    rows = [(i, f"Word{'abcd'[i % 4]} planet harvest", "winter harvest planet", i % 9) for i in range(60)]
    papers = spark.createDataFrame(rows, "paper_id long, title string, abstract string, age int").withColumn(
        "published_date", F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval("age"))
    papers.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    tasks = session.spread(one).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 4 and sum(r["count"] for r in tasks) == 60
    line = trends.keyword_timeline(one, as_of, 30)
    assert "RoundRobinPartitioning" in line._jdf.queryExecution().executedPlan().toString()
    assert {(r["day"], r["n"]) for r in line.where("term = 'planet harvest'").collect()} == {(d, sum(a == d for *_, a in rows)) for d in range(9)}
    seeds = [("harvest planet", 2.0), ("wordb", 1.0)]
    found = trends.topic_papers(one, seeds, 5)
    assert found.count() == 60 and {r["seed_no"] for r in found.collect()} == {0}
    assert "contains" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_squared_silhouette_needs_no_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 9 if i == 0 else None if i == 1 else i % 4, [float(x) for x in rng.normal(size=5)]) for i in range(70)]
    rows += [(100 + i, 1, rows[5][2]) for i in range(3)]
    v = spark.createDataFrame(rows, "paper_id long, cluster_id int, embedding array<double>")
    held = [r for r in rows if r[1] is not None]
    x, lab = np.array([r[2] for r in held]), np.array([r[1] for r in held])
    d = ((x[:, None] - x[None, :]) ** 2).sum(2)
    want = {}
    for i, r in enumerate(held):
        own = lab == lab[i]
        a = d[i][own].sum() / (own.sum() - 1) if own.sum() > 1 else 0.0
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        want[r[0]] = (b - a) / max(a, b)
    for tile in (2000, 3):
        got = {r["paper_id"]: r["silhouette"] for r in topics.silhouette_squared(v, tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    one = topics.silhouette_squared(v.where("cluster_id = 2")).agg({"silhouette": "max"}).first()[0]
    assert one == topics.silhouette(v.where("cluster_id = 2")).agg({"silhouette": "max"}).first()[0]
    assert topics.silhouette_squared(v.where("paper_id < 0")).count() == 0


def test_sweep_finds_the_number_of_groups(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.2 + c for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0), (0, 0, 5))])
    v = spark.createDataFrame([(i, [float(y) for y in p]) for i, p in enumerate(x)], "paper_id long, embedding array<double>")
    assert topics.best_k(v, max_k=8) == 4
    for cells in (256, 24):  # every point its own cell, or several in one
        sweep, centres = topics.k_sweep(v, max_k=6, cells=cells)
        got = {r["k"]: r["silhouette"] for r in sweep.collect()}
        assert set(got) == {2, 3, 4, 5, 6} == set(centres) and max(got, key=got.get) == 4
        for k, c in centres.items():
            lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            d = ((x[:, None] - x[None, :]) ** 2).sum(2)
            s = []
            for i in range(len(x)):
                own = lab == lab[i]
                if own.sum() < 2:
                    s.append(0.0)
                    continue
                a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][lab == o].mean() for o in set(lab) - {lab[i]})
                s.append((b - a) / max(a, b))
            assert abs(np.mean(s) - got[k]) < 1e-9
    assert topics.k_sweep(v.where("paper_id < 4"))[0].count() == 0 and topics.best_k(v.where("paper_id < 0")) == 2


def test_query_vectors_do_not_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "paper_id long, embedding array<double>")
    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(type(v), name, lambda *a, **b: pytest.fail("vectors on the driver"))
    found = similarity.nearest(v, v, 3, block=9)
    monkeypatch.undo()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {(r["query_id"], r["rank"]): r["paper_id"] for r in found.collect()}
    assert got == {(i, k + 1): j for i in range(70) for k, j in enumerate(np.argsort(-sim[i])[:3].tolist())}
    assert similarity.nearest(v.limit(0), v, 3).count() == 0


def test_visits_of_a_list_meet_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_best_pairs", bounded_pairs(similarity._best_pairs, 60))
    x = np.random.default_rng(5).normal(size=(200, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "paper_id long, embedding array<double>")
    found = similarity.nearest_probed(v, v, 3, lists=2, probes=2, list_rows=40, visit_rows=30)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {(r["query_id"], r["rank"]): r["paper_id"] for r in found.collect()}
    assert got == {(i, k + 1): j for i in range(200) for k, j in enumerate(np.argsort(-sim[i])[:3].tolist())}


def bounded_pairs(real, most):
    def pairs(ids, q, cand, c, k):
        assert len(ids) <= most and len(cand) <= 2 * most
        return real(ids, q, cand, c, k)

    return pairs


def test_citation_similarity_counts_all_references_and_citing_papers(spark):
    rng = random.Random(6)
    pairs = {(q, 1000) for q in range(60)} | {(q, 1000 + rng.randrange(1, 40)) for q in range(80) for _ in range(15)} | {(rng.randrange(80), rng.randrange(80)) for _ in range(120)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    for k in (3, 30):
        got = {(r["query_id"], r["rank"]): (r["paper_id"], r["reason"]) for r in similarity.by_citations(
            spark.createDataFrame([(q,) for q in range(80)], "paper_id long"), spark.createDataFrame(pairs, "src long, dst long"), k).collect()}
        want = {}
        for q in range(80):
            direct = sorted(s for s, d in pairs if d == q)[:k]
            refs = {d for s, d in pairs if s == q}
            coupled = sorted({s for s, d in pairs if d in refs and s != q} - set(direct))
            for i, (p, why) in enumerate([*((p, "Cites this paper") for p in direct), *((p, "Cites same references") for p in coupled)][:k]):
                want[q, i + 1] = (p, why)
        assert got == want


def test_long_conflict_chains_settle(spark):
    n = 5000
    rows = [(i, i, f"g{i // 2}a") for i in range(n)] + [(i, i, f"g{(i + 1) // 2}b") for i in range(n)]
    got = {r["node"]: r["is_leader"] for r in greedy_representatives(spark.createDataFrame(rows, "node int, ord int, grp string")).collect()}
    assert [got[i] for i in range(n)] == [i % 2 == 0 for i in range(n)]
    large = {r["node"]: r["is_leader"] for r in greedy_representatives(spark.createDataFrame([r for r in rows if r[0] < 60], "node int, ord int, grp string"), rounds=3, local_rows=10).collect()}
    assert [large[i] for i in range(60)] == [i % 2 == 0 for i in range(60)]


def test_titles_that_normalise_to_nothing_are_equal(spark):
    rows = [(0, "...", None), (1, "!!", None), (2, "?", ["Ann Lee"]), (3, "a title", None)]
    df = spark.createDataFrame(rows, "ord int, title string, authors array<string>")
    nodes = {r["ord"]: r["node"] for r in linkage.title_nodes(df).collect()}
    got = {(r["node_a"], r["node_b"]) for r in linkage.similar_titles(df).collect()}
    assert nodes[0] == nodes[1] and got == {(nodes[0], nodes[2])}


def test_items_without_id_do_not_collapse(spark):
    from litflow.operators import reading

    rows = [("l", None, "A", 0), ("l", None, "B", 1), ("l", None, "A", 2), ("l", "7", "C", 3), ("l", "7", "D", 4), ("l", None, None, 5), ("l", None, None, 6)]
    df = spark.createDataFrame(rows, "list_id string, paper_id string, title string, position int")
    got = sorted(r["position"] for r in reading.distinct_items(df, ["position"]).collect())
    assert got == [0, 1, 3, 5]


def test_network_depth_of_a_capped_walk(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)], "src int, dst int")
    n, e = graph.build_network(edges, 0, depth=2, max_nodes=10)
    assert graph.graph_stats(n, e, 10).first()["depth_reached"] == 0
    n, e = graph.build_network(edges, 0, depth=2, max_nodes=100)
    assert graph.graph_stats(n, e, 100).first()["depth_reached"] == 1


def test_hybrid_clusters_join_both_descriptions(spark):
    words = (("kelp", "reef", "tide", "gull"), ("loom", "weft", "dyes", "wool"))
    rng = random.Random(5)
    rows = []
    for i in range(24):
        mine = [rng.choice(words[i % 2]) for _ in range(12)]
        rows.append((i, " ".join(mine[:3]), " ".join(mine[3:]), [float(i % 2), float(1 - i % 2), rng.random() / 50]))
    df = spark.createDataFrame(rows, "paper_id long, title string, abstract string, embedding array<double>")
    papers, vectors = df.drop("embedding"), df.select("paper_id", "embedding")
    got = topics.cluster_hybrid(papers, vectors, k=2).collect()
    assert sorted(r["size"] for r in got) == [12, 12] and all(0 < r["overlap"] <= r["size"] for r in got)
    of = {r["paper_id"]: r["cluster_id"] for r in topics.cluster_embeddings(vectors, 2)[0].collect()}
    for r in got:
        texts = [(t + " " + a).split() for i, t, a, _ in rows if of[i] == r["cluster_id"]]
        tf = {w: sum(t.count(w) for t in texts) for g in words for w in g}
        df_ = {w: sum(w in t for t in texts) for w in tf}
        score = {w: tf[w] * math.log(len(texts) / df_[w]) for w in tf if df_[w] >= 2}
        own = sorted(score, key=lambda w: (-round(score[w], 9), w))[:5]
        assert r["keywords"][: len(own)] == own and len(set(r["keywords"])) == len(r["keywords"]) <= 10


def test_network_of_string_ids_and_directions(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a"), ("b", "d"), ("e", "b")], "src string, dst string")
    n, e = graph.build_network(edges, "a", depth=2)
    assert sorted(tuple(r) for r in n.collect()) == [("a", 0, 0), ("b", 1, 1), ("c", 1, 2), ("d", 2, 3), ("e", 2, 4)]
    assert e.count() == 4
    n, e = graph.build_network(edges, "a", depth=2, include_citations=False)
    assert sorted(r["paper_id"] for r in n.collect()) == ["a", "b", "d"] and e.count() == 2
    for kinds in ({"max_nodes": 1}, {"include_references": False, "include_citations": False}):
        n, e = graph.build_network(edges, "a", **kinds)
        assert n.count() == 1 and e.count() == 0
    n, e = graph.build_network(edges, "nobody")
    assert [r["paper_id"] for r in n.collect()] == ["nobody"] and e.count() == 0


def test_digest_counts_the_sections_itself(spark):
    rows = [("u", f"i{k}", k, p, f"T{p}", 1.0 - p / 100) for k in range(5) for p in range(12)]
    df = spark.createDataFrame(rows, "user_id string, interest_id string, interest_ord int, paper_id int, title string, total_score double")
    got = {(r["interest_id"], r["paper_id"]) for r in digest.digest_items(df, 0.1, 2).collect()}
    assert got == {(f"i{k}", p) for k in range(5) for p in (2 * k, 2 * k + 1)}


def test_batch_embedder_takes_texts_in_batches(spark):
    from litflow.functions import vectors as vx

    def model(texts):
        assert len(texts) <= 2
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * i if i != 3 else None) for i in range(7)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", vx.batch_embedder(model, 2)(F.col("t")).alias("v")).collect()}
    assert got[3] is None and got[5] == [5.0, 1.0]


def test_greedy_rounds_give_back_their_rows(spark):
    import os

    from litflow.session import _ensure_checkpoint_dir

    _ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(root))
    # a chain of conflicts: every round decides one more link
    rows = [(i, i, f"g{g}") for i in range(9) for g in (i, i + 1)]
    got = greedy_representatives(spark.createDataFrame(rows, "node int, ord int, grp string"), rounds=3).collect()
    assert {r["node"] for r in got if r["is_leader"]} == {0, 2, 4, 6, 8}
    left = sorted(set(os.listdir(root)) - before)
    kept = [f for f in left if "grp" in spark.read.parquet(f"file:{root}/{f}").columns] if all(f.startswith("table-") for f in left) else left
    assert len(kept) <= 1  # only the last, empty rest


def test_only_contested_items_go_through_the_greedy_choice(spark, monkeypatch):
    from litflow.operators import independent_set, reading

    seen = []
    greedy = independent_set.greedy_representatives
    monkeypatch.setattr(independent_set, "greedy_representatives", lambda groups, *a: seen.append(groups.select("node").distinct().count()) or greedy(groups, *a))
    rng = random.Random(8)
    rows = [(1, f"p{rng.randrange(12)}", f"t{rng.randrange(12)}", i) for i in range(20)]
    rows += [(2, f"q{i}", f"u{i}", i) for i in range(30)] + [(2, None, None, 30), (2, None, "u0", 31), (None, "p", "t", 32), (None, "p", "s", 33), (None, "p2", None, 34)]
    df = spark.createDataFrame(rows, "list_id int, paper_id string, title string, position int")
    got = {(r["list_id"], r["position"]) for r in reading.distinct_items(df, ["position"]).collect()}
    wanted, held = set(), set()
    for list_id, paper, title, at in rows:
        mine = {(list_id, kind, v) for kind, v in (("id", paper), ("title", title)) if v is not None}
        if not mine & held:
            wanted.add((list_id, at))
            held |= mine
    assert got == wanted
    assert seen[0] <= 24


def test_rare_terms_are_dropped_before_terms_meet(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(3)), " ".join(rng.choice(words) for _ in range(6)), None if i % 5 == 0 else rng.randrange(40)) for i in range(150)]
    rows += [(900, None, "abcde fghab abcde fghab abcde", 3), (901, "alone alone", None, 45)]
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    papers = spark.createDataFrame(rows, "paper_id long, title string, abstract string, age int").withColumn("published_date", as_of - F.make_dt_interval("age"))
    whole = {(r["term"], r["day"]): r["n"] for r in trends.keyword_timeline(papers, as_of, 35).collect()}
    total = {}
    for (t, _), n in whole.items():
        total[t] = total.get(t, 0) + n
    often = trends.keyword_timeline(papers, as_of, 35, 3)
    got = {(r["term"], r["day"]): r["n"] for r in often.collect()}
    assert {k: n for k, n in whole.items() if total[k[0]] >= 3} == {k: n for k, n in got.items() if total[k[0]] >= 3}
    assert set(got) <= set(whole) and sum(total[t] < 3 for t in {t for t, _ in got}) < 0.1 * len(total)
    rising = trends.trending_keywords(often, 3, 35)
    full = trends.trending_keywords(trends.keyword_timeline(papers, as_of, 35), 3, 35)
    assert {(r["term"], r["total"], round(r["score"], 9)) for r in rising.collect()} == {(r["term"], r["total"], round(r["score"], 9)) for r in full.collect()}
    # terms meet once: the counts by day and the series of a term need no exchange of their own
    plan = trends.trending_keywords(often, 3, 35)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "hashpartitioning(term" in plan
    seeds = [(words[0], 2.0), (f"{words[1]} {words[2]}", 1.0), ("abcde fghab", 1.0)]
    mine = {(r["term"], r["day"]): r["n"] for r in trends.seed_timeline(papers, as_of, seeds, 35).collect()}
    assert mine == {k: n for k, n in whole.items() if k[0] in {s for s, _ in seeds}} and ("abcde fghab", 3) in mine
    assert trends.seed_timeline(papers, as_of, [], 35).count() == 0
    assert trends.keyword_timeline(papers.limit(0), as_of, 35, 3).count() == 0
    held = {r["paper_id"]: r["_mask"] for r in trends.with_seed_mask(papers, [words[0], "abcde fghab"]).collect()}
    assert held == {i: m for i, t, a, _ in rows if (m := sum(1 << k for k, s in enumerate((words[0], "abcde fghab")) if s in " ".join(x for x in (t, a) if x)))}


def test_rows_in_fair_parts_are_not_dealt_again(spark):
    even = spark.range(400, numPartitions=8)
    assert "RoundRobin" not in session.spread(even)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in session.spread(even.where("id < 90"))._jdf.queryExecution().executedPlan().toString()
    assert session.spread(even.where("id < 0")).count() == 0


def test_registered_searches_ask_for_every_row(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(9)
    tables = {
        "embeddings": spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(45)], "vec_id long, embedding array<float>, label int"),
        "documents": spark.createDataFrame([(i, f"Text {i}. More words.", "en", "src1") for i in range(60)], "doc_id long, text string, lang string, source string"),
        "supplier": spark.createDataFrame([(i, f"Supplier {i}") for i in range(7)], "s_suppkey long, s_name string"),
        "customer": spark.createDataFrame([(i, f"Customer {i}", "SEG") for i in range(11)], "c_custkey long, c_name string, c_mktsegment string"),
        "part": spark.createDataFrame([(i, i % 50) for i in range(60)], "p_partkey long, p_size int"),
        "lineitem": spark.createDataFrame(
            [(o, n, int(rng.integers(60)), 1, 1.0, "1996-01-01") for o in range(80) for n in range(4)],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    queries, here = entry.queries(), str(tmp_path)
    asked = lambda name: {r["query_id"] for r in queries[name](spark, here).select("query_id").distinct().collect()}
    assert asked("w7_embedding_knn") == asked("w8_find_similar") == asked("j10_w8_combined_similarity") == set(range(45))
    assert len(asked("j8_j9_citation_similarity")) > 50
    assert queries["w7_embedding_knn_lsh"](spark, here).first()["pairs"] == 450


def test_shared_references_are_dealt_and_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SHARED", 5)
    monkeypatch.setattr(similarity, "FIRST", 1)
    pairs = sorted({(q, 100) for q in range(40)} | {(q, 101 + q % 7) for q in range(40)} | {(q, q // 3) for q in range(1, 40)})
    for k in (2, 50):
        got = {}
        for r in similarity.by_citations(spark.createDataFrame([(q,) for q in range(40)], "paper_id long"), spark.createDataFrame(pairs, "src long, dst long"), k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["paper_id"]))
        for q in range(40):
            direct = sorted(s for s, d in pairs if d == q and s != q)[:k]
            refs = {d for s, d in pairs if s == q}
            coupled = sorted({s for s, d in pairs if d in refs and s != q} - set(direct))
            assert [p for _, p in sorted(got[q])] == (direct + coupled)[:k]
    x = np.round(np.random.default_rng(10).normal(size=(90, 2)), 1)  # many equal similarities
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "paper_id long, embedding array<double>")
    for found in (similarity.nearest(v, v, 3, block=4), similarity.nearest_probed(v, v, 3, lists=6, probes=6, list_rows=5, visit_rows=8)):
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sim = np.round(u @ u.T, 9)
        got = {(r["query_id"], r["rank"]): r["paper_id"] for r in found.collect()}
        assert got == {(i, n + 1): j for i in range(90) for n, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-sim[i, j], j))[:3])}


def test_rows_without_a_partner_are_dropped_by_a_bit_map(spark):
    held = spark.range(2000).select(F.xxhash64("id").alias("h"))
    test = session.bit_map(held)
    found = spark.range(40000).where(test(F.xxhash64("id"))).select("id").collect()
    assert {r["id"] for r in found} >= set(range(2000)) and len(found) < 6000
    assert spark.range(50).where(session.bit_map(held.limit(0))(F.xxhash64("id"))).count() == 0


def test_titles_are_compared_once_and_lists_joined_step_by_step(spark, monkeypatch):
    from litflow.operators import reading

    seen = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    greedy = linkage.greedy_representatives
    monkeypatch.setattr(linkage, "greedy_representatives", lambda groups: seen.append(plan(groups)) or greedy(groups))
    rows = [(i, f"A long enough title number {i // 2}", ["Ann Lee"], None, None, None, None) for i in range(8)] + [(8, "A long enough title number 0", None, None, None, None, None)]
    papers = spark.createDataFrame(rows, "ord int, title string, authors array<string>, doi string, arxiv_id string, semantic_scholar_id string, pubmed_id string")
    got = {r["ord"]: r["rep"] for r in linkage.group_records(papers, "greedy").collect()}
    assert got == dict.fromkeys(range(9), 0)
    assert "MapInPandas" not in seen[0] and "FileScan parquet" in seen[0]
    distinct = reading.distinct_items
    monkeypatch.setattr(reading, "distinct_items", lambda items, order: seen.append(plan(items)) or distinct(items, order))
    lists = spark.createDataFrame([(1, f"p{i}", f"t{i % 7}", i) for i in range(10)] + [(None, "p1", "t1", 11), (1, None, None, 12)], "list_id int, paper_id string, title string, position int")
    new = spark.createDataFrame([(1, "p3", "x", 0), (1, "y", "t3", 1), (1, "y", "z", 2), (1, None, "z", 3), (None, "p1", "t1", 4)], "list_id int, paper_id string, title string, position int")
    assert {r["position"] for r in reading.add_new(lists, new, ["position"]).collect()} == {2, 4}
    assert seen[1].count("LeftAnti") == 1
