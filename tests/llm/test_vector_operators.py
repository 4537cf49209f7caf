"""Toxic passages, centroid clustering and whitening against brute force."""

import hashlib
import random
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litflow.llm import centroids, queries, toxicity, whitening
from litflow.llm.common import utf8

VECTORS = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- toxicity


def all_maximal(scores):
    """Maximal segments by their recursive meaning: the best of a range, then those left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            total = sum(scores[i : j + 1])
            if total > best or total == best and at and j - i < at[1] - at[0]:
                best, at = total, (i, j)
    i, j = at
    left, right = all_maximal(scores[:i]), all_maximal(scores[j + 1 :])
    return left + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -0.5, 1.25, 2.0, 4.5]) + rng.random() / 100 for _ in range(rng.randint(0, 25))]
        sums = [sum(scores[:i]) for i in range(len(scores) + 1)]
        up = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(up, [scores[i] for i in up], [sums[i] for i in up])
        want = all_maximal(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_tokens_hash_alike_wherever_they_stand():
    texts = ["You FOOL, foolish fool", None, "", "fool", "größe Größe x1", "!?", "a" * 5_000]
    bucket, starts, ends, rows = toxicity.tokens(*utf8(pa.array(texts)))
    assert rows.tolist() == [0, 4, 4, 4, 5, 8, 8, 9]
    assert bucket[1].tolist() == bucket[3].tolist() == bucket[4].tolist() and bucket[2, 0] != bucket[1, 0]
    assert bucket[1, 0] + toxicity.BUCKETS == bucket[1, 1]  # a short token is its own stem
    assert bucket[2, 1] != bucket[2, 0] + toxicity.BUCKETS
    assert (ends - starts).tolist()[:4] == [3, 4, 7, 4] and len({tuple(b) for b in bucket.tolist()}) == 6


def corpus(spark, n=400):
    rng = random.Random(11)
    plain, vile = [f"word{i}" for i in range(80)], ["vilest", "wretch", "grimest"]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(vile) for _ in range(2)]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return rows, marks


def test_toxic_texts_are_found_and_their_passages_placed(spark):
    rows, marks = corpus(spark)
    odd = [(1000, None), (1001, ""), (1002, " ?! "), (1003, "word1 " * 20_000 + "vilest wretch"), (None, "vilest vilest vilest"), (1003, "Ünd vilest grimest")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("SCORE", F.lit("x")).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame(marks + [(None, 1), (7, None), (1, 0), (9_999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).select("doc_id", "text", "score", "passages", "n_passages", "toxic").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["toxic"] == 5 for r in got)
    truth = dict(marks)
    assert all((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth)
    for r in got:
        if r["doc_id"] in truth and truth[r["doc_id"]]:
            assert r["n_passages"] == len(r["passages"]) >= 1
            assert all(r["text"][p["start"] : p["end"]].split()[0] in ("vilest", "wretch", "grimest") for p in r["passages"])
    by_text = {r["text"]: r for r in got}
    assert by_text[None]["score"] == by_text[""]["score"] == by_text[" ?! "]["score"] < 0.5
    assert by_text["Ünd vilest grimest"]["passages"][0]["start"] == 4
    long = by_text[odd[3][1]]["passages"]
    assert [odd[3][1][p["start"] : p["end"]] for p in long] == ["vilest wretch"]


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, 0)], none.schema)):
        model = toxicity.learn(docs, labels)
        assert len({r["score"] for r in toxicity.score(docs, model).collect()}) == 1
        assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs.limit(0), none).buckets.size == 0


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    clean = [r for r in got if r["held_out"] and not r["toxic"]]
    assert sum(r["predicted"] for r in clean) == 0
    toxic = [r for r in got if r["toxic"]]
    assert np.mean([r["predicted"] for r in toxic]) > 0.6  # 51 texts, 40 learned from: some words stand in one text only


# ---------------------------------------------------------------- clusters


def plain_clusters(rows, k=8, rounds=10, width=64):
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = {}
    for _, n, d in found:
        per[n] = per.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, per[n], sum(per.values()), digest[n]) for i, n, d in found), key=str)


def vector_rows(n=300, width=64, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=width) / 8 + (i % 5) / 3).astype(np.float32).tolist()) for i in range(n)]
    odd = [(900, None), (901, []), (902, [1.0] * (width - 1)), (903, [float("nan")] + [0.0] * (width - 1)), (904, [None] * width), (905, [float("inf")] * width)]
    return rows + odd + [rows[0], rows[0], (None, rows[1][1]), (906, [0.0] * width)]


def test_clusters_equal_a_plain_version(spark, monkeypatch):
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("cluster", F.lit("x")).repartition(5)
    for block in (centroids.BLOCK, 7):
        monkeypatch.setattr(centroids, "BLOCK", block)
        got = centroids.cluster(table)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows)


def test_few_equal_and_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert centroids.cluster(make([])).count() == 0
    assert centroids.cluster(make([(1, None)])).count() == 0
    same = [(i, [0.5] * 64) for i in range(20)]
    assert sorted((tuple(r) for r in centroids.cluster(make(same)).collect()), key=str) == plain_clusters(same)
    three = vector_rows(3)[:3]
    assert sorted((tuple(r) for r in centroids.cluster(make(three)).collect()), key=str) == plain_clusters(three)
    huge = centroids.cluster(make([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [3e38] * 64)]), rounds=2).collect()
    assert len(huge) == 3 and all(r["distance"] >= 0 for r in huge)


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors):
    x = [tuple(floor(64 * float(v)) + 1_000_000 for v in row) for row in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[v * n - s for v, s in zip(row, sums)] for row in fit], float) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return x, n, sums, e[::-1], v[:, ::-1]


def whitened_rows(got):
    out = {}
    for r in got:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.mark.parametrize("width, n", [(64, 400), (5, 60), (20, 8)])
def test_whitening_equals_an_eigen_decomposition(spark, width, n):
    rng = np.random.default_rng(width)
    base = (rng.normal(size=(n, width)) @ np.diag(2.0 ** -np.arange(width).clip(max=6)) + 5).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    table = spark.createDataFrame(rows + [(i + 1000, v, 1) for i, v, _ in rows[: n // 3]] + [(990, None, 1), (991, [], 1), (992, [float("nan")] * width, 1), (993, [None] * width, 1), (994, [1.0] * (width + 1), 1)], VECTORS)
    got = whitened_rows(whitening.whiten(table.withColumn("n", F.lit("x")).repartition(3)).collect())
    x, size, sums, e, v = plain_whitening(base)
    assert set(got) == {i for i, _, _ in rows} | {i + 1000 for i in range(n // 3)}
    k = min(16, width, size - 1)
    signs = None
    for i, row in enumerate(x):
        mine = got[i]
        assert set(mine) == set(range(1, k + 1))
        centred = np.array([a * size - s for a, s in zip(row, sums)], float) / size
        want = np.array([centred @ v[:, c] / np.sqrt(e[c]) for c in range(k)])
        have = np.array([mine[c + 1]["whitened"] for c in range(k)])
        if signs is None:
            signs = np.sign(have * want)
        assert np.allclose(have, want * signs, atol=1e-7)
        assert mine[1]["deviation"] == sum((a * size - s) ** 2 for a, s in zip(row, sums)) and mine[1]["n"] == size
        assert np.allclose([mine[c + 1]["explained"] for c in range(k)], e[:k] / e.sum(), rtol=1e-9)
        assert mine[1]["identity_error"] < 1e-9
    assert all(np.isclose(got[1000][c]["whitened"], got[0][c]["whitened"], atol=1e-9) for c in got[0])


def test_whitening_of_nothing_one_value_and_few_directions(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9
    assert abs(line[0]["explained"] - 1) < 1e-9 and line[0]["identity_error"] < 1e-9
    huge = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3}


def test_whitening_of_ill_conditioned_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 12)) * np.array([1e6, *[1.0] * 10, 0.05]) + 1e4
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 500 * 12 and got[0]["identity_error"] < 1e-6
