"""Languages, fingerprints, near copies, tokens, repeats, components and the pipeline against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litflow.llm import components, languages, leaks, mixing, near_copies, prints, queries, repeats, secrets, stages, tokens
from litflow.llm.common import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---------------------------------------------------------------- languages


def test_languages_on_rows_held_out_from_learning(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == table.count()
    rest = [r for r in got if r["held_out"]]
    assert len(rest) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in rest]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "123 !?", "fr", "s", 0), (4, "hello world", None, "s", 0), (None, "the the", "en", "s", 0)]
    one = languages.learn(docs(spark, rows))
    assert one["langs"] == ["en"]
    got = {r["doc_id"]: r["lang_pred"] for r in languages.predict(docs(spark, rows).withColumn("row", F.lit(1)).withColumn("Score", F.lit(1)), one).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    none = languages.learn(docs(spark, []))
    assert [r["lang_pred"] for r in languages.predict(docs(spark, rows[3:4]), none).collect()] == ["und"]
    assert languages.predict(docs(spark, []), one).count() == 0
    odd = languages.learn(docs(spark, [(i, w * 5, lang, "s", 0) for i in range(40) for w, lang in (("kuu ", "xx"), ("the ", "en"), ("der ", "de"))]))
    assert {r["lang_pred"] for r in languages.predict(docs(spark, [(1, "kuu kuu", None, None, 0)]), odd).collect()} == {"xx"}


# ---------------------------------------------------------------- fingerprints


def test_samples_collide_like_generalised_jaccard():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts, pairs = [], []
    for _ in range(40):
        a = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        b = a[: rng.randint(0, len(a))] + [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(a), "  ".join(b).upper()]
        x, y = Counter(a), Counter(b)
        pairs.append(sum((x & y).values()) / sum((x | y).values()))
    raw, at = utf8(pa.array(texts))
    codes = prints.signatures(raw, at, 1024)
    got = prints.likeness(codes[::2], codes[1::2])
    assert np.abs(got - pairs).max() < 0.08 and abs((got - pairs).mean()) < 0.01


def test_each_text_is_compared_with_the_next(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()] + [(-5, None), (-4, ""), (-3, "é"), (7000, "same text"), (7001, "same text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1))
    got = {r["doc_id"]: r for r in prints.compare_with_next(frame.repartition(5)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    prints_of = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints_of.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert got[i]["near_edited"] == near(got[i]["fingerprint"], got[i]["edited_fingerprint"])
        assert got[i]["near_next"] == near(got[i]["fingerprint"], got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
    assert got[7000]["near_next"] == 1 and got[-5]["near_next"] == 1


def near(a, b):
    return np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)])


def test_fingerprints_of_few_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    one = prints.compare_with_next(frame).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert prints.compare_with_next(frame.limit(0)).count() == 0
    twice = prints.compare_with_next(frame.unionAll(frame).unionAll(spark.createDataFrame([(None, None)], "doc_id long, text string"))).collect()
    assert len(twice) == 3
    assert prints.fingerprints(frame.withColumn("fingerprint", F.lit(0))).first()["fingerprint"] == one[0]["fingerprint"]


# ---------------------------------------------------------------- near copies


def simhash(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(values, budget=4):
    """Smallest index reachable, by all pairs."""
    v = np.array(values, np.uint64)
    near_ = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
    label = np.arange(len(v))
    while True:
        new = np.array([label[near_[i]].min() for i in range(len(v))])
        if (new == label).all():
            return label
        label = new


def test_near_copies_equal_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()] + [(5000, None), (5001, ""), (5002, "A b"), (5003, "a  B")]
    got = {r["doc_id"]: r for r in near_copies.near_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))).collect()}
    values = [simhash(t) for _, t in rows]
    want = classes(values)
    for (i, _), v, c in zip(rows, values, want):
        assert got[i]["simhash"] & (2**64 - 1) == v and got[i]["component_id"] == rows[c][0]


@pytest.mark.parametrize("most", [None, 40])
def test_links_of_dense_groups_and_split_groups(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(near_copies, "TRIE_ROWS", most)
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for k in range(500):
        v = centre[0 if k % 3 else k % 6]
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    frame = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "doc_id long, simhash long")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.with_components(frame).collect()}
    assert [got[i] for i in range(len(values))] == classes(values).tolist()
    links = near_copies.fingerprint_links(frame.select(F.lit(0).alias("print"), F.col("simhash").alias("v"))).collect()
    assert len(links) < 5 * len(values) * (1 if not most else 40)


def test_near_copy_edge_cases(spark):
    rows = [(None, "a b c d e", "en", "s", 0), (3, "a b c d e", "en", "s", 0), (3, "a b c d e", "en", "s", 0), (3, "other words stand here now", "en", "s", 0), (None, "alone", "en", "s", 0)]
    got = sorted(map(tuple, near_copies.keep_one(docs(spark, rows)).collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(3, "a b c d e"), (3, "other words stand here now"), (None, "alone")]
    assert near_copies.keep_one(docs(spark, [])).count() == 0


def test_components_of_chains_stars_and_self_edges(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 4), (7, 7), (2000, 2001), (2000, 2001)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[5000] == 5000 and got[2001] == 2000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- tokens

BPE = None
try:
    import public_tokenizers

    BPE = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:
    pass


@pytest.mark.skipif(BPE is None or not os.path.exists(BPE), reason="no vocabulary file")
def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    bits = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "é", "你", "😀", "23", "\x85", "!", "<|endoftext|>", "<|endof", " world", "\r\n", "\u3000"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["a" * 5000, " " * 600, "x" * 300 + " y"]
    texts = [None, *odd, *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_bytes", F.lit("x"))
    for r in tokens.count_tokens(frame, BPE, 20).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), size(t), size(t) > 20)
        assert size(t[: r["fit_chars"]]) <= 20 and (r["fit_chars"] == len(t)) >= (size(t) <= 20)
    few = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    for r in tokens.token_prefixes(few, BPE).collect():
        t = texts[r["doc_id"]] or ""
        assert r["prefix_tokens"] == [size(t[:k]) for k in range(len(t) + 1)]
    assert tokens.count_tokens(frame.limit(0), BPE).count() == 0


# ---------------------------------------------------------------- repeats


def kept_by_brute_force(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("group_rows", [32_768, 3])
def test_repeats_equal_brute_force(spark, group_rows):
    rng = random.Random(11)
    base = "".join(rng.choice("abcdé ") for _ in range(400))
    texts = [None, "", "short", "z" * 300, "ab" * 100, base[:60], base[:60]]
    for _ in range(60):
        s = rng.randrange(340)
        texts.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) + base[s : s + rng.randint(0, 60)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20))))
    texts += [f"{i:03d}" + base[100:135] + f"{i:03d}" for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("spans", F.lit(2))
    want = kept_by_brute_force(texts, 30)
    got = repeats.remove_repeats(frame, 30, group_rows=group_rows).collect()
    assert len(got) == len(texts)
    for r in got:
        n, removed, runs, left = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, left), r["doc_id"]
        assert r["text"] == texts[r["doc_id"]] and r["k1"] == 2 and r["kept_sha256"] == hashlib.sha256(left).hexdigest()


def test_repeats_in_a_whole_table_and_an_empty_one(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    want = kept_by_brute_force([t for _, t in rows], 400)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(table).collect()}
    assert all((got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == w[1:] for (i, _), w in zip(rows, want)) and sum(w[1] for w in want) > 1000
    assert repeats.remove_repeats(table.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def set_table(texts, prints=stages.PRINTS * 3 // 2):
    hashes, n = near_copies.distinct_shingles(*utf8(pa.array(texts, pa.large_string())), 5)
    return near_copies.set_prints(hashes, n, prints), n


def test_prints_of_shingle_sets_by_hand():
    texts = ["a b c d e f g", "A b  c d e\nf g", None, "", "one two", "one two three four five", "x " * 2_000, " ".join(f"w{i}" for i in range(1_500))]
    table, n = set_table(texts, 3)
    assert n.tolist() == [3, 3, 0, 0, 1, 1, 1, 1496] and (table[0] == table[1]).all() and not table[2:4].any()
    hashes, _ = near_copies.distinct_shingles(*utf8(pa.array(texts, pa.large_string())), 5)
    at = 0
    for row, size in zip(table, n):
        mine = hashes[at : at + size]
        assert len(set(mine.tolist())) == size
        for k in range(3):
            mine = near_copies._mixed(mine + np.uint64(0x9E3779B97F4A7C15))
            assert int(row[k]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in mine) > size)
        at += size


def test_fingerprints_of_the_pipeline_find_nine_of_ten_copies_in_every_band_from_080():
    rng = random.Random(4)
    pairs, bands = [], []
    while len(pairs) < 1600:
        size = rng.choice([60, 120, 300])
        w = [f"w{rng.randrange(5000)}" for _ in range(size)]
        c = list(w)
        for _ in range(rng.randint(1, max(1, size // 40))):
            c[rng.randrange(size)] = "new"
        alike = jaccard(" ".join(w), " ".join(c))
        if alike >= 0.8:
            pairs += [" ".join(w), " ".join(c)]
            bands.append(min(int(alike * 20), 18))
    table, n = set_table(pairs)
    near = near_copies.Near(stages.PERCENT, table.shape[1])
    bits = np.bitwise_count(table[::2] ^ table[1::2]).astype(int)
    found = (bits[:, : stages.PRINTS].min(axis=1) <= stages.BITS) & near.sizes(n[::2], n[1::2]) & near.bits(bits.sum(axis=1), np.minimum(n[::2], n[1::2]))
    for band in (16, 17, 18):
        assert np.mean(found[np.array(bands) == band]) >= 0.9, band


def linked_components(texts):
    """Smallest place reachable by links, from all pairs: the relation that ``checked_components`` states."""
    table, n = set_table(texts)
    near = near_copies.Near(stages.PERCENT, table.shape[1])
    sets = [shingles(t) if (t or "").split() else set() for t in texts]
    held = np.zeros((len(texts), len(texts)), bool)
    candidates = 0
    for i in range(len(texts)):
        bits = np.bitwise_count(table[i] ^ table).astype(int)
        maybe = bits[:, : stages.PRINTS].min(axis=1) <= stages.BITS
        maybe &= near.sizes(n[i], n) & near.bits(bits.sum(axis=1), np.minimum(n[i], n))
        candidates += maybe.sum()
        for j in np.flatnonzero(maybe):
            held[i, j] = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    label = np.arange(len(texts))
    while not np.array_equal(new := np.array([label[held[i]].min() for i in range(len(texts))]), label):
        label = new
    return label, candidates - held.sum()


@pytest.mark.parametrize("most, rows", [(16, None), (1, 40)])
def test_near_copies_are_the_components_of_alike_links(spark, monkeypatch, most, rows):
    monkeypatch.setattr(near_copies, "MOST", most)
    monkeypatch.setattr(near_copies, "GROWTH", 2)
    monkeypatch.setattr(near_copies, "HOT_LINKS", 7)
    if rows:
        monkeypatch.setattr(near_copies, "TRIE_ROWS", rows)
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"] is stages.drop_checked_copies
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = [None, "", "  ", "one two three four five six", "One two three four five  six", "12 a b c d e"]
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    label, failing = linked_components(texts)
    assert failing > 100
    got = {r["doc_id"] for r in stages.drop_checked_copies(spark, docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), SF).collect()}
    assert got == {i for i, c in enumerate(label) if i == c}


def test_copies_edited_too_far_are_not_compared_in_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    texts = []
    for n in range(60):  # any two share 81 of 96 shingles each, which is too few
        w = list(base)
        for at in (20, 50, 80):
            w[at] = f"own{n}x{at}"
        texts.append(" ".join(w))
    label, failing = linked_components(texts)
    assert failing > 400 and list(label) == list(range(60))
    checked, beside = [], near_copies._beside
    monkeypatch.setattr(near_copies, "_beside", lambda links, *more: checked.append(links.count()) or beside(links, *more))
    table = docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert stages.drop_checked_copies(spark, table, SF).count() == 60
    assert sum(checked[1:]) <= 2 * near_copies.MOST * 60 and sum(checked[2:]) == 0


def test_links_into_components_do_not_grow_with_the_pairs_of_a_dense_group(spark, monkeypatch):
    rng = random.Random(6)
    centre, reach, per_node = [rng.getrandbits(64) for _ in range(16)], [], []
    monkeypatch.setattr(near_copies, "connected_components", lambda links: reach.append(links.distinct().count()) or components.connected_components(links))
    for n in (100, 200):
        rows = []
        for node in range(n):
            prints = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for v in centre]
            rows.append((node, [v - 2**64 if v >= 2**63 else v for v in prints]))
        got = near_copies.print_components(spark.createDataFrame(rows, "node long, prints array<long>"), 6).collect()
        assert {(r["node"], r["component"]) for r in got} == {(node, 0) for node in range(n)}
        per_node.append(reach[-1] / n)
    assert max(per_node) < 6, per_node


def test_texts_alike_are_not_linked_by_prints_beyond_the_budget(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [(1, " ".join(words)), (2, " ".join(f"x{i}" for i in range(100))), (3, " ".join([*words[:50], "new", *words[51:]]))]
    table = spark.createDataFrame([(1, [0], 96), (2, [0b111], 96), (3, [0b111111], 96)], "node long, prints array<long>, size long")
    # 1 and 3 share enough, but differ in six bits; 2 lies between them and is unlike both
    got = near_copies.checked_components(table, spark.createDataFrame(texts, "node long, text string"), 4, 5, 80, 1).collect()
    assert all(r["node"] == r["component"] for r in got), got
    got = near_copies.checked_components(table, spark.createDataFrame(texts, "node long, text string"), 6, 5, 80, 1).collect()
    assert {r["node"]: r["component"] for r in got}[3] == 1


def test_nearest_pairs_over_all_tasks_are_few(spark):
    rows = [(abs(i - j), i, j) for i in range(40) for j in range(i + 1, 40)]
    got = {(r["a"], r["b"]) for r in near_copies.nearest_pairs(spark.createDataFrame(rows, "bits int, a bigint, b bigint").repartition(7), 2).collect()}
    # each inner node has its two neighbours, the ends have two on one side
    assert got == {(i, i + 1) for i in range(39)} | {(0, 2), (37, 39)}


def test_best_pairs_keep_the_nearest_of_both_ends():
    best = near_copies.Best(1)
    best.add(np.array([1, 1, 2, 5]), np.array([2, 3, 3, 6]), np.array([4, 9, 5, 7]))
    best.add(np.array([2, 4]), np.array([1, 1]), np.array([4, 10]))
    a, b = best.pairs()
    # (1, 2) is the nearest of both, (2, 3) of 3, (5, 6) of both, (1, 4) of 4; (1, 3) of none: there are more
    assert sorted(zip(a.tolist(), b.tolist())) == [(-1, -1), (1, 2), (1, 4), (2, 3), (5, 6)]
    few = near_copies.Best(9)
    few.add(np.array([1]), np.array([2]), np.array([3]))
    assert [x.tolist() for x in few.pairs()] == [[1], [2]]


CLASHING = ("score", "lang_pred", "spans", "items", "n_hit", "n_words", "secrets", "size", "copies", "copy", "row", "text2", "SIMHASH", "with space", "a.b", "__k1")


def test_stages_pass_on_clashing_columns_and_empty_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    wide = table.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHING])
    for name, stage in stages.STAGES:
        got = stage(spark, wide, SF)
        assert got.columns[: len(wide.columns)] == wide.columns and (name == "mixing") == (len(got.columns) > len(wide.columns)), name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING), name
        assert len(rows) == stage(spark, table, SF).count(), name
        none = stage(spark, wide.limit(0), SF)
        assert none.count() == 0 and none.columns == got.columns, name
    assert "mix_size" in got.columns and "taken" in got.columns


def test_pipeline_stage_by_stage(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9000, "12345 !!", None, "src0", 8), (9001, None, "en", "src0", None), (9002, "", "en", None, 0)]
    docs_ = docs_.unionByName(spark.createDataFrame(extra, docs_.schema))
    start = {r["doc_id"]: r["text"] for r in docs_.collect()}
    one = stages.identify_language(spark, docs_, SF).cache()
    assert one.columns == docs_.columns and {r["doc_id"] for r in one.collect()} == set(start) - {9000, 9001, 9002}
    two = stages.drop_checked_copies(spark, one, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    label, _ = linked_components([t for _, t in rows])
    assert {r["doc_id"] for r in two.collect()} == {rows[i][0] for i, c in enumerate(label) if i == c} and two.columns == docs_.columns
    three = stages.decontaminate(spark, two, SF).cache()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = {r["doc_id"]: (r["n_hit"], r["n_words"]) for r in leaks.find_leaks(two, bench).collect()}
    left = {r["doc_id"]: r["text"] for r in three.collect()}
    assert set(left) == {i for i, (h, n) in hits.items() if h == 0 or h < n}
    assert all(left[i] == start[i] for i in left if not hits[i][0]) and any(h for h, _ in hits.values())
    four = stages.redact_secrets(spark, three, SF).cache()
    assert four.count() == three.count() and four.columns == docs_.columns
    assert secrets.find_secrets(four).where(F.size("secrets") > 0).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())
    five = stages.mix_sources(spark, four, SF)
    took = {r["source"]: r["t"] for r in five.groupBy("source").agg(F.sum("size").alias("t")).collect()}
    per = mixing.mix(four).groupBy("source").agg(F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(took.get(r["source"], 0) - r["g"]) <= r["m"] for r in per)
    assert corpus_pipeline.run(spark, SF).count() > 0
