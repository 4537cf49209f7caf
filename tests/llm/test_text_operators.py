"""Mixing, chat formatting, secrets, leaks and urls against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from litflow.llm import chat, leaks, mixing, secrets, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---------------------------------------------------------------- mixing


def level(sizes, weights, cap):
    """Shares by weight, excess over the cap reshared until none is above."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    got = [0.0] * len(sizes)
    while open_ and total > 1e-9:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if total * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                got[i] = total * weights[i] / w
            break
        for i in over:
            got[i] = cap * sizes[i]
            total -= got[i]
        open_ -= over
    return got


def test_mix_hits_targets_and_never_exceeds_the_cap(spark):
    rows = []
    for i in range(3000):
        source = ["a", "b", "c", None, "é", "tiny"][0 if i % 3 == 0 else i % 5]
        rows.append((i, "w " * (1 + (i * 7919) % 60), "en", source, 0))
    rows += [(9000 + i, "one two", "en", "tiny", 0) for i in range(5)] + [(9100, None, None, "a", None), (9101, "", None, "a", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((x[0], x[1]) for x in rows[-9:]).get(r["doc_id"], rows[r["doc_id"]][1] if r["doc_id"] < 3000 else "") or ""))
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        b = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        b[0] += r["size"]
        b[1] += r["taken"]
    order = sorted(by, key=lambda s: (s is None, s))
    want = level([by[s][0] for s in order], [1 + i % 3 for i in range(len(order))], 3)
    for s, w in zip(order, want):
        size, taken, source_size, target = by[s]
        assert size == source_size and target == pytest.approx(w)
        assert abs(taken - target) <= 61
    assert sum(want) == pytest.approx(sum(by[s][0] for s in order))
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_small_buckets_give_a_mixture_of_the_same_kind(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "a" if i % 3 else "b", 0) for i in range(900)]
    got = mixing.mix(docs(spark, rows), bucket_rows=50).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 10 for r in got)


def test_mix_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, "a b", "en", "s", 0)] * 50 + [(None, "a b c", "en", "s", 0)] * 3
    clash = docs(spark, rows).withColumn("size", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("key", F.lit("k")).withColumn("Target", F.lit(2))
    got = mixing.mix(clash)
    assert {"rank", "key"} <= set(got.columns) and got.count() == 53
    assert got.where("copies <> 1").count() == 0  # one source keeps all
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None, None, None), (2, " ", "x", "y", 1)])).agg(F.sum("copies")).first()[0] == 0
    assert mixing.emit(got).count() == 53


# ---------------------------------------------------------------- chat


TALKS = [
    [("user", "hi"), ("assistant", "</s>[INST] ok [/INST]")],
    [("system", "a\\b\\\\[INST"), ("user", ""), ("assistant", "x\n\ny<s>"), ("user", "[\\INST]"), ("assistant", "<<SYS>>é😀\\")],
    [("we[/INST]ird", "</s></s>"), ("", "")],
    [],
]


def test_formatting_is_reversible_and_masks_the_assistant(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TALKS)], "conv_id int, turns array<struct<role:string,text:string>>")
    made = chat.format_chat(rows).select("conv_id", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("segments")).alias("loss"), "formatted", "segments")
    for r in made.collect():
        talk = TALKS[r["conv_id"]]
        assert [tuple(t) for t in r["read"]] == talk
        assert r["loss"] == "".join(x for who, x in talk if who == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count("</s>") == len(talk) == r["formatted"].count("[INST]")


def test_layouts_are_told_apart_by_their_paths(spark):
    said = "array<struct<role:string,content:string>>"
    schema = f"id int, record struct<messages:{said},conversations:array<struct<`from`:string,value:string>>,system:string,prompt:string,completion:string,instruction:string,input:string,output:string>"
    blank = (None,) * 8
    put = lambda **k: tuple(k.get(n, b) for n, b in zip(("messages", "conversations", "system", "prompt", "completion", "instruction", "input", "output"), blank))
    rows = [
        (0, put(messages=[("user", "a"), ("assistant", None)])), (1, put(conversations=[("human", "a"), ("gpt", "b")])),
        (2, put(prompt="a", completion="b")), (3, put(system="s", prompt="a", completion="b")), (4, put(instruction="a", output="b")),
        (5, put(instruction="a", input="c", output="b")), (6, put()), (7, put(input="only")), (8, put(messages=[])), (9, None),
    ]
    got = {r["id"]: r for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["layout"] for i in range(10)] == ["messages", "conversations", "prompt", "prompt_system", "instruction", "instruction_input", None, None, "messages", None]
    turns = {i: [tuple(t) for t in got[i]["turns"] or []] for i in got}
    assert turns[0] == [("user", "a"), ("assistant", "")] and turns[1] == turns[2] == turns[4] == [("user", "a"), ("assistant", "b")]
    assert turns[3][0] == ("system", "s") and turns[5][0] == ("user", "a\n\nc") and turns[8] == []
    assert len({got[i]["schema_hash"] for i in range(6)}) == 6


def test_messages_gather_with_nulls_and_ties(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "a"), (None, 0, "user", "x"), (1, None, "system", "z"), (1, 1, "user", "a")]
    got = {r["conv_id"]: [tuple(m) for m in r["record"]["messages"]] for r in chat.gather_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == [("system", "z"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and got[None] == [("user", "x")]
    assert chat.gather_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- secrets


KEY = "AKIA" + "Q1" * 8
TEXTS = [
    None, "", "nothing here", f"é😀 password = \"hunter22\" and {KEY}.", "secret=token:abcdefgh", "TOKEN:'ab' api_key=abcdef apikey : \"abcde\"",
    "x" + "0123456789abcdef" * 3 + "Z" + "a" * 23 + "g" + "f" * 24, f"akia {KEY}{KEY} AKIA123 " + "deadbeef" * 3, "ghp_" + "aB3" * 12,
    "-----BEGIN RSA PRIVATE KEY-----", "xoxb-12345-abcdefghij secret: xoxb-12345-abcdefghij", "ſecret=abcdefgh toKen=abcdefgh",
    "passwd:" + "a" * 100_000 + " " + "token=abcdefg " * 3000, "sk_live_" + "a1" * 10, "password\n=abcdefg password =\tabcdefg password  :  abcdefg=",
]


def found_by_python(text, rules):
    spans = []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("(?i:(", "(?ia:(") if rule.kind == "assign" else rule.pattern
        spans += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(rule.group)) >= rule.least]
    return sorted(spans)


def base_by_contract(text):
    out = []
    for rank, (pattern, group, least) in enumerate((
        (r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24),
    )):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets_equal_python_scans(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] * 2
    got = secrets.find_secrets(docs(spark, rows).withColumn("secrets", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rules", F.lit("r")))
    assert got.count() == len(rows) and {"key", "rules"} <= set(got.columns)
    for r in got.collect():
        spans = [tuple(s) for s in r["secrets"]]
        assert spans == found_by_python(r["text"], secrets.RULES), r["doc_id"]
        assert [s for s in spans if s[1] < 3] == base_by_contract(r["text"])
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_secrets_in_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.find_secrets(table).collect()
    assert len(got) == table.count() and sum(len(r["secrets"]) for r in got) > 5
    assert all([tuple(s) for s in r["secrets"]] == found_by_python(r["text"], secrets.RULES) for r in got)


def test_trigram_queries():
    assert [sorted(w) for w in secrets.trigram_query("AKIA[A-Z0-9]{16,}")] == [["aki", "kia"]]
    assert secrets.trigram_query("[0-9a-f]{24,}") == [frozenset()]
    assert secrets.trigram_query("abc(de|xy)?z") == [frozenset({"abc", "bcd", "cde", "dez"}), frozenset({"abc", "bcx", "cxy", "xyz"}), frozenset({"abc", "bcz"})] or len(secrets.trigram_query("abc(de|xy)?z")) == 3
    assert secrets.scans_fully(secrets.BASE[2]) and not secrets.scans_fully(secrets.BASE[0])


def test_redaction_joins_overlapping_spans(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.find_secrets(docs(spark, rows))).collect()}
    for i, t in enumerate(TEXTS):
        want, upto = [], 0
        for a, _, b in found_by_python(t, secrets.RULES):
            if a > upto or (not want):
                want += [t[upto:a], "[SECRET]"]
            upto = max(upto, b)
        assert got[i] == (None if t is None else "".join(want) + t[upto:]), i


# ---------------------------------------------------------------- leaks


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def leaks_by_python(texts, items, window):
    out = []
    for t in texts:
        w, hit, met = words(t), set(), set()
        for name, item in items:
            v = words(item)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                part = v[k : k + window]
                for i in range(len(w) - len(part) + 1):
                    if w[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        met.add(name)
        out.append((len(w), len(hit), sorted(met)))
    return out


ITEMS = [
    ("10", "The quick Brown fox jumps over the lazy dog and runs away from it all day long"), ("9", "short item here"), ("x", ""), ("y", None), ("11", "short item here"),
    ("12", "the the the the the the the the the the the the"), ("13", "É tude in ß minor"),
]
LEAKY = [
    None, "", "?!", "before THE quick, brown fox: jumps over the lazy dog and after", "quick brown fox jumps over the lazy dog and runs away short ITEM here!",
    "the " * 40, "item here short item", "short item here short item here", "x é tude in ß minor", "é tude in", "short item", "here",
    "and runs away from it all day long the quick brown fox jumps over the lazy dog and runs away from it all day long", "word " * 5000 + "short item here",
]


@pytest.mark.parametrize("block", [None, 120])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(LEAKY)] * 2
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = leaks.find_leaks(docs(spark, rows).withColumn("spans", F.lit(1)).withColumn("number", F.lit(3)), bench)
    want = leaks_by_python(LEAKY, ITEMS, 10)
    seen = got.collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]
        raw = (r["text"] or "").encode()
        assert sum(len(words(raw[s["start"] : s["end"]].decode())) for s in r["spans"]) == r["n_hit"]
    left = leaks.remove_leaks(got)
    for r in left.collect():
        n, hit, _ = want[r["doc_id"]]
        assert len(words(r["text"])) == n - hit and r["number"] == 3
        if not hit:
            assert r["text"] == LEAKY[r["doc_id"]]


def test_a_benchmark_in_twenty_blocks_and_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 4 * 300)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 25)
    held, search = [], leaks._search

    def seen(docs, text, items, window):
        held.append(sum(len(t) for _, t in items))
        return search(docs, text, items, window)

    monkeypatch.setattr(leaks, "_search", seen)
    item = [f"w{i % 37}x{i % 11}" for i in range(900)]  # one item, many times a block
    items = [("long", " ".join(item)), ("short", "a few words"), ("long", "again a few words")]
    texts = [" ".join(item[lo : lo + n]) for lo, n in ((0, 9), (0, 10), (14, 14), (20, 40), (880, 20), (889, 11), (390, 35))]
    texts += [" ".join(item), "only a few words here", "again a few words", None, "", "nothing of it"]
    got = leaks.find_leaks(docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id string, text string"))
    want = leaks_by_python(texts, items, 10)
    rows = got.collect()
    assert len(rows) == len(texts) and [got.columns[-4:]] == [["n_words", "n_hit", "items", "spans"]]
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]
    assert len(held) >= 20 and max(held) <= 300


def test_leaks_with_nothing_to_look_for(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    rows = docs(spark, [(1, "a b", "en", "s", 0)])
    assert [(r["n_words"], r["n_hit"]) for r in leaks.find_leaks(rows, none).collect()] == [(2, 0)]
    assert leaks.find_leaks(docs(spark, []), none).count() == 0


def test_index_against_plain_search():
    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(40):
        symbols = int(rng.integers(1, 6))
        seq = np.append(rng.integers(0, symbols + 1, int(rng.integers(1, 200))), 0)
        if trial % 4 == 0:
            seq = np.append(np.tile(seq[:7], 30), 0)
        index = leaks.FmIndex(seq, symbols)
        for size in range(1, 7):
            patterns = rng.integers(1, symbols + 1, (8, size))
            lo, hi = index.search(patterns, np.full(8, size))
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == want


# ---------------------------------------------------------------- urls


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=/es/", "http://example.org/en/2", "http://badexample.org/es/3", "ftp://x.com/de/", "http://x.com/de",
    "http://com/fr/?q", "http://x.net/de/", "http://org", "http://org/", "://a.org/b://c", "http://É.com/fr/1#x", "http://x.com?/de/", "http://x.org#/a/",
]


def test_rules_by_host_and_path(spark):
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("Host", F.lit("h"))
    got = urls.judge_urls(rows).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge_urls(rows.limit(0)).count() == 0


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    link = lambda to: f"<head><LINK href='{to}' rel='canonical'></head>"
    rows = [
        (1, "http://a.net/1", link("http://x.com/de/5")), (2, "https://a.net/1#top", None), (3, "http://b.net/1", link("http://c.net/1")),
        (4, "http://c.net/1", link("http://d.org/")), (5, "http://c.net/2", "<meta http-equiv=refresh content='0; url=http://x.com/de/6'>"),
        (6, "http://e.net/", link("/other")), (7, "http://e.net/other", None), (8, "http://x.com/de/7", link("http://x.com/fr/7")), (9, "http://f.net/", link("http://x.com/de/7")),
        (10, "http://g.net/", None),
    ]
    hops = spark.createDataFrame([(f"http://h.net/{i}", f"http://h.net/{i + 1}") for i in range(30)] + [("http://h.net/30", "http://x.com/de/9"), (None, "http://x.com/de/")], "src string, dst string")
    pages = spark.createDataFrame(rows + [(100 + i, f"http://h.net/{i}", None) for i in range(31)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, redirects=hops).collect()}
    assert [got[i] for i in range(1, 11)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert all(got[100 + i] == "block" for i in range(31))


CANON = '<link rel="canonical" href="{}">'


def test_all_links_of_a_page_and_relative_targets(spark):
    cases = [  # page, html, targets as the standard resolver gives them
        ("http://a.net/x/p?q=1#f", CANON.format("fr/2"), ["http://a.net/x/fr/2"]),
        ("http://a.net/x/p?q=1#f", CANON.format("?page=1"), ["http://a.net/x/p?page=1"]),
        ("http://a.net", CANON.format("fr/2"), ["http://a.net/fr/2"]),
        ("https://a.net/x/y/p", CANON.format("../z?a=1&amp;b=2"), ["https://a.net/x/z?a=1&b=2"]),
        ("https://a.net/x/y/p", CANON.format("./"), ["https://a.net/x/y/"]),
        ("https://a.net/x/y/p", CANON.format("/a/../../b/./c"), ["https://a.net/b/c"]),
        ("https://a.net/x/y/p", CANON.format("//b.org/k"), ["https://b.org/k"]),
        ("http://a.net/p", CANON.format("mailto:me@b.org") + CANON.format("#top") + CANON.format(""), []),
        ("no scheme", CANON.format("fr/2"), []),
        (None, CANON.format("http://b.org/"), []),
        ("http://a.net/p", None, []),
        ("http://a.net/p", "<!-- " + CANON.format("http://b.org/1") + "\n--> canonical", []),
        ("http://a.net/p", "<LINK href='http://b.org/1' data-rel=canonical rel='alternate Canonical'><link rel=stylesheet href=/canonical.css>", ["http://b.org/1"]),
        ("http://a.net/p", CANON.format("http://b.org/1") + CANON.format("q") + '<meta http-equiv="refresh" content="0; URL=\'r s\'"><meta content="5;url=t" http-equiv=refresh>',
         ["http://a.net/q", "http://a.net/r s", "http://a.net/t", "http://b.org/1"]),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "n long, url string, html string")
    for i, (_, _, want) in enumerate(cases):
        assert sorted(r["dst"] for r in urls.links_in(pages.where(F.col("n") == i)).collect()) == want, cases[i]
    assert urls.links_in(pages.limit(0)).count() == 0


def test_resolved_targets_equal_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://a.net/b/c/d?q", "https://a.net/b/", "http://a.net", "http://a.net/b/c/d/e/f.html"]
    targets = ["g", "./g", "g/", "/g", "//g/h", "?y", "g?y", "g#s", "..", "../", "../g", "../../g", "../../../../g", "./../g", "g/./h", "g/../h", "g;x=1/../y", "/./g", "/../g", "http://x.org/y"]
    rows = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for r in rows.select("base", "target", urls.resolve(F.col("target"), F.col("base")).alias("got")).collect():
        assert r["got"] == urljoin(r["base"], r["target"]), r


def test_a_refresh_passes_a_block_on_beside_a_canonical_link(spark):
    refresh = "<meta http-equiv=refresh content='0; url=http://x.com/de/6'>"
    rows = [(1, "http://k.net/1", CANON.format("http://k.net/canon") + refresh), (2, "http://k.net/canon", None), (3, "http://www.x.com/fr/", None), (4, "http://k.net/fr/2", CANON.format("3")), (5, "http://k.net/fr/3", CANON.format("http://y.com/de/"))]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}


def test_items_digest():
    assert leaks.items_digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()
