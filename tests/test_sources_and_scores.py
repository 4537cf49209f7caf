"""Landed feeds, catalogue, name matching and scores with hand-computed values."""

import itertools
import math
import random
import tracemalloc
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litflow.functions import keys, text, vectors
from litflow.operators import scoring, selection, tfidf
from litflow.operators.scoring import Interest, ScoringConfig
from litflow.sources import feeds, records

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/">
<channel><title>Letters on Tides</title>
<item><title>Ebb rates in narrow bays</title><link>https://tides.example/papers/10.5555/tide.31</link>
<description>&lt;p&gt;Water left &lt;em&gt;seven&lt;/em&gt; bays faster than it came; gauges of four winters say when and why.&lt;/p&gt;</description>
<dc:creator>Ida Quell</dc:creator><dc:creator> </dc:creator><dc:creator>Tomas Ferro</dc:creator><prism:doi>10.5555/tide.31</prism:doi>
<prism:publicationName>Letters on Tides</prism:publicationName><pubDate>Thursday, 3 Oct 2019 07:45 GMT</pubDate></item>
<item><title>Errata</title><link>https://doi.org/10.5555/tide.32</link><description>none</description><pubDate>soon</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Kites</title>
<entry><title>Kite lines under load</title><link href="https://kites.example/10.5555/kite.8"/><summary>few words</summary>
<author><name>Noor Adeyemi</name></author><author><name/></author><published>2021-06-30 18:05:09.25+02:00</published></entry></feed>"""
PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">4711</PMID><Article>
<Journal><JournalIssue><PubDate><Year>2018</Year><Month>Nov</Month><Day>31</Day></PubDate></JournalIssue><Title>Acta Moss</Title></Journal>
<ArticleTitle><i>Sphagnum</i> and H<sub>2</sub>O</ArticleTitle><Abstract><AbstractText Label="AIM">Mats of <i>S. fallax</i> were wetted.</AbstractText><AbstractText>They <b>grew</b> by 10<sup>2</sup> %.</AbstractText></Abstract>
<AuthorList><Author><LastName>Okafor</LastName><ForeName>Lise</ForeName></Author><Author><CollectiveName>Moss Group</CollectiveName></Author></AuthorList>
</Article><MeshHeadingList><MeshHeading><DescriptorName UI="D9">Bogs</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">4711</ArticleId><ArticleId IdType="doi">10.5555/moss.2</ArticleId></ArticleIdList></PubmedData>
</PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">4712</PMID><Article><ArticleTitle>cut off"""


def _land(tmp_path, name, text):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "feed.xml").write_text(text)
    return str(folder)


def test_rss_files(spark, tmp_path):
    a, b = records.read(spark, "rss", _land(tmp_path, "rss", RSS), journal="Fallback").orderBy("doi").collect()
    assert (a.title, a.doi, a.journal) == ("Ebb rates in narrow bays", "10.5555/tide.31", "Letters on Tides")
    assert a.authors[0] == "Ida Quell" and a.authors[-1] == "Tomas Ferro"
    assert a.abstract.startswith("Water left seven bays") and a.published_date.isoformat() == "2019-10-03T07:45:00"
    assert (b.doi, b.url, b.abstract, b.journal, b.published_date) == ("10.5555/tide.32", "https://doi.org/10.5555/tide.32", None, "Fallback", None)


def test_atom_and_pubmed_files(spark, tmp_path):
    a = records.read(spark, "atom", _land(tmp_path, "atom", ATOM)).first()
    assert (a.title, a.authors, a.abstract) == ("Kite lines under load", ["Noor Adeyemi"], None)
    assert a.published_date.isoformat() == "2021-06-30T16:05:09.250000"
    p, broken = records.read(spark, "pubmed", _land(tmp_path, "pubmed", PUBMED)).orderBy(F.desc("is_valid")).collect()
    assert (p.title, p.pubmed_id, p.authors, p.doi) == ("Sphagnum and H2O", "4711", ["Lise Okafor"], "10.5555/moss.2")
    assert p.abstract == "AIM: Mats of S. fallax were wetted. They grew by 102 %."
    assert p.published_date.isoformat() == "2018-11-01T00:00:00" and p.fields_of_study == ["Bogs"] and not broken.is_valid


def test_date_layouts(spark):
    given = {
        "2024-01-17T00:00:00.123Z": "2024-01-17T00:00:00.123000", "2024-01-17 10:00:00": "2024-01-17T10:00:00", "January 17, 2024": "2024-01-17T00:00:00",
        "Wed, 17 Jan 2024 10:00 GMT": "2024-01-17T10:00:00", "Wed, 17 Jan 2024 10:00:00 +0200": "2024-01-17T08:00:00", "17 January 2024": "2024-01-17T00:00:00",
        "2024": "2024-01-01T00:00:00", "2024-03": "2024-03-01T00:00:00", "Mar 2024": "2024-03-01T00:00:00", "next week": None, "10:00": None,
    }
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", text.parse_date(F.col("s")).alias("d")).collect()
    assert {r.s: r.d.isoformat() if r.d else None for r in rows} == given


def test_failing_scorers_count_as_one_half(spark):
    def broken(p, i, c):
        raise ValueError("no")

    fragile = scoring.guarded(lambda s: s.map(lambda x: 1.0 / (len(x) - 3)))
    scoring.register_scorer("broken", broken)
    scoring.register_scorer("fragile", lambda p, i, c: fragile(p.row("title")))
    try:
        papers = spark.createDataFrame([(1, "abc", "x", ["A B"]), (2, "abcd", "x", ["A B"])], "paper_id int, title string, abstract string, authors array<string>")
        cfg = ScoringConfig(weights={"broken": 0.5, "fragile": 0.5})
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = {r.paper_id: (r.broken_score, r.fragile_score) for r in scoring.score_papers(papers, [Interest("i", "n")], "2024-01-01", cfg).collect()}
        assert got == {1: (0.5, 0.5), 2: (0.5, 1.0)}
    finally:
        scoring.SCORERS.pop("broken")
        scoring.SCORERS.pop("fragile")


def test_stored_vectors_meet_stored_vectors_only(spark):
    papers = spark.createDataFrame([(1, "graph", "", [1.0, 0.0]), (2, "graph", "", None), (3, "graph", "", [1.0])], "paper_id int, title string, abstract string, embedding array<float>").withColumn("authors", F.array().cast("array<string>"))
    cfg = ScoringConfig(weights={"semantic": 1.0})
    plain = {r.paper_id: r.semantic_score for r in scoring.score_papers(papers.drop("embedding"), [Interest("i", "graph")], "2024-01-01", cfg).collect()}
    got = {r.paper_id: r.semantic_score for r in scoring.score_papers(papers, [Interest("i", "graph", embedding=(0.6, 0.8))], "2024-01-01", cfg).collect()}
    assert got[1] == pytest.approx(min(1.0, 0.6 * 2.5)) and got[2] == plain[2] and got[3] == plain[3]


def test_feed_without_entries_is_not_valid(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "feed_id string")
    rec = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "feed_id string, is_valid boolean")
    got = {r.feed_id: (r.is_valid, r.error) for r in feeds.validity(known, rec).collect()}
    assert got == {"a": (True, None), "b": (False, "Feed parsing error"), "c": (False, "Feed contains no entries")}


def test_catalogue(spark):
    c = feeds.catalogue(spark)
    assert c.count() == 20
    assert feeds.bundle(c, "ml_chemistry").count() == 3 and feeds.bundle(c, "polymer_md").count() == 6
    assert feeds.by_codes(c, ["jctc", "nope"]).first().journal_code == "jctcce"
    assert "jctc" in {r.code for r in feeds.by_category(c, "machine-learning").collect()}
    assert feeds.feed_urls(feeds.by_codes(c, ["jctc"])).first().url.endswith("jc=jctcce")


@pytest.mark.parametrize("a,b,same", [
    ("J. Smith", "John Smith", True), ("Smith, J.", "John Smith", True), ("Jane Smith", "John Smith", False),
    ("John Smith Jr.", "john  smith", True), ("Smith", "John Smith", True), ("John Smith", "John Smyth", False)])
def test_author_names(spark, a, b, same):
    df = spark.range(1).select(scoring.parsed_authors(F.array(F.lit(a))).alias("p"))
    assert bool(df.select(scoring.matched_authors(F.col("p"), [b]).alias("m")).first().m) is same


def test_scores_by_hand(spark):
    row = spark.range(1).select(
        scoring.keyword_score(F.lit(1), F.lit(1), 4).alias("k"), scoring.citation_score(F.lit(0), F.lit(0)).alias("c0"),
        scoring.citation_score(F.lit(200), F.lit(100)).alias("c1"), scoring.field_score(F.array(F.lit("A"), F.lit("b")), ["a"]).alias("f"),
        scoring.recency_score(F.lit("2024-01-31").cast("timestamp"), F.lit(2024), F.lit("2024-01-31").cast("timestamp"), ScoringConfig()).alias("r"),
        vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos")).first()
    assert row.k == pytest.approx(0.3) and row.c0 == pytest.approx(0.34) and row.c1 == 1.0
    assert row.f == pytest.approx(0.4 * 0.5 + 0.6) and row.r == 1.0 and row.cos == pytest.approx(math.sqrt(0.5))


def test_embedding_and_pair_tfidf():
    v = vectors.hashed_embedding("Graph neural networks")
    assert abs(float((v * v).sum()) - 1) < 1e-9
    near = float(v @ vectors.hashed_embedding("graph neural models"))
    assert near > float(v @ vectors.hashed_embedding("polymer chain physics"))
    t = scoring.pair_terms(scoring.pair_tokens("graph model graph"))
    assert t["graph"] == 2 and t["graph model"] == 1 and scoring.pair_tfidf(t, t) == pytest.approx(1.0)


def test_scoring_holds_no_words_and_small_batches(spark):
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=5), 20_000)]
    vectors.hashed_embedding("abc")
    tracemalloc.start()
    for lo in range(0, len(words), 500):
        vectors.hashed_embedding(" ".join(words[lo : lo + 500]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, 10_000)
    papers = spark.createDataFrame([(1, "a", "b", ["A"])], "paper_id long, title string, abstract string, authors array<string>")
    scoring.score_papers(papers, [Interest("i", "n")], "2024-01-01", ScoringConfig(weights={"tfidf": 1.0}, disabled=frozenset(ScoringConfig().weights) - {"tfidf"}))
    assert int(spark.conf.get(rows)) <= 1_000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_pair_tfidf_by_ranks_matches_whole_vectors():
    rng = random.Random(6)
    for _ in range(400):
        words = [f"w{i}" for i in range(rng.choice((3, 12, 40)))]
        paper = Counter(rng.choices(words, k=rng.randrange(0, 60)))
        other = Counter(rng.choices(words, k=rng.randrange(0, 15)))
        for most in (2, 5, 11, 1000):
            vocab = sorted(set(paper) | set(other), key=lambda t: (-paper[t] - other[t], t))[:most]
            idf = {t: 1.0 if paper[t] and other[t] else math.log(1.5) + 1.0 for t in vocab}
            dot = sum(paper[t] * other[t] * idf[t] ** 2 for t in vocab)
            size = [math.sqrt(sum((c[t] * idf[t]) ** 2 for t in vocab)) for c in (paper, other)]
            want = 0.5 if not paper and not other else dot / (size[0] * size[1]) if dot else 0.0
            assert abs(scoring.pair_tfidf(paper, other, most) - want) < 1e-12


def test_interest_batches_and_registry(spark):
    p = spark.createDataFrame([(1, "polymer graph", "x", [])], "paper_id int, title string, abstract string, authors array<string>").withColumns({
        "citation_count": F.lit(5), "influential_citation_count": F.lit(0), "published_date": F.lit(None).cast("timestamp"),
        "year": F.lit(None).cast("int"), "fields_of_study": F.array(F.lit("a")), "journal": F.lit("J")})
    many = [Interest(f"i{n:03d}", f"name {n}", keywords=("polymer",), ord=n) for n in range(70)]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        s = scoring.score_papers(p, many, "2024-01-31 00:00:00")
    assert s.count() == 70 and s.where("keyword_score = 1.0").count() == 70
    with pytest.warns(UserWarning):
        ScoringConfig(disabled=frozenset({"semantic"})).validate()


def test_tfidf_model_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "graph model"), (2, "graph energy"), (3, "polymer energy")], "id int, t string")
    tfidf.save(tfidf.fit(d, "id", F.col("t")), str(tmp_path / "m"))
    m = {r.term: r.idf for r in tfidf.load(spark, str(tmp_path / "m")).collect()}
    assert m["graph"] == pytest.approx(math.log(4 / 3) + 1) and "graph model" in m


def test_content_hash_identity(spark):
    cols = ["doi", "s2", "pmid", "arxiv", "title"]
    rows = [("10.1/a", None, None, None, "T", ["A"]), ("10.1/a", "s", None, None, "U", ["B"]), (None, None, None, None, "Same", ["Ann"]), ("", None, None, None, "SAME", ["ANN"])]
    df = spark.createDataFrame(rows, "doi string, s2 string, pmid string, arxiv string, title string, authors array<string>")
    h = [r.h for r in df.select(keys.content_hash(*[F.col(c) for c in cols], F.col("authors")).alias("h")).collect()]
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_python_scorers_are_isolated_without_a_wrapper(spark):
    def fragile(rows, interest, cfg):
        return rows["text"].map(lambda t: 1.0 / (len(t) - 3)) * float(interest.name)

    scoring.register_python_scorer("fragile", ["text", "paper_id"], fragile)
    try:
        papers = spark.createDataFrame([(1, "ab", ""), (2, "abcd", ""), (3, "abc", None)], "paper_id int, title string, abstract string").withColumn("authors", F.array().cast("array<string>"))
        cfg = ScoringConfig(weights={"fragile": 1.0})
        got = {(r.paper_id, r.interest_id): r.fragile_score for r in scoring.score_papers(papers, [Interest("i", "1"), Interest("j", "0.5"), Interest("k", "no number")], "2024-01-01", cfg).collect()}
        size = {r.paper_id: r.n for r in papers.select("paper_id", F.length(text.joined_text(F.col("title"), F.col("abstract"))).alias("n")).collect()}
        for n, chars in size.items():
            want = 0.5 if chars == 3 else 1.0 / (chars - 3)
            assert got[n, "i"] == pytest.approx(want) and got[n, "k"] == 0.5
            assert got[n, "j"] == pytest.approx(0.5 if chars == 3 else want / 2)
    finally:
        scoring.SCORERS.pop("fragile")


def test_embedding_backlog_takes_what_is_missing_in_batches(spark):
    def model(texts):
        assert len(texts) <= 4
        return [[len(t), 1.0] for t in texts]

    papers = spark.createDataFrame([(i, "t" * i, None if i % 2 else "") for i in range(20)], "paper_id int, title string, abstract string")
    held = spark.createDataFrame([(3, [1.0]), (4, None)], "paper_id int, embedding array<float>")
    got = {r.paper_id: list(r.embedding) for r in selection.embed_missing(papers, held, model, batch=4).collect()}
    assert got == {i: [float(i), 1.0] for i in range(20) if i != 3}
    assert sorted(r.paper_id for r in selection.embed_missing(papers, held, model, limit=3, batch=4).collect()) == [0, 1, 2]
    assert selection.embed_missing(papers.limit(0), held, model).count() == 0
