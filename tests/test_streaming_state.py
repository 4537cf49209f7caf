"""Folded item state, alerts with a moving clock, and numbering of whole tables against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from litflow.operators import ranking, reading
from litflow.operators.scoring import Interest, ScoringConfig, score_papers
from litflow.streaming import jobs

LOG = "item_id long, kind string, value string, ts timestamp, seq long"
DAY = datetime(2024, 1, 1)


def folded_by_loop(rows):
    state = {}
    for item, kind, value, ts, seq in sorted(rows, key=lambda r: (r[3], r[4])):
        s = state.setdefault(item, {"tags": set(), "status": None, "rating": None, "n_notes": 0, "n_highlights": 0})
        if kind == "tag" and value:
            s["tags"].add(value)
        elif kind == "untag":
            s["tags"].discard(value)
        elif kind in ("status", "rating"):
            s[kind] = value
        elif kind in ("note", "highlight"):
            s[f"n_{kind}s"] += 1
    return {i: {**s, "tags": sorted(s["tags"])} for i, s in state.items()}


def seen(df):
    return {r["item_id"]: {k: r[k] for k in ("tags", "status", "rating", "n_notes", "n_highlights")} for r in df.collect()}


def events(n=400):
    rng = random.Random(5)
    kinds = ("tag", "tag", "untag", "status", "rating", "note", "highlight")
    # a third of all events are of one item; several share an instant and are told apart by their number
    rows = [(1 if i % 3 == 0 else rng.randrange(8), k, f"{k[0] if k != 'untag' else 't'}{rng.randrange(4)}", DAY + timedelta(minutes=rng.randrange(60)), i)
            for i, k in enumerate(rng.choices(kinds, k=n))]
    return rows + [(9, "tag", None, DAY, n), (9, "tag", "", DAY, n + 1), (9, "untag", "never held", DAY, n + 2), (9, "note", "x", DAY, n + 3)]


def test_tags_and_attributes_fold_to_the_latest(spark):
    rows = events()
    random.Random(1).shuffle(rows)
    assert seen(jobs.item_state(spark.createDataFrame(rows, LOG))) == folded_by_loop(rows)
    assert jobs.item_state(spark.createDataFrame([], LOG)).count() == 0


def test_events_out_of_order_over_four_batches_and_a_restart(spark, tmp_path):
    rows = events()
    random.Random(2).shuffle(rows)  # adds and removals of one tag arrive in any order
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    for lo, hi in ((0, 100), (100, 230), (230, 300), (300, len(rows))):
        spark.createDataFrame(rows[lo:hi], LOG).coalesce(1).write.mode("append").parquet(landed)
        # every run starts a new query from the checkpoint of the one before
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.run_to(jobs.item_parts(stream), out, "update")
        now = jobs.folded(jobs.latest_state(jobs.read_out(spark, out), "item_id", "tag"))
        assert seen(now) == folded_by_loop(rows[:hi])


PAPER = "paper_id long, title string, abstract string, authors array<string>, journal string, fields_of_study array<string>, citation_count int, influential_citation_count int, published_date timestamp, year int, created_at timestamp"


def paper(n, created):
    return (n, "Tidal models", "we present tidal models", ["A. Writer"], "J", ["Physics"], 3, 0, DAY, 2024, created)


def test_alerts_are_judged_by_the_time_of_their_batch(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    interest = [Interest("i", "Tidal models", keywords=("tidal",))]
    cfg = ScoringConfig(weights={"recency": 1.0})
    clock = []
    # the third batch is older than the second one's clock, but within the look-back
    for n, created in ((1, DAY + timedelta(days=1)), (2, DAY + timedelta(days=200)), (3, DAY + timedelta(days=190))):
        clock.append(max(created, *clock) if clock else created)
        spark.createDataFrame([paper(n, created), paper(n, created)], PAPER).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(PAPER).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.run_alerts(stream, out, interest, min_score=0.0, cfg=cfg, lookback="30 days")
    got = {r["paper_id"]: r for r in jobs.read_out(spark, out).collect()}
    assert sorted(got) == [1, 2, 3]
    for n, at in enumerate(clock, 1):
        want = score_papers(spark.createDataFrame([paper(n, at)], PAPER), interest, F.lit(at), cfg).first()
        assert got[n]["as_of"] == at and got[n]["total_score"] == pytest.approx(want["total_score"])
    assert got[1]["total_score"] > 0.9 > 0.3 > got[2]["total_score"] == got[3]["total_score"]


def test_rows_of_a_whole_table_are_numbered(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.0, 1.0, 1.0, 2.5]), i) for i in rng.sample(range(3000), 2000)]  # one value holds most rows
    df = spark.createDataFrame(rows, "v double, i long").repartition(5)
    up = {r["i"]: r["position"] for r in ranking.number_rows(df, ["v", "i"]).collect()}
    by = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert up == {i: n for n, (_, i) in enumerate(by)}
    down = {r["i"]: r["place"] for r in ranking.number_rows(df, [F.col("v").desc(), F.col("i")], "place", first=1).collect()}
    by = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert down == {i: n for n, (_, i) in enumerate(by, 1)}
    assert ranking.number_rows(df.limit(0), ["v"]).count() == 0


def test_merged_lists_count_on_from_zero(spark):
    rows = [(1, "a", 1, "p1", "t1", 0, ["x"], ""), (1, "a", 2, "p2", "t2", 1, [], "s"), (2, "b", 3, "p1", "t9", 0, [], ""), (2, "b", 4, "p4", "t4", 1, [], None)]
    items = spark.createDataFrame(rows, "list_id long, list_name string, item_id long, paper_id string, title string, position int, tags array<string>, source string")
    got = sorted((r["position"], r["item_id"], r["tags"], r["source"]) for r in reading.merge_lists(items, "m", ["list_name", "position", "item_id"]).collect())
    assert got == [(0, 1, ["x", "from:a"], "a"), (1, 2, ["from:a"], "s"), (2, 4, ["from:b"], "b")]


def test_a_landed_table_keeps_its_partitions(spark, tmp_path, monkeypatch):
    landed = str(tmp_path / "landed")
    monkeypatch.setattr(jobs, "scratch_path", lambda *_: landed)
    table = spark.range(0, 2400, 1, 12)
    stream = jobs.landed_stream(table, 3, table.where("id % 6 = 0"))
    files = spark.read.parquet(landed).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 16 and max(r["count"] for r in files) <= 250  # no task holds a third of the table
    jobs.run_to(stream, str(tmp_path / "out"))
    sizes = jobs.read_out(spark, str(tmp_path / "out")).groupBy(jobs.BATCH).count().orderBy(jobs.BATCH).collect()
    assert len(sizes) == 4 and sizes[-1]["count"] == 400 and sum(r["count"] for r in sizes) == 2800


@pytest.mark.parametrize(("size", "slide"), [("1 day", None), ("3 days", "1 day"), ("3 days", "2 days")])
def test_timeline_without_state_counts_every_row(spark, tmp_path, size, slide):
    words = ("glacier", "sediment", "monsoon", "aquifer")
    rng = random.Random(3)
    # the second half is 40 days older than the first: a watermark of two days would drop it
    rows = [(f"{rng.choice(words)} {rng.choice(words)}", rng.choice(words), DAY - timedelta(days=40 * (i >= 30), hours=rng.randrange(96))) for i in range(60)]
    df = spark.createDataFrame(rows, "title string, abstract string, created_at timestamp")
    landed = jobs.scratch_path(spark, "rows")
    df.limit(30).coalesce(1).write.parquet(landed)
    df.offset(30).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    jobs.run_timeline(stream, str(tmp_path / "line"), size=size, slide=slide)
    got = {(r["window_start"], r["term"]): r["n"] for r in jobs.timeline(jobs.read_out(spark, str(tmp_path / "line")), size, slide).collect()}
    step, long = (timedelta(days=int(x[0])) for x in (slide or size, size))
    wanted = {}
    for title, abstract, at in rows:
        t = [*title.split(), abstract]
        start = datetime(1970, 1, 1) + (at - datetime(1970, 1, 1)) // step * step
        while start > at - long:
            for term in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]:
                wanted[start, term] = wanted.get((start, term), 0) + 1
            start -= step
    assert got == wanted
