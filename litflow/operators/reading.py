"""Reading lists: filters, statistics, suggestions, reordering, merging, splitting, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litflow.functions.text import blank_to_null, strip
from litflow.operators.history import days_before
from litflow.operators.ranking import number_rows
from litflow.operators.scoring import age_days
from litflow.session import discard, give_back, stored

# Weight of each priority in the next-paper score.
# Points of a priority.
PRIORITY_WEIGHT = {"urgent": 100.0, "high": 50.0, "medium": 20.0, "low": 5.0}


# ---------------------------------------------------------------- filters


def search(
    items: DataFrame, query: str, list_ids: Sequence | None = None,
    statuses: Sequence[str] | None = None, tags: Sequence[str] | None = None,
) -> DataFrame:
    """Substring search over title, abstract and notes; archived lists are skipped."""
    text = F.lower(F.concat_ws(
        " ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("notes", F.lit(""))
    ))
    out = items.where(~F.col("is_archived") & text.contains(query.lower()))
    if list_ids:
        out = out.where(F.col("list_id").isin(*list_ids))
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return out


def by_status(items: DataFrame, status: str) -> DataFrame:
    return items.where(F.col("status") == status)


def by_tag(items: DataFrame, tag: str) -> DataFrame:
    return items.where(F.array_contains("tags", tag))


def by_priority(items: DataFrame, priority: str) -> DataFrame:
    return items.where(F.col("priority") == priority)


def open_lists(lists: DataFrame) -> DataFrame:
    """Lists that are not archived; callers sort by ``updated_at`` when they show them."""
    return lists.where(~F.col("is_archived"))


def default_list(lists: DataFrame) -> DataFrame:
    """Each user's default list: flagged first, then open ones, then the earliest id."""
    w = W.partitionBy("user_id").orderBy(F.col("is_default").desc(), F.col("is_archived"), "list_id")
    return lists.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# ---------------------------------------------------------------- statistics


def list_stats(items: DataFrame, as_of: Column) -> DataFrame:
    """Per-list status counts, completion, reading time, recent finishes, mean rating."""
    st = F.col("status")
    done = st == "finished"
    days = age_days(F.col("finished_at"), F.col("started_at"))
    s = items.groupBy("list_id").agg(
        F.count("*").alias("total_papers"),
        *[F.count_if(st == name).alias(name) for name in ("to_read", "reading", "finished", "skipped", "reference")],
        F.avg(F.when(done, days)).alias("avg_days_to_finish"),
        F.count_if(done & (F.col("finished_at") >= days_before(as_of, 7))).alias("finished_week"),
        F.count_if(done & (F.col("finished_at") >= F.add_months(as_of, -1))).alias("finished_month"),
        F.avg("rating").alias("avg_rating"),
    )
    return s.withColumn("completion_rate", F.col("finished") / F.col("total_papers"))


def top_tags(items: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most used tags of every list, ties by tag."""
    counts = items.select("list_id", F.explode("tags").alias("tag")).groupBy("list_id", "tag").count()
    w = W.partitionBy("list_id").orderBy(F.col("count").desc(), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def global_stats(items: DataFrame, lists: DataFrame) -> DataFrame:
    """One row over all open lists. A rating of zero does not count."""
    st = F.col("status")
    s = items.where(~F.col("is_archived")).agg(
        F.count("*").alias("total_papers"),
        *[F.count_if(st == name).alias(name) for name in ("to_read", "reading", "finished", "skipped")],
        F.avg(F.when(F.col("rating") != 0, F.col("rating"))).alias("avg_rating"),
    )
    n = open_lists(lists).select(F.count("*")).scalar()
    return s.withColumns({
        "total_lists": n,
        "completion_rate": F.coalesce(F.try_divide("finished", "total_papers"), F.lit(0.0)),
    })


def global_top_tags(items: DataFrame, n: int = 20, per_list: int = 10) -> DataFrame:
    """Tag totals summed from each open list's own top tags."""
    per = top_tags(items.where(~F.col("is_archived")), per_list)
    return per.groupBy("tag").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "tag").limit(n)


def next_paper_score(as_of: Column) -> Column:
    weight = F.coalesce(
        F.try_element_at(
            F.create_map(*[x for k, v in PRIORITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))]),
            F.col("priority"),
        ),
        F.lit(20.0),
    )
    left = age_days(F.col("due_date"), as_of)
    # Points for what is due soon, for relevance and for waiting.
    due = (
        F.when(F.col("due_date").isNull(), 0.0).when(left < 0, 200.0).when(left < 7, 50.0)
        .when(left < 30, 20.0).otherwise(0.0)
    )
    relevance = F.coalesce(F.col("relevance_score") * 0.5, F.lit(0.0))
    waiting = F.least(age_days(as_of, F.col("added_at")) * 0.5, F.lit(20.0))
    return weight + due + relevance + waiting


def suggest_next(items: DataFrame, as_of: Column, by: Sequence[str] = ("user_id",), tie: Sequence[str] = ("item_id",)) -> DataFrame:
    """The unread item with the highest score per user (or list)."""
    w = W.partitionBy(*by).orderBy(F.col("next_score").desc(), *tie)
    return (
        items.where((F.col("status") == "to_read") & ~F.col("is_archived"))
        .withColumn("next_score", next_paper_score(as_of))
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    )


# ---------------------------------------------------------------- list operations


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by an aggregate, not a window, so a group of copies is combined map-side."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(
        F.min_by(whole, F.struct(*[F.col(o) for o in order])).alias("_row")
    )
    return first.select("_row.*")


def add_new(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Incoming items that a list does not hold yet, by paper id or by title; first one wins."""
    fresh = stored(incoming.join(existing.select("list_id", "paper_id"), ["list_id", "paper_id"], "left_anti"))
    give_back()
    fresh = fresh.join(existing.select("list_id", "title"), ["list_id", "title"], "left_anti")
    return distinct_items(fresh, order)


def distinct_items(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Items of each list without repeated paper ids or titles, first in order wins.

    Equal (id, title) copies collapse first. An item then stays unless an earlier kept item has its
    id or its title, which is the first-come greedy choice. Items that share neither stay without taking part in it.
    """
    from litflow.operators.independent_set import greedy_representatives

    once = stored(first_of_each(items, ["list_id", "paper_id", "title"], order))
    give_back()

    def shared(column: str) -> DataFrame:
        many = once.where(F.col(column).isNotNull()).groupBy("list_id", column).agg(F.count("*").alias("_n")).where("_n > 1")
        return many.select(F.col("list_id").alias(f"_list_{column}"), F.col(column).alias(f"_{column}"))

    def met(column: str) -> Column:
        return F.col("list_id").eqNullSafe(F.col(f"_list_{column}")) & (F.col(column) == F.col(f"_{column}"))

    # a missing list is one of its own, and a missing id or title conflicts with nothing
    marked = once.join(shared("paper_id"), met("paper_id"), "left").join(shared("title"), met("title"), "left").withColumn(
        "_contested", F.col("_paper_id").isNotNull() | F.col("_title").isNotNull()).select(*once.columns, "_contested")
    marked = stored(marked)
    discard(once)
    give_back()
    alone = marked.where("not _contested").drop("_contested")
    item = F.to_json(F.struct("list_id", "paper_id", "title"))
    keyed = marked.where("_contested").drop("_contested").withColumn("_node", item).withColumn("_ord", F.struct(*[F.col(o) for o in order]))
    groups = keyed.select(
        F.col("_node").alias("node"), F.col("_ord").alias("ord"),
        F.explode(F.array_compact(F.array(  # a missing id or title conflicts with nothing; an item always has its own group
            F.concat(F.lit("item"), item),
            F.when(F.col("paper_id").isNotNull(), F.concat(F.lit("id"), F.to_json(F.struct("list_id", "paper_id")))),
            F.when(F.col("title").isNotNull(), F.concat(F.lit("title"), F.to_json(F.struct("list_id", "title")))),
        ))).alias("grp"),
    )
    leaders = greedy_representatives(groups).where("is_leader").select(F.col("node").alias("_node"))
    return alone.unionByName(keyed.join(leaders, "_node", "left_semi").drop("_node", "_ord"))


def reorder(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """New positions: items named in ``wanted(list_id, item_id, want)`` first, the rest keep order. A list is one
    user's and is ordered in one task."""
    named = items.join(wanted, ["list_id", "item_id"], "left")
    place = F.row_number().over(W.partitionBy("list_id").orderBy(F.col("want").asc_nulls_last(), "position")) - 1
    return named.withColumn("position", place).drop("want")


def renumber(items: DataFrame) -> DataFrame:
    """Positions 0..n-1 per list after removals."""
    return items.withColumn("position", F.row_number().over(W.partitionBy("list_id").orderBy("position")) - 1)


def merge_lists(items: DataFrame, target: str, order: Sequence[str]) -> DataFrame:
    """All given lists as one: a ``from:`` tag per source list, duplicates dropped.

    Items are added afresh: without dates of reading, rating and highlights, and in positions counted from 0.
    """
    void = {c: F.lit(None).cast(items.schema[c].dataType) for c in ("started_at", "finished_at", "rating", "highlights") if c in items.columns}
    tagged = items.withColumns({
        **void,
        "tags": F.array_append("tags", F.concat(F.lit("from:"), F.col("list_name"))),
        "source": F.coalesce(blank_to_null(F.col("source")), F.col("list_name")),
        "list_id": F.lit(target),
    })
    # the positions that the order is by are those of the lists before
    kept = distinct_items(tagged, order)
    return number_rows(kept, order, "_place").withColumn("position", F.col("_place").cast("int")).drop("_place")


def move_items(items: DataFrame, picked: Column, target: Column) -> DataFrame:
    """Picked items leave their list for ``target`` with their reading state, after what it holds; both are renumbered."""
    moved = items.withColumns({
        "_moved": F.coalesce(picked, F.lit(False)), "_from": F.col("list_id"), "_at": F.col("position"),
    }).withColumn("list_id", F.when(F.col("_moved"), target).otherwise(F.col("list_id")))
    place = F.row_number().over(W.partitionBy("list_id").orderBy("_moved", "_from", "_at", "item_id")) - 1
    return moved.withColumn("position", place).drop("_moved", "_from", "_at")


def tag_union(items: DataFrame) -> DataFrame:
    """``(list_id, tags)``: the distinct tags of a list's items, sorted; made distinct before they are gathered."""
    tags = items.select("list_id", F.explode("tags").alias("tag")).distinct()
    return tags.groupBy("list_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def split_by_tag(items: DataFrame, tag: str, new_list: Column) -> DataFrame:
    """Items that carry ``tag`` move to ``new_list``; the others stay."""
    return items.withColumn("list_id", F.when(F.array_contains("tags", tag), new_list).otherwise(F.col("list_id")))


def copy_items(items: DataFrame, picked: Column, target: Column, order: Sequence[str]) -> DataFrame:
    """Adds copies of the picked items to ``target`` unless it holds them; reading state is reset."""
    void = F.lit(None)
    copies = items.where(picked).withColumns({
        "source": F.concat(F.lit("Copied from "), F.col("list_name")),
        "list_id": target,
        "started_at": void.cast("timestamp"), "finished_at": void.cast("timestamp"), "rating": void.cast("int"),
    })
    return items.unionByName(add_new(items, copies, order))


# ---------------------------------------------------------------- text exports


def _braces_free(c: Column, limit: int) -> Column:
    return F.substring(F.translate(F.regexp_replace(c, "\n", " "), "{}", ""), 1, limit)


def bibtex(items: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """One BibTeX record per item, in column ``value``."""
    author = F.coalesce(
        blank_to_null(F.element_at(F.split(strip(F.get("authors", F.lit(0))), r"\s+"), -1)), F.lit("Unknown")
    )
    word = F.coalesce(blank_to_null(F.get(F.split(strip(F.col("title")), r"\s+"), F.lit(0))), F.lit("paper"))
    key = F.lower(F.concat(author, F.year("added_at").cast("string"), word))

    def entry(name: str, value: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    fields = F.concat_ws(
        ",\n",
        entry("title", F.col("title"), F.lit(True)),
        entry("author", F.array_join("authors", " and "), F.size("authors") > 0),
        entry("doi", F.col("doi"), given("doi")),
        entry("url", F.col("url"), given("url")),
        entry("eprint", F.col("arxiv_id"), given("arxiv_id")),
        entry("archiveprefix", F.lit("arXiv"), given("arxiv_id")),
        entry("abstract", _braces_free(F.col("abstract"), 500), given("abstract")),
        entry("note", _braces_free(F.col("notes"), 200), given("notes")),
        entry("keywords", F.array_join("tags", ", "), F.size("tags") > 0),
    )
    value = F.concat(F.lit("@article{"), key, F.lit(",\n"), fields, F.lit("\n}"))
    return items.select("list_id", *order, value.alias("value"))


def ris(items: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """One RIS record per item, in column ``value``."""

    def line(tag: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c))

    def lines(tag: str, c: str) -> Column:
        return F.when(
            F.size(c) > 0, F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(f"{tag}  - "), x)), "\n")
        )

    value = F.concat_ws(
        "\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), F.col("title")), lines("AU", "authors"),
        line("DO", F.col("doi")), line("UR", F.col("url")), line("AB", F.substring("abstract", 1, 1000)),
        lines("KW", "tags"), line("N1", F.substring("notes", 1, 500)), F.lit("ER  -"),
    )
    return items.select("list_id", *order, value.alias("value"))


ITEM_FIELDS = (
    "item_id", "paper_id", "title", "authors", "abstract", "url", "doi", "arxiv_id", "status", "priority",
    "added_at", "notes", "tags", "rating", "position", "relevance_score",
)


def item_json(items: DataFrame) -> DataFrame:
    """JSON record per item: the row form of a list export, so a huge list is never one string."""
    return items.select(
        "list_id", "position", F.to_json(F.struct(*[F.col(c) for c in ITEM_FIELDS])).alias("value")
    )


def import_items(records: DataFrame, owner: Column, schema: str) -> DataFrame:
    """Items from ``item_json`` records under a new list id derived from the old one and its owner."""
    new_id = F.substring(F.sha2(F.concat_ws("|", owner, F.col("list_id").cast("string"), F.lit("import")), 256), 1, 8)
    parsed = records.select(new_id.alias("list_id"), F.from_json("value", schema).alias("r"))
    r = parsed.where(F.col("r").isNotNull()).select("list_id", "r.*")
    return r.withColumns({
        "status": F.coalesce("status", F.lit("to_read")),
        "priority": F.coalesce("priority", F.lit("medium")),
        "position": F.coalesce("position", F.lit(0)),
    })
