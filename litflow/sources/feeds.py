"""Feed catalogue, fetch bookkeeping, validity and collection summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Feed code, journal code, journal name, categories.
CATALOGUE = (
    ("acsami", "aamick", "ACS Applied Materials & Interfaces", ("materials", "interfaces", "polymers",)),
    ("acsapm", "aapmcd", "ACS Applied Polymer Materials", ("polymers", "materials",)),
    ("macromolecules", "mamobx", "Macromolecules", ("polymers", "theory", "synthesis",)),
    ("biomac", "bomaf6", "Biomacromolecules", ("polymers", "biomaterials",)),
    ("langmuir", "langd5", "Langmuir", ("surfaces", "interfaces", "soft-matter",)),
    ("nanoletters", "nalefd", "Nano Letters", ("nanomaterials", "materials",)),
    ("acsnano", "ancac3", "ACS Nano", ("nanomaterials", "materials",)),
    ("chemmater", "cmatex", "Chemistry of Materials", ("materials", "synthesis",)),
    ("jpcb", "jpcbfk", "J. Physical Chemistry B", ("physical-chemistry", "soft-matter", "polymers", "simulations",)),
    ("jpca", "jpcafh", "J. Physical Chemistry A", ("physical-chemistry", "spectroscopy", "theory",)),
    ("jpcc", "jpccck", "J. Physical Chemistry C", ("physical-chemistry", "surfaces", "nanomaterials",)),
    ("jpclett", "jpclcd", "J. Physical Chemistry Letters", ("physical-chemistry", "theory",)),
    ("jctc", "jctcce", "J. Chemical Theory and Computation", ("computation", "simulations", "machine-learning", "theory",)),
    ("jcim", "jcisd8", "J. Chemical Information and Modeling", ("computation", "machine-learning", "modeling",)),
    ("jacs", "jacsat", "J. American Chemical Society", ("general", "synthesis", "materials",)),
    ("acscentral", "acscii", "ACS Central Science", ("general", "multidisciplinary",)),
    ("acsenergyletter", "aelccp", "ACS Energy Letters", ("energy", "materials",)),
    ("acsaem", "aaemcq", "ACS Applied Energy Materials", ("energy", "materials",)),
    ("acscatal", "accacs", "ACS Catalysis", ("catalysis", "materials",)),
    ("suschemeng", "ascecg", "ACS Sustainable Chemistry & Engineering", ("sustainability", "green-chemistry",)),
)
# Curated bundles of feed codes, and the feed address.
BUNDLES = {
    "polymer_md": ("jctc", "jpcb", "macromolecules", "acsapm", "langmuir", "jcim"),
    "ml_chemistry": ("jctc", "jcim", "jpclett"),
}
FEED_URL = "https://pubs.acs.org/action/showFeed?type=axatoc&feed=rss&jc="


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(code, journal, name, list(cats)) for code, journal, name, cats in CATALOGUE]
    return spark.createDataFrame(rows, "code string, journal_code string, journal_name string, categories array<string>")


def by_category(feeds: DataFrame, category: str) -> DataFrame:
    return feeds.where(F.array_contains("categories", category))


def by_codes(feeds: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Feeds with the given codes; unknown codes drop out."""
    return feeds.where(F.col("code").isin(*codes))


def bundle(feeds: DataFrame, name: str) -> DataFrame:
    return by_codes(feeds, BUNDLES[name])


def feed_urls(feeds: DataFrame) -> DataFrame:
    return feeds.select(
        F.concat(F.lit("ACS - "), "journal_name").alias("name"), F.concat(F.lit(FEED_URL), "journal_code").alias("url")
    )


def fetch_state(log: DataFrame) -> DataFrame:
    """State per feed from a fetch log ``(feed_id, ts, ok, error)``.

    The last success is an aggregate joined back, so a feed with very many fetches is not sorted in
    one task.
    """
    last_ok = log.where("ok").groupBy("feed_id").agg(F.max("ts").alias("last_successful_fetch_at"))
    joined = log.join(last_ok, "feed_id", "left")
    after = ~F.col("ok") & (
        F.col("last_successful_fetch_at").isNull() | (F.col("ts") > F.col("last_successful_fetch_at"))
    )
    return joined.groupBy("feed_id").agg(
        F.max("ts").alias("last_fetched_at"),
        F.max("last_successful_fetch_at").alias("last_successful_fetch_at"),
        F.count_if(after).alias("consecutive_failures"),
        F.max_by(F.when(after, F.col("error")), "ts").alias("last_error"),
    )


def validity(feeds: DataFrame, records: DataFrame, key: str = "feed_id") -> DataFrame:
    """``(feed, n_entries, is_valid, error)``: a feed is valid when it has entries and none is broken."""
    seen = records.groupBy(key).agg(
        F.count_if("is_valid").alias("n_entries"), F.count_if(~F.col("is_valid")).alias("n_broken")
    )
    s = feeds.select(key).distinct().join(seen, key, "left").na.fill(0, ["n_entries", "n_broken"])
    error = F.when(F.col("n_broken") > 0, "Feed parsing error").when(F.col("n_entries") == 0, "Feed contains no entries")
    return s.select(key, "n_entries", error.isNull().alias("is_valid"), error.alias("error"))


def collection_summary(feeds: DataFrame, records: DataFrame, key: str = "feed_id") -> DataFrame:
    """Papers and status per known feed; the grand total is ``sum(n_papers)``."""
    v = validity(feeds, records, key)
    return v.select(key, F.col("n_entries").alias("n_papers"), F.coalesce("error", F.lit("OK")).alias("status"))


def new_records(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Incoming records whose DOI and content hash are both unknown to the store, one per hash.

    Records without a DOI are not shuffled by it: they pass the DOI test untouched.
    """
    by_doi = incoming.where("doi IS NOT NULL").join(store.where("doi IS NOT NULL").select("doi"), "doi", "left_anti")
    rest = incoming.where("doi IS NULL").unionByName(by_doi)
    fresh = rest.join(store.select("content_hash"), "content_hash", "left_anti")
    whole = F.struct(*[F.col(c) for c in fresh.columns])
    return fresh.groupBy(F.col("content_hash").alias("_h")).agg(F.min_by(whole, "ord").alias("r")).select("r.*")
