"""Queries of the training-data operators over whole tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litflow.llm import centroids, chat, languages, leaks, mixing, near_copies, prints, repeats, secrets, tokens, toxicity, urls, whitening
from litflow.llm.common import start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            start(spark)
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(mixing.SQL)
def op1_mixing(table):
    return mixing.mix(table("documents").withColumn("size", mixing.word_count()).select("doc_id", "source", F.col("size").alias("words")), size=F.col("words")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query()
def op2_language_id(table):
    docs = table("documents")
    model = languages.learn(docs.where(~languages.held_out()))
    return languages.predict(docs.select("doc_id", "text", languages.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query(chat.SQL)
def op3_chat_format(table):
    rows = table("conversations")
    said = "</s>[INST] ok [/INST]"
    pair = rows.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("completion")).alias("record")
    )
    several = chat.gather_messages(rows)
    listed = several.schema["record"].dataType["messages"].dataType
    wide = lambda df, given: df.select(  # noqa: E731  both layouts in one struct, as a reader of mixed files gives them
        "conv_id",
        F.struct(
            (F.col("record.messages") if given else F.lit(None).cast(listed)).alias("messages"),
            (F.lit(None).cast("string") if given else F.col("record.prompt")).alias("prompt"),
            (F.lit(None).cast("string") if given else F.col("record.completion")).alias("completion"),
        ).alias("record"),
    )
    made = chat.format_chat(chat.canonical_turns(wide(several, True).unionByName(wide(pair, False))))
    lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select("conv_id", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("segments")).alias("loss"), "formatted").select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op4_fingerprints(table):
    return prints.compare_with_next(table("documents").select("doc_id", "text"))


@query(secrets.oracle())
def op5_secrets(table):
    found = secrets.find_secrets(table("documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("bigint")
    base = secrets.digest(F.col("secrets"), only=len(secrets.BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.digest(F.col("secrets")).alias("spans"),
    )


@query()
def op6_simhash(table):
    found = near_copies.near_components(table("documents").select("doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op7_token_counts(table):
    import public_tokenizers

    docs = table("documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 512).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


@query(leaks.SQL)
def op8_decontamination(table):
    found = leaks.find_leaks(table("documents").select("doc_id", "text"), table("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op9_suffix_dedup(table):
    return repeats.remove_repeats(table("documents").select("doc_id", "text"), keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(urls.SQL)
def op10_url_filter(table):
    return urls.judge_urls(table("pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op11_toxicity(table):
    docs = table("documents")
    model = toxicity.learn(docs, table("labels"))
    scored = toxicity.score(docs.select("doc_id", "text", toxicity.held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages", "evidence")


@query(centroids.sql())
def op12_centroid_clusters(table):
    return centroids.cluster(table("embeddings").select("vec_id", "embedding"))


@query()
def op13_whitening(table):
    return whitening.whiten(table("embeddings").select("vec_id", "embedding"))
