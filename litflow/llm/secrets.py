"""Secret scans: trigram queries derived from each rule's pattern choose the texts that the rule is run on."""

from __future__ import annotations

import re._constants as op
import re._parser as sre
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litflow.llm.common import prefix_sums, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped, but use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # whole runs of 20 (24) and more characters: a shorter run holds no longer one, so least lengths stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: More rules; their spans come beside the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("payment", r"sk_(live|test)_[A-Za-z0-9]{16,}"),
)
RULES = (*BASE, *MORE)

#: More ways through a pattern than this are cut down to what all of them need.
MOST_WAYS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The ways a match can go, each with the lower-case trigrams that it needs; a match needs one way in full.

    A way with no trigram makes the query useless: the rule then scans everything.
    """

    def flush(ways):
        return {(need | frozenset(run[i : i + 3] for i in range(len(run) - 2)), "") for need, run in ways}

    def walk(items, ways):
        for kind, arg in items:
            if kind is op.LITERAL:
                ways = {(need, run + chr(arg).lower()) for need, run in ways}
            elif kind is op.SUBPATTERN:
                ways = walk(arg[3], ways)
            elif kind is op.BRANCH:
                ways = set().union(*[walk(branch, ways) for branch in arg[1]])
            elif kind is op.MAX_REPEAT and arg[:2] == (0, 1):
                ways = ways | walk(arg[2], ways)
            elif kind is op.MAX_REPEAT and arg[0] >= 1:
                ways = flush(walk(arg[2], flush(ways)))
            elif kind is op.IN and len(letters := {chr(c).lower() for k, c in arg if k is op.LITERAL}) <= 8 and all(k is op.LITERAL for k, _ in arg):
                ways = {(need, run + c) for need, run in ways for c in letters}
            else:
                ways = flush(ways)
            if len(ways) > MOST_WAYS:
                ways = {(frozenset.intersection(*[need for need, _ in flush(ways)]), "")}
        return ways

    found = {need for need, _ in flush(walk(sre.parse(pattern), {(frozenset(), "")}))}
    return sorted((w for w in found if not any(v < w for v in found)), key=sorted)  # a way that needs more adds nothing


def scans_fully(rule: Rule) -> bool:
    return not all(trigram_query(rule.pattern))


def postings(texts: DataFrame, trigrams: Sequence[str], key: str = "key", text: str = "text") -> DataFrame:
    """The inverted index for these trigrams: (trigram, key), one row for each trigram that a text has."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return texts.select(key, low.alias("low")).select(key, F.explode(hits).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule], key: str = "key") -> DataFrame:
    """(key, rules): texts in which a way of some rule has all its trigrams; ``rules`` has bit i for rule i.

    Postings of a way's trigrams are intersected per key as bits, combined before the shuffle, so a frequent trigram
    is not gathered anywhere.
    """
    ways = [(i, sorted(w)) for i, rule in enumerate(rules) if not scans_fully(rule) for w in trigram_query(rule.pattern)]
    places: dict[str, list[Column]] = {}
    for number, (_, way) in enumerate(ways):
        for bit, t in enumerate(way):
            places.setdefault(t, []).append(F.struct(F.lit(number).alias("way"), F.lit(1 << bit).cast("bigint").alias("bit")))
    table = F.create_map(*[x for t, at in places.items() for x in (F.lit(t), F.array(*at))])
    need = F.element_at(F.array(*[F.lit((1 << len(w)) - 1).cast("bigint") for _, w in ways]), F.col("way") + 1)
    rule_bit = F.element_at(F.array(*[F.lit(1 << i).cast("bigint") for i, _ in ways]), F.col("way") + 1)
    met = index.select(key, F.explode(table[F.col("trigram")]).alias("at")).groupBy(key, F.col("at.way").alias("way")).agg(F.bit_or("at.bit").alias("bits"))
    return met.where(F.col("bits") == need).groupBy(key).agg(F.bit_or(rule_bit).alias("rules"))


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (code points, end exclusive) of a rule in a text: leftmost, not overlapping, failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    lengths = F.transform(found, lambda x: F.length(x).cast("bigint"))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), lengths, lambda a, b: F.coalesce(a, F.lit(0)) + b)
    ends = F.zip_with(prefix_sums(steps), steps, lambda a, b: a + b)
    spans = F.zip_with(
        F.arrays_zip(ends.alias("e"), lengths.alias("n")), judged,
        lambda s, j: F.when(
            F.length(j) >= rule.least,
            F.struct((s["e"] - s["n"]).alias("start"), F.lit(rank).alias("rank"), s["e"].alias("end")),
        ),
    )
    return F.array_compact(spans).cast(SPANS)


def _none() -> Column:
    return F.array().cast(SPANS)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds ``secrets``: all spans (start, rank of the rule, end) by start, then rank, to every row.

    Null text counts as empty. Equal texts share their postings; rows keep their number. A column named ``secrets``
    is replaced, others pass.
    """
    names = [c for c in docs.columns if c.lower() != "secrets"]
    rest = F.struct(F.col(text).isNull().alias("missing"), *[F.col(c) for c in names if c != text]).alias("row")
    rows = docs.select(rest, text_or_empty(text).alias("text")).withColumn("key", F.xxhash64("text"))
    wanted = sorted({t for r in rules if not scans_fully(r) for way in trigram_query(r.pattern) for t in way})
    spans = [_none()]
    if wanted:
        chosen = candidates(postings(rows, wanted), rules)
        rows = rows.join(chosen.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    for i, rule in enumerate(rules):
        run = F.lit(True) if scans_fully(rule) else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(False))
        has = run & F.col("text").rlike(rule.pattern)
        spans.append(F.when(has, rule_spans(F.col("text"), rule, i)).otherwise(_none()))
    back = [F.when(~F.col("row")["missing"], F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return rows.withColumn("secrets", F.sort_array(F.flatten(F.array(*spans)))).select(*back, "secrets")


def digest(secrets: Column, rules: Sequence[Rule] = RULES, only: int | None = None) -> Column:
    """``kind:start:end``, comma-joined; of the first ``only`` rules if given."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(secrets, lambda s: s["rank"] < only) if only is not None else secrets
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span (overlapping and touching ones as one) by ``mark``; drops ``secrets``. A null text stays null."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    value = F.col(text)

    def step(s: Column, x: Column) -> Column:
        fresh = (x["start"] > s["at"]) | (F.size(s["out"]) == 0)
        piece = F.when(x["start"] > s["at"], F.substring(value, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).otherwise("")
        return F.struct(
            F.when(fresh, F.concat(s["out"], F.array(piece, F.lit(mark)))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        )

    folded = F.aggregate("secrets", start, step)
    clean = F.concat(F.array_join(folded["out"], ""), F.substring(value, (folded["at"] + 1).cast("int"), F.length(value)))
    return found.withColumn(text, F.when(F.size("secrets") == 0, value).otherwise(clean)).drop("secrets")


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, CAST(len(regexp_extract_all(t, {pattern})) AS BIGINT) + 1), lambda i:
    {{'start': CAST(list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      'rank': {rank}, 'n': CAST(length(regexp_extract_all(t, {pattern})[i]) AS BIGINT), 'ok': length(regexp_extract_all(t, {pattern}, {rule.group})[i]) >= {rule.least}}}), lambda s: s.ok)"""


def oracle(rules: Sequence[Rule] = RULES) -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    joined = f"list_aggregate(list_transform({{0}}, lambda s: {names}[s.rank + 1] || ':' || s.start || ':' || (s.start + s.n)), 'string_agg', ',')"
    found = ",\n  ".join(f"{_sql_spans(r, i)} AS s{i}" for i, r in enumerate(rules))
    every = "list_sort(" + " || ".join(f"s{i}" for i in range(len(rules))) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {found} FROM d)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
  sha256(coalesce({joined.format("list_sort(s0 || s1 || s2)")}, '')) AS base_sha256, coalesce({joined.format(every)}, '') AS spans
FROM f"""
