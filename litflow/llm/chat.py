"""Chat formatting: records of different layouts, told apart by a hash of their field paths, become canonical turns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, value: Column, path: str = "") -> list[tuple[str, Column]]:
    """Every leaf path under ``value`` with a condition that says whether this record has it.

    A path is there if its value is not null (an array: if it is not null; what lies in it is named by the schema).
    """
    if isinstance(schema, T.StructType):
        found = []
        for f in schema.fields:
            found += field_paths(f.dataType, value[f.name], f"{path}.{f.name}" if path else f.name)
        return found
    if isinstance(schema, T.ArrayType):
        inner = schema.elementType
        names = [p for p, _ in field_paths(inner, F.lit(None).cast(inner), f"{path}[]")]
        return [(p, value.isNotNull()) for p in names]
    return [(path, value.isNotNull())]


def fingerprint_of(paths: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(schema: T.StructType, record: Column) -> Column:
    """Hash of the record's nested field paths, sorted."""
    leaves = sorted(field_paths(schema, record), key=lambda x: x[0])
    there = F.array_compact(F.array(*[F.when(has, F.lit(p)) for p, has in leaves]))
    return F.xxhash64(F.array_join(there, "\n"))


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that tell it, those that may be absent, and how it becomes turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]
    optional: tuple[str, ...] = field(default=())

    def variants(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [self.paths]
        for p in self.optional:
            out += [(*v, p) for v in out]
        return out


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _listed(items: Column, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(x: Column) -> Column:
        said = F.coalesce(x[role], F.lit(""))
        for old, new in (names or {}).items():
            said = F.when(x[role] == old, new).otherwise(said)
        return F.struct(said.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return F.transform(items, one)


def _instruction(r: Column, given: bool) -> Column:
    asked = F.concat(r["instruction"], F.lit("\n\n"), r["input"]) if given else r["instruction"]
    return F.array(_turn("user", asked), _turn("assistant", r["output"]))


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), lambda r: _listed(r["messages"], "role", "content")),
    Mapping(
        "conversations", ("conversations[].from", "conversations[].value"),
        lambda r: _listed(r["conversations"], "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    Mapping("prompt", ("prompt", "completion"), lambda r: F.array(_turn("user", r["prompt"]), _turn("assistant", r["completion"]))),
    Mapping(
        "prompt_system", ("system", "prompt", "completion"),
        lambda r: F.array(_turn("system", r["system"]), _turn("user", r["prompt"]), _turn("assistant", r["completion"])),
    ),
    Mapping("instruction", ("instruction", "output"), lambda r: _instruction(r, False)),
    Mapping("instruction_input", ("instruction", "input", "output"), lambda r: _instruction(r, True)),
)


def _usable(mapping: Mapping, known: set[str]) -> bool:
    return set(mapping.paths) <= known


def canonical_turns(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``schema_hash``, ``layout`` and ``turns`` (array of role, text) to rows with a struct column ``record``.

    Layouts met in one table are the non-null parts of one wide struct, as readers of mixed JSON give it. A record
    whose hash fits no mapping (also one with no field at all) gets a null layout and null turns: it is kept for the
    caller to see. Null texts and roles inside turns are empty. Output columns replace columns of the same name.
    """
    schema = records.schema[record].dataType
    known = {p for p, _ in field_paths(schema, F.col(record))}
    rows = records.withColumn("schema_hash", fingerprint(schema, F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        for paths in m.variants():
            if _usable(m, known) and set(paths) <= known:
                hit = F.col("schema_hash") == fingerprint_of(paths)
                layout = F.when(hit, m.name).otherwise(layout)
                turns = F.when(hit, m.turns(F.col(record)).cast(TURNS)).otherwise(turns)
    return rows.withColumn("layout", layout).withColumn("turns", turns)


@dataclass(frozen=True)
class Template:
    """Marks of a turn. A text's own control strings get a backslash after their first character."""

    head: str = "[INST]"
    head_end: str = "[/INST]"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.head, self.head_end, self.end, *self.others)

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_chat(rows: DataFrame, template: Template = Template(), turns: str = "turns", learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds ``segments`` (array of text, loss) and ``formatted``, their texts in a row.

    A turn is head, role, head_end, text, end; the texts of the roles in ``learn`` are under the loss mask, marks and
    the rest are not. Role and text are escaped so that marks stand only where the template puts them. Null turns
    give null, no turns an empty text.
    """

    def parts(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), template.escape(F.coalesce(t["text"], F.lit("")))
        head = F.concat(F.lit(template.head), template.escape(role), F.lit(template.head_end))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(text.alias("text"), role.isin(*learn).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    out = rows.withColumn("segments", F.flatten(F.transform(F.col(turns), parts)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, F.lit("\\Q" + template.end + "\\E"))

    def one(piece: Column) -> Column:
        body = F.substring(piece, len(template.head) + 1, 2**31 - 1)
        role = F.substring_index(body, template.head_end, 1)
        text = F.substring(body, F.length(role) + (len(template.head_end) + 1), F.length(body))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def read_loss(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def gather_messages(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one ``record`` with messages per conversation, in order of turn, then role, then text.

    Null role and text are empty, null turns come first; a null conversation id is a conversation of its own. A
    conversation is one value of the output, so its turns meet in one row however many it has.
    """
    item = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    listed = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    messages = F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return listed.select("conv_id", F.struct(messages.alias("messages")).alias("record"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'), '<s>', '<\s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(6 + 7 + 4 + length(role) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
