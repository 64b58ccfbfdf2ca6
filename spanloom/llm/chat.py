"""Chat formatting: heterogeneous layouts to canonical turns to one marked text.

A layout is known by a fingerprint of its nested field paths; the fingerprint
selects a declarative mapping to canonical turns.  Tables with a fixed schema
are matched by that schema; JSON records are matched row by row, by the paths
of the record itself.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: its field paths, and how its turns are found.

    ``kind``: ``rows`` (a row is a turn), ``list`` (``source`` is an array of
    objects with the fields ``role`` and ``text``) or ``fields`` (each of
    ``parts`` is (field, role); fields that are null or empty give no turn).
    """

    name: str
    paths: tuple[str, ...]
    kind: str
    source: str = ""
    role: str = "role"
    text: str = "text"
    parts: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: The layouts that are known.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), "rows"),
    Layout("speaker_rows", ("content", "conv_id", "speaker", "turn"), "rows", role="speaker", text="content"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), "list", "messages", "role", "content"),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), "list", "conversations", "from", "value"),
    Layout("instruction_input", ("input", "instruction", "output"), "fields", parts=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("instruction", ("instruction", "output"), "fields", parts=(("instruction", "user"), ("output", "assistant"))),
    Layout("prompt_completion", ("completion", "prompt"), "fields", parts=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", ("prompt", "response", "system"), "fields", parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question_answer", ("answer", "question"), "fields", parts=(("question", "user"), ("answer", "assistant"))),
)
#: Other names of the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; an array's elements are marked ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for name in [f"{at}.{f.name}" if at else f.name] for p in [name, *schema_paths(f.dataType, name)]]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return []


def row_layout(schema: T.StructType) -> Layout:
    """The first layout of a row per turn whose fingerprint the columns of its names have; others are not looked at."""
    for layout in LAYOUTS:
        paths = [p for f in schema if f.name in layout.paths for p in [f.name, *schema_paths(f.dataType, f.name)]]
        if layout.kind == "rows" and layout.fingerprint == fingerprint_of(paths):
            return layout
    raise ValueError(f"no layout of turns has the columns {sorted(f.name for f in schema)}")


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON record: SHA-256 of its sorted field paths (two levels, arrays of objects marked ``[]``).

    Null for text that is no JSON object.
    """
    keys = F.json_object_keys(record)

    def below(key: Column) -> Column:
        part = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))
        first = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("'][0]")))
        inner = F.transform(F.coalesce(F.json_object_keys(first), F.array().cast("array<string>")), lambda k: F.concat(key, F.lit("[]."), k))
        plain = F.transform(F.coalesce(F.json_object_keys(part), F.array().cast("array<string>")), lambda k: F.concat(key, F.lit("."), k))
        return F.concat(F.array(key), inner, plain)

    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(keys, below)))), "\n"), 256)


def _canonical_role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, role), role, F.lit(""))


def _turn_of(layout: Layout) -> Callable[[Column], Column]:
    return lambda t: F.struct(_canonical_role(t[layout.role]).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))


def turns_of_records(records: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """``key, layout, turns`` for JSON records of any known layout.

    A record of no known layout, or no JSON object, has a null ``layout`` and
    no turns; it is kept.  Records are told apart row by row.
    """
    json = F.col(record).cast("string")
    out = records.select(key, json.alias("__json"), record_fingerprint(json).alias("__print"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for one in LAYOUTS:
        if one.kind == "rows":
            continue
        hit = F.col("__print") == one.fingerprint
        if one.kind == "list":
            parsed = F.from_json(F.get_json_object("__json", f"$.{one.source}"), f"array<struct<`{one.role}`:string,`{one.text}`:string>>")
            mine = F.transform(parsed, _turn_of(one))
        else:
            parts = [F.struct(F.lit(role).alias("role"), F.get_json_object("__json", f"$.{field}").alias("text")) for field, role in one.parts]
            mine = F.filter(F.array(*parts), lambda t: F.coalesce(t["text"], F.lit("")) != "")
        layout, turns = F.when(hit, one.name).otherwise(layout), F.when(hit, mine.cast(TURNS)).otherwise(turns)
    return out.select(key, layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` from a row per turn, in the layout that the fingerprint of its columns selects.

    Turns are ordered by ``turn``, nulls first; rows with one number are
    ordered by role and text, and repeated rows stay.  A null role or text is
    empty.  A conversation is one row of the result, so its turns meet in one
    task; conversations are dealt over all tasks.
    """
    layout = row_layout(rows.schema)
    field = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), field(layout.role).alias("role"), field(layout.text).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


#: The marks of the template, and what in a text would read as one of them.
BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = r"([<\[])(/?s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(/?s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    r"""Double each backslash, then put one into each control string, so that none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (in place of columns so named) to rows with ``turns``.

    Each turn is ``<s>[INST] role [/INST]text</s>``, role and text escaped.
    ``loss_spans``: (start, length) in code points of the escaped texts of
    role ``learn`` in ``formatted``.  No turns: the empty text.
    """
    def shaped(t: Column) -> Column:
        return F.struct((t["role"] == learn).alias("learn"), F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin, size = state["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        spans = F.when(t["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + size + len(END)).alias("at"), spans.alias("spans"))

    def formatted(parts: Column) -> Column:
        joined = F.array_join(F.transform(parts, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
        return F.struct(joined.alias("formatted"), F.aggregate(parts, start, step, lambda s: s["spans"]).alias("loss_spans"))

    # a list of one gives the escaped turns a name that no column can have
    made = F.transform(F.array(F.transform("turns", shaped)), formatted)[0]
    kept = [c for c in turns.columns if c not in ("formatted", "loss_spans")]
    return turns.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), made.alias("made")).select("row.*", "made.*")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, roles and texts unescaped."""
    parts = F.filter(F.split(formatted, "\\Q" + END + "\\E", -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        rest = F.substring(part, len(BEGIN) + 1, 2**31 - 1 - len(BEGIN))
        cut = F.instr(rest, MIDDLE)
        return F.struct(unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(rest, cut + len(MIDDLE), F.lit(2**31 - 1) - cut - len(MIDDLE))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
