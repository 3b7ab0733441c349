"""Chat formatting by schema fingerprinting (DataFrame functions only).

A record's layout is told by its nested field paths: `messages[].role`, `dialog.turns[].speaker`,
`prompt`, ...  The known paths that are set in a record are listed in order and hashed; the hash
selects one of the declarative mappings of LAYOUTS (the listed paths themselves are compared too,
so a collision selects nothing), which turns the record into canonical turns (role, text).  Fields
that no mapping names are metadata and do not take part.

The template writes each turn as `<s>[INST]role[/INST]text</s>`.  Where a text or role holds one of
these control strings, a backslash is put behind its first character, and one more where backslashes
stand there already; reading back takes one away.  Control strings begin with a character that none
of them has inside, so no string can form across the edge of a text.

Output per record: its turns, the formatted text, and for every turn the span of its escaped text in
code points with a flag for the loss mask, which covers the texts of the assistant's turns.

Defined results: a null text or role is empty, null elements of a list of messages are left out, an
empty list gives no turns.  A record with no layout (`layout` null) gives no turns and an empty text.
In a table of one row per turn all rows with one id, the null id too, are one conversation in the
order of (turn, role, text), null turns first; repeated rows are repeated turns.  A conversation is
one output value, so its size is bound by what a row may hold.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import itemgetter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


class Fields(NamedTuple):
    """A layout with one field, or a few joined by blank lines, for each turn."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    required: tuple[str, ...]

    def paths(self) -> list[str]:
        return [p for _, fields in self.turns for p in fields]

    def build(self, declared: set[str]) -> Column:
        made = []
        for role, fields in self.turns:
            fields = [F.col(p).cast("string") for p in fields if p in declared]
            if fields:
                some = F.coalesce(*fields).isNotNull()
                made.append(F.struct(F.lit(role).alias("role"), F.when(some, F.concat_ws("\n\n", *fields)).alias("text")))
        return F.filter(F.array(*made), lambda t: t.text.isNotNull())


class Messages(NamedTuple):
    """A layout with a list of messages that name their role."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str]

    @property
    def required(self) -> tuple[str, ...]:
        return (self.items,)

    def paths(self) -> list[str]:
        return [self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]

    def build(self, declared: set[str]) -> Column:
        def turn(m: Column) -> Column:
            role, text = (m[p] if f"{self.items}[].{p}" in declared else F.lit(None) for p in (self.role, self.text))
            role = F.coalesce(role.cast("string"), F.lit(""))
            named = role
            for theirs, ours in self.roles.items():
                named = F.when(role == theirs, ours).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
        return F.transform(F.filter(F.col(self.items), lambda m: m.isNotNull()), turn)


class TurnRow(NamedTuple):
    """A layout with one row for each turn."""

    name: str
    number: str
    role: str
    text: str
    required: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [self.number, self.role, self.text]

    def build(self, declared: set[str]) -> Column:
        role, text = (F.coalesce(F.col(p).cast("string"), F.lit("")) for p in (self.role, self.text))
        return F.array(F.struct(role.alias("role"), text.alias("text")))


#: The mappings.  `required` paths are set in every record of a layout, its other paths may be missing.
LAYOUTS = (
    Messages("messages", "messages", "role", "content", {}),
    Messages("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Messages("dialog", "dialog.turns", "speaker", "utterance", {"customer": "user", "agent": "assistant"}),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("instruction",)),
    Fields("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("prompt",)),
    Fields("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("prompt", "response")),
    Fields("question", (("user", ("context", "question")), ("assistant", ("answer",))), ("question",)),
)
BY_TURN = TurnRow("turn", "turn", "role", "text")
Layout = Fields | Messages | TurnRow


def field_paths(schema: T.StructType, known: set[str]) -> Iterator[tuple[str, Column]]:
    """(path, whether it is set) of the known paths that a table declares; null fields are not set."""
    def walk(kind: T.StructType, path: str, value) -> Iterator[tuple[str, Column]]:
        for field in kind.fields:
            at, c, inner = path + field.name, value(field.name), field.dataType
            if at in known:
                yield at, c.isNotNull()
            if isinstance(inner, T.StructType):
                yield from walk(inner, at + ".", c.getField)
            elif isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
                for sub in inner.elementType.fields:
                    if f"{at}[].{sub.name}" in known:
                        yield f"{at}[].{sub.name}", F.exists(F.transform(c, itemgetter(sub.name)), F.isnotnull)
    yield from walk(schema, "", lambda name: F.col(f"`{name}`"))


def _variants(layout: Layout, declared: set[str]) -> list[str]:
    """The path lists of all records that have this layout."""
    if not set(layout.required) <= declared:
        return []
    free = sorted(set(layout.paths()) & declared - set(layout.required))
    return ["\n".join(sorted([*layout.required, *some])) for k in range(len(free) + 1) for some in combinations(free, k)]


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with columns `fingerprint` (long), `layout` (name of its mapping) and `turns` instead of clashing ones."""
    known = {p for layout in layouts for p in layout.paths()}
    found = sorted(field_paths(records.schema, known), key=lambda x: x[0])
    declared = {p for p, _ in found}
    table: dict[str, str] = {}
    for layout in layouts:
        for paths in _variants(layout, declared):
            table.setdefault(paths, layout.name)
    listed = F.concat_ws("\n", *(F.when(there, F.lit(p)) for p, there in found)) if found else F.lit("")
    keyed = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"), listed.alias("paths"))
    keyed = keyed.select("record.*", F.struct("paths", F.xxhash64("paths").alias("fingerprint")).alias("__seen"))
    chosen = F.lit(None).cast("struct<paths:string,layout:string>")
    if table:
        mapping = F.create_map(*(x for paths, name in table.items() for x in (
            F.xxhash64(F.lit(paths)), F.struct(F.lit(paths).alias("paths"), F.lit(name).alias("layout")))))
        chosen = F.try_element_at(mapping, F.col("__seen.fingerprint"))
    layout = F.when(chosen["paths"] == F.col("__seen.paths"), chosen["layout"])
    keyed = keyed.withColumn("__layout", layout)
    turns = F.lit(None).cast(TURNS)
    for one in layouts:
        if one.name in table.values():
            turns = F.when(F.col("__layout") == one.name, one.build(declared).cast(TURNS)).otherwise(turns)
    rest = [F.col(f"`{c}`") for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    return keyed.select(*rest, F.col("__seen.fingerprint").alias("fingerprint"), F.col("__layout").alias("layout"),
                        F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


# ------------------------------------------------------------------ template
def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=<)(\\*)(?=/?s>)|(?<=\[)(\\*)(?=/?INST\])", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])", "")


OPEN, HEADED, CLOSE = "<s>[INST]", "[/INST]", "</s>"
SPANS = "array<struct<start:bigint,end:bigint,loss:boolean>>"


def _spans(escaped: Column) -> Column:
    """Where each turn's text stands in the formatted text."""
    def add(seen: Column, t: Column) -> Column:
        start = seen["at"] + len(OPEN) + F.char_length(t["role"]) + len(HEADED)
        end = start + F.char_length(t["text"])
        one = F.struct(start.alias("start"), end.alias("end"), (t["role"] == "assistant").alias("loss"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(seen["spans"], F.array(one).cast(SPANS)).alias("spans"))
    return F.aggregate(escaped, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans")), add, lambda x: x["spans"])


def template(turns: Column) -> tuple[Column, Column]:
    """(formatted text, spans) of canonical turns."""
    escaped = F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    whole = F.array_join(F.transform(escaped, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(HEADED), t["text"], F.lit(CLOSE))), "")
    return whole, _spans(escaped)


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted text as they are written, without their ends."""
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """The canonical turns that a formatted text holds."""
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, HEADED, 1)
        body = F.substr(piece, F.char_length(head) + len(HEADED) + 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(body).alias("text"))
    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one per masked span.  A span is cut from its turn's
    piece, whose place follows from the span before, so the cost is that of the text."""
    cut = F.transform(F.arrays_zip(_pieces(formatted).alias("piece"), spans.alias("span")), lambda z, i: F.when(z["span"]["loss"], unescape(F.substr(
        z["piece"], (z["span"]["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"] + len(CLOSE)) + 1).cast("int"),
        (z["span"]["end"] - z["span"]["start"]).cast("int")))))
    return F.filter(cut, lambda x: x.isNotNull())


def format_chats(records: DataFrame, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns, formatted, spans) of every record; a table with columns turn, role and text
    has one row per turn and gives one record per id."""
    if {BY_TURN.number, BY_TURN.role, BY_TURN.text} <= set(records.columns):
        rows = canonical(records.select(F.col(f"`{id_col}`").alias("id"), *BY_TURN.paths()), (BY_TURN,))
        turn = F.struct(F.col("turn"), F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"))
        chats = rows.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("layout").alias("layout"))
        chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])))
    else:
        chats = canonical(records, layouts)
        chats = chats.select(F.col(f"`{id_col}`").alias("id"), "layout", "turns")
    whole, spans = template(F.col("turns"))
    return chats.select("id", "layout", "turns", whole.alias("formatted"), spans.alias("spans"))


def from_json(lines: DataFrame, record_col: str) -> DataFrame:
    """(…, JSON text) -> the other columns and one column for each top-level field that a mapping names."""
    message = "array<struct<{}:string,{}:string>>".format
    schema = (f"messages {message('role', 'content')}, conversations {message('from', 'value')}, "
              f"dialog struct<turns:{message('speaker', 'utterance')}>, system string, instruction string, input string, output string, "
              "prompt string, completion string, response string, context string, question string, answer string")
    parsed = F.from_json(F.col(f"`{record_col}`"), schema)
    rest = [F.col(f"`{c}`") for c in lines.columns if c != record_col]
    return lines.select(*rest, parsed.alias("__json")).select(*rest, "__json.*")
