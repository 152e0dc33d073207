"""Conversations of any layout as canonical turns, and as one marked text with a loss mask.

The layout of a record is known by a fingerprint: the hash of the nested field paths it holds, of a record by itself (JSON) or of
a table's schema. The fingerprint selects a declarative mapping, which names the paths of roles and texts. All of it is
SQL expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quillmill.functions.once import once
from quillmill.llm.shared import free_name

TURNS = "array<struct<role:string,text:string>>"
#: Other names of roles, for mappings that say so.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout stand. Its parts apply in this order:

    ``lead``: (role, field) of turns in front, such as a system prompt; ``pairs``: an array of pairs (user, assistant), as arrays or
    with the two fields ``pair_fields``; ``each``: an array of turns with the fields ``role`` and ``text``, whose text may be an array
    of parts with a field ``part``; ``turns``: (role, fields), whose texts that are not empty are joined by an empty line.
    ``optional`` paths may be missing; ``rows``: one row of the table is one turn, with the fields (conversation, order).
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    lead: tuple[tuple[str, str], ...] = ()
    pairs: str = ""
    pair_fields: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    part: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: bool = False
    rows: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        some = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [fingerprint_of(self.paths + c) for c in some]


MAPPINGS = (
    Mapping("rows", ("conv_id", "turn", "role", "text"), role="role", text="text", rows=("conv_id", "turn")),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system",), lead=(("system", "system"),), each="messages", role="role", text="content"),
    Mapping(
        "message_parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type", "system"), lead=(("system", "system"),),
        each="messages", role="role", text="content", part="text",
    ),
    Mapping("shared", ("conversations[].from", "conversations[].value"), ("system",), lead=(("system", "system"),), each="conversations", role="from", text="value", aliases=True),
    Mapping("exchanges", ("conversation[].input", "conversation[].output"), ("system",), lead=(("system", "system"),), pairs="conversation", pair_fields=("input", "output")),
    Mapping(
        "instruction", ("instruction", "output"), ("input", "system", "history[][]"), lead=(("system", "system"),), pairs="history",
        turns=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping("completion", ("prompt", "completion"), ("system",), lead=(("system", "system"),), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), lead=(("system", "system"),), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), ("context", "system"), lead=(("system", "system"),), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


# ---- fingerprints


def fingerprint_of(paths) -> str:
    """Of paths by name: the hash that :func:`fingerprint` gives a record which holds just these."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: DataType, path: str = "") -> Iterator[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, path + "[]")
    else:
        yield path


#: A name with its colon, the start of an object or an array, its end, or a plain type.
_TOKEN = r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"


def record_paths(record: Column) -> Column:
    """Nested field paths of a VARIANT, from its schema by one fold that keeps the objects and arrays that are open."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), F.lit(0))

    def state(opened: Column, name: Column, out: Column) -> Column:
        return F.struct(opened.alias("open"), name.alias("name"), out.alias("out"))

    def step(a: Column, t: Column) -> Column:
        top, none = F.element_at(a["open"], -1), F.lit("")
        here = F.when(a["name"] == "", top).when(top == "", a["name"]).otherwise(F.concat(top, F.lit("."), a["name"]))
        return (
            F.when(t.endswith(": "), state(a["open"], F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - 2), "`(`?)", "$1"), a["out"]))
            .when(t == "OBJECT<", state(F.concat(a["open"], F.array(here)), none, a["out"]))
            .when(t == "ARRAY<", state(F.concat(a["open"], F.array(F.concat(here, F.lit("[]")))), none, a["out"]))
            .when(t == ">", state(F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(1))), none, a["out"]))
            .otherwise(state(a["open"], none, F.concat(a["out"], F.array(here))))
        )

    start = F.expr("named_struct('open', array(''), 'name', '', 'out', cast(array() as array<string>))")
    return F.aggregate(tokens, start, step, lambda a: a["out"])


def fingerprint(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Of a VARIANT: the hash of those of its paths that any mapping names; others, such as an id or a source, do not matter."""
    named = F.array(*[F.lit(p) for p in _named(mappings)])
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(record_paths(record), named)), "\n"), 256)


def _named(mappings: tuple[Mapping, ...]) -> list[str]:
    return sorted({p for m in mappings for p in m.paths + m.optional})


# ---- mappings


def _ddl(paths: tuple[str, ...]) -> str:
    """The type of a record that holds these paths, its leaves strings."""
    inner: dict[tuple[str, int], list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        name = head.rstrip("[]")
        inner.setdefault((name, head.count("[]")), []).append(rest)
    fields = []
    for (name, depth), rests in inner.items():
        kind = _ddl(tuple(rests)) if any(rests) else "string"
        fields.append(f"`{name}`: {'array<' * depth}{kind}{'>' * depth}")
    return f"struct<{', '.join(fields)}>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def mapped(m: Mapping, field) -> Column:
    """The turns of a record, of which ``field(name)`` is a column or None where its layout has no such field."""
    empty = F.expr(f"cast(array() as {TURNS})")
    out = [empty]
    for role, name in m.lead:
        if (c := field(name)) is not None:
            out.append(F.when(c.isNotNull(), F.array(_turn(F.lit(role), c))).otherwise(empty))
    if m.pairs and (c := field(m.pairs)) is not None:
        first, second = (lambda p, i=i: p[m.pair_fields[i]] if m.pair_fields else F.get(p, F.lit(i)) for i in (0, 1))
        both = F.transform(c, lambda p: F.array(_turn(F.lit("user"), first(p)), _turn(F.lit("assistant"), second(p))))
        out.append(F.coalesce(F.flatten(both), empty))
    if m.each:
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = lambda x: F.coalesce(names[F.lower(x)], x) if m.aliases else x
        text = lambda x: F.array_join(F.transform(x, lambda y: F.coalesce(y[m.part], F.lit(""))), "") if m.part else x
        out.append(F.coalesce(F.transform(field(m.each), lambda x: _turn(role(x[m.role]), text(x[m.text]))), empty))
    for role, names_ in m.turns:
        texts = F.array(*[c.cast("string") for c in map(field, names_) if c is not None])
        out.append(F.array(_turn(F.lit(role), F.array_join(F.filter(texts, lambda x: x != ""), "\n\n"))))
    return F.concat(*out)


def turns_of_records(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout``, the name of the mapping its fingerprint selects, and the canonical ``turns`` of each record in JSON.

    All rows stay. A record that is null, no JSON, longer than JSON may be (20 million characters a string, or the size of a VARIANT), or of
    a layout that no mapping knows (two layouts at once, too) has a null layout and no turns. Null texts and roles are empty; a
    null system prompt is no turn. Columns named ``layout`` and ``turns`` give way.
    """
    record, mark = free_name(records, "record"), free_name(records, "print")
    rows = records.drop("layout", "turns").withColumn(record, F.try_parse_json(F.col(record_col)))
    rows = rows.withColumn(mark, fingerprint(F.col(record), mappings))
    layout, turns = F.lit(None).cast("string"), F.expr(f"cast(array() as {TURNS})")
    for m in mappings:
        if not m.rows:
            here = F.col(mark).isin(m.fingerprints())
            got = F.try_variant_get(F.col(record), "$", _ddl(m.paths + m.optional))
            layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, mapped(m, lambda n, got=got: got[n])).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": turns}).drop(record, mark)


def mapping_of(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping that the fingerprint of a table's schema selects; a ValueError where there is none."""
    named = set(_named(mappings))
    mark = fingerprint_of(set(schema_paths(table.schema)) & named)
    for m in mappings:
        if mark in m.fingerprints():
            return m
    raise ValueError(f"no mapping for the layout {sorted(set(schema_paths(table.schema)) & named)}")


def turns_of_table(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A table of typed columns with ``layout`` and canonical ``turns``, by the mapping that its schema selects.

    Where one row is one turn, the result has a row for each conversation: its id, ``layout`` and ``turns``, in the order of the
    table's order column, nulls first, then of role and text; repeated rows are as many turns. Rows without a conversation's id are
    a conversation each. A conversation is one row, so it must fit into a worker's memory. Else all rows and
    columns stay. Columns named ``layout`` and ``turns`` give way; null texts and roles are empty; an empty table has an empty result.
    """
    m = mapping_of(table, mappings)
    if not m.rows:
        turns = mapped(m, lambda n: F.col(f"`{n}`") if n in table.columns else None)
        return table.drop("layout", "turns").withColumns({"layout": F.lit(m.name), "turns": turns})
    conversation, order = m.rows
    turn = _turn(F.col(m.role), F.col(m.text))
    placed = F.struct(F.col(order).alias("at"), turn["role"].alias("role"), turn["text"].alias("text"))
    plain = lambda rows: F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    rows = table.select(F.col(conversation), placed.alias("turn"))
    many = rows.where(F.col(conversation).isNotNull()).groupBy(conversation).agg(plain(F.array_sort(F.collect_list("turn"))).alias("turns"))
    lone = rows.where(F.col(conversation).isNull()).select(conversation, plain(F.array("turn")).alias("turns"))
    return many.unionByName(lone).select(conversation, F.lit(m.name).alias("layout"), "turns")


# ---- the template


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and all strings that must not stand inside a text: the marks themselves and those of common models."""

    start: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
    loss_role: str = "assistant"

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters or more and no backslash: {c!r}")
        for mark in (self.start, self.text, self.end):
            if mark[0] in mark[1:]:
                raise ValueError(f"a mark's first character must not stand in it again: {mark!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.text, self.end, *self.others)


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)


def escaped(text: Column, template: Template = Template()) -> Column:
    """Backslashes doubled, then one put behind the first character of each control string, so none is left."""
    rest: dict[str, list[str]] = {}
    for c in template.controls:
        rest.setdefault(c[0], []).append(_quoted(c[1:]))
    pattern = "|".join(f"{_quoted(a)}(?=(?:{'|'.join(b)}))" for a, b in rest.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({pattern})", r"$1\\")


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given: of two backslashes one stays, a lone one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``rows (turns, ...)`` with ``formatted``, the marked text, and ``segments``, whose texts make it up and tell where the loss counts.

    The loss mask covers the texts of the template's role without any mark. Of no turns the text is empty. Columns of those names give way.
    """
    mark, text = F.lit, lambda t: escaped(t["text"], template)
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    each = lambda t: F.array(
        segment(F.concat(mark(template.start), escaped(t["role"], template), mark(template.text)), no),
        segment(text(t), t["role"] == template.loss_role), segment(mark(template.end), no),
    )
    out = once(rows.drop("formatted", "segments"), segments=F.flatten(F.transform(F.coalesce("turns", F.expr(f"cast(array() as {TURNS})")), each)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(text: Column, template: Template = Template()) -> Column:
    """The turns of a marked text."""
    bodies = F.split(text, _quoted(template.start), -1)

    def turn(body: Column) -> Column:
        cut = F.split(body, _quoted(template.text), 2)
        said = F.get(cut, F.lit(1))
        return F.struct(unescaped(F.get(cut, F.lit(0))).alias("role"), unescaped(F.substring(said, F.lit(1), F.length(said) - len(template.end))).alias("text"))

    return F.transform(F.slice(bodies, F.lit(2), F.size(bodies)), turn)


def under_loss(segments: Column) -> Column:
    """All text under the loss mask as it was, one after another."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
