"""Chat formatting in DataFrame functions alone.

Layouts.  A table or a JSON record is recognised by its schema fingerprint: the
hash of those of its nested field paths that occur in any known layout
(``messages[].role``, ``prompt``, ...).  The fingerprint selects a ``Layout``,
which says where turns and roles are; a schema that matches none exactly takes
the largest layout all of whose paths it has.  Every layout gives the same
canonical turns: rows (conv_id, place, role, text).

Template.  A turn is ``<s>[ROLE]role[/ROLE]text</s>``.  Control strings inside
roles and texts get a backslash after their first character, and backslashes
are doubled before that, so formatted text reads back exactly.  The loss mask
is a list of (start, length) in code points of the formatted text, one span for
each assistant text.

Null roles and texts are empty, an empty text has an empty span.  Turns without
a number come first; turns of one number are put in order of role, then text,
and repeated rows are turns of their own.  A JSON record holds a path whose
value is null, and one that any element of an array holds.  A record of an
unknown layout, or without turns, is one row whose place, role and text are
null; it has no formatted text.  An empty table gives an empty result.  A conversation
becomes one string and therefore meets in one task, however long it is.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import bind

TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: fixed values: what may mark turns in a prompt and is therefore escaped in texts
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
ESCAPE = "\\"


@dataclasses.dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: in rows, in an array of objects, or in one field for each turn."""

    name: str
    role: str | None = None
    text: str | None = None
    array: str | None = None
    order: str | None = None
    fields: tuple[tuple[str, str], ...] = ()  # (role, path); empty optional texts make no turn
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # names of roles that mean another

    @property
    def paths(self) -> frozenset[str]:
        inside = f"{self.array}[]." if self.array else ""
        listed = [inside + p for p in (self.role, self.text) if p] + [p for _, p in self.fields]
        return frozenset(listed + ([self.order] if self.order else []))

    @property
    def fingerprint(self) -> str:
        return _digest(self.paths)


LAYOUTS = (
    Layout("turn_rows", role="role", text="text", order="turn"),
    Layout("messages", array="messages", role="role", text="content"),
    Layout("from_value", array="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
)
KNOWN_PATHS = sorted(frozenset().union(*(layout.paths for layout in LAYOUTS)))


def _digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, above: str = "") -> list[str]:
    """All nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{above}[]")
    if isinstance(kind, T.StructType):
        dot = f"{above}." if above else ""
        return [p for field in kind.fields for p in field_paths(field.dataType, dot + field.name)]
    return [above]


def layout_of(schema: T.StructType) -> Layout | None:
    paths = frozenset(field_paths(schema)) & frozenset(KNOWN_PATHS)
    exact = {layout.fingerprint: layout for layout in LAYOUTS}.get(_digest(paths))
    fitting = [layout for layout in LAYOUTS if layout.paths <= paths]
    return exact or max(fitting, key=lambda layout: len(layout.paths), default=None)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _named_role(layout: Layout, role: Column) -> Column:
    for other, name in layout.roles:
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return role


def _turns(layout: Layout, at) -> Column:
    """The turns of a layout with one conversation in a row; ``at`` gives the column of a path."""
    if layout.array:
        one = lambda x: F.struct(
            _named_role(layout, _or_empty(x[layout.role])).alias("role"), _or_empty(x[layout.text]).alias("text")
        )
        return F.transform(at(layout.array), one)
    turns = [
        F.struct(F.lit(role).alias("role"), _or_empty(at(path)).alias("text"), F.lit(path in layout.optional).alias("may_go"))
        for role, path in layout.fields
    ]
    kept = F.filter(F.array(*turns), lambda x: ~(x["may_go"] & (x["text"] == "")))
    return F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns (conv_id, place, role, text) of a table in any known layout."""
    layout = layout_of(df.schema)
    if layout is None:
        raise ValueError(f"no layout has the fields {df.columns}")
    conv = F.col(f"`{key}`").cast("bigint").alias("conv_id")
    if layout.order:
        rows = df.select(
            conv,
            F.col(f"`{layout.order}`").alias("turn"),
            _named_role(layout, _or_empty(F.col(f"`{layout.role}`"))).alias("role"),
            _or_empty(F.col(f"`{layout.text}`")).alias("text"),
        )
        place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
        return rows.select("conv_id", (place - 1).alias("place"), "role", "text")
    turns = df.select(conv, F.posexplode(_turns(layout, lambda p: F.col(f"`{p}`"))).alias("place", "turn"))
    return turns.select("conv_id", "place", "turn.role", "turn.text")


def canonical_records(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """Turns of JSON records, each row in a layout of its own; its fingerprint is made from the paths it holds.

    A layout with a turn number takes each of its records for one turn.
    """
    value = F.try_parse_json(F.col(f"`{record}`").cast("string"))
    found = df.select(F.col(f"`{key}`").cast("bigint").alias("conv_id"), value.alias("value"))

    def elements(path: str) -> Column:
        return F.try_variant_get("value", f"$.{path}", "array<variant>")

    def holds(path: str) -> Column:
        array, inside, field = path.rpartition("[].")
        if not inside:
            return F.try_variant_get("value", f"$.{path}", "variant").isNotNull()
        some = F.exists(elements(array), lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())
        return F.coalesce(some, F.lit(False))

    paths = F.filter(F.array(*(F.when(holds(p), F.lit(p)) for p in KNOWN_PATHS)), lambda p: p.isNotNull())
    # bound, or every use of the paths would look for them again
    found = bind(found, {"paths": paths}).withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    name = F.lit(None).cast("string")
    for layout in sorted(reversed(LAYOUTS), key=lambda layout: len(layout.paths)):
        fits = F.size(F.array_except(F.array(*map(F.lit, sorted(layout.paths))), "paths")) == 0
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
    for layout in LAYOUTS:
        name = F.when(F.col("fingerprint") == layout.fingerprint, F.lit(layout.name)).otherwise(name)
    found = bind(found, {"layout": name})

    def at(layout: Layout):
        def column(path: str) -> Column:
            if path != layout.array:
                return F.try_variant_get("value", f"$.{path}", "string")
            # one by one, so that an odd element doesn't take the others with it
            fields = (layout.role, layout.text)
            return F.transform(elements(path), lambda x: F.struct(*(F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in fields)))

        return column

    ordered = [layout for layout in LAYOUTS if layout.order]
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        if layout not in ordered:
            turns = F.when(F.col("layout") == layout.name, _turns(layout, at(layout))).otherwise(turns)
    by_row = F.coalesce(F.col("layout").isin([layout.name for layout in ordered]), F.lit(False))
    rows = found.where(~by_row).select("conv_id", F.posexplode_outer(turns).alias("place", "turn")).select("conv_id", "place", "turn.role", "turn.text")
    for layout in ordered:
        own = found.where(F.col("layout") == layout.name)
        number = F.try_variant_get("value", f"$.{layout.order}", "bigint")
        fields = [F.try_variant_get("value", f"$.{path}", "string").alias(path) for path in (layout.role, layout.text)]
        rows = rows.union(canonical(own.select("conv_id", number.alias(layout.order), *fields), "conv_id"))
    return rows


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted text and loss_spans (start, length) of the turns of each conversation."""
    turns = turns.where("place IS NOT NULL")  # what has no turns
    head = F.concat(F.lit(TURN_OPEN), escaped(F.col("role")), F.lit(ROLE_CLOSE))
    parts = turns.select("conv_id", "place", (F.col("role") == learned).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(TURN_CLOSE)))
    before = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.struct(start.cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))
    parts = parts.select("conv_id", "place", "piece", F.when(F.col("learned"), span).alias("span"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "span"))).alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_back(texts: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts as the formatted text and its mask alone give them."""
    pieces = F.split("formatted", TURN_CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(len(TURN_OPEN) + 1), F.length(piece)), r"\[/ROLE\]", 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    def masked(span: Column) -> Column:
        return unescaped(F.substring(F.col("formatted"), (span["start"] + 1).cast("int"), span["length"].cast("int")))

    return texts.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.transform("loss_spans", masked).alias("loss_texts"))
