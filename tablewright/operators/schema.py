"""Headers, column order and column roles: work on names, not on rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import constants as K
from tablewright.functions.dates import date_cell, parse_date
from tablewright.functions.names import bind, named
from tablewright.functions.text import (
    classify_contact,
    is_blank,
    plain_text,
    text_cell,
    ustrip,
)


BOOKKEEPING = frozenset(
    ("_row_id", "_source_file", "_source_order", "_removed_reason", "_fixes", "_reviews", "_bucket", "_chunk")
)


@dataclass(frozen=True)
class ContactRoles:
    name: str | None = None
    phone: str | None = None
    email: str | None = None
    date: str | None = None


@dataclass(frozen=True)
class SalesRoles:
    person: str | None = None
    amount: str | None = None
    qty: str | None = None
    product: str | None = None
    date: str | None = None


def normalize_header(name: object) -> str:
    return " ".join(str(name).split())


def distinct_headers(names: list[str | None]) -> list[str]:
    """Header cells as unique column names: empty ones are numbered, repeats get .1, .2, …

    A header that reads like one of our bookkeeping columns counts as a repeat
    of it, so it stays a column of the table.
    """
    out: list[str] = []
    taken: set[str] = set(BOOKKEEPING)
    for position, raw in enumerate(names):
        base = raw if raw else f"Unnamed: {position}"
        name, repeat = base, 0
        while name in taken:
            repeat += 1
            name = f"{base}.{repeat}"
        taken.add(name)
        out.append(name)
    return out


def _common_name(header: str, known: dict[str, str]) -> str:
    """The alias of a header by its lower-case spelling, else by its own; the header itself without one."""
    for spelling in (header.lower(), header):
        if spelling in known:
            return known[spelling]
    return header


def align_headers(names: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Common name of every header, in order; a name met again gets _2, _3, …"""
    known = K.HEADER_ALIASES if aliases is None else aliases
    last: dict[str, int] = {}  # the number each common name was last given
    given: dict[str, None] = {}
    for name in names:
        common = _common_name(normalize_header(name), known)
        number = last.get(common, 0) + 1
        numbered = common if number == 1 else f"{common}_{number}"
        while numbered in given:  # a header that reads like a numbered one
            number += 1
            numbered = f"{common}_{number}"
        last[common] = number
        given[numbered] = None
    return list(given)


def order_columns(left: list[str], right: list[str], keys: list[str]) -> list[str]:
    return [*keys, *sorted((set(left) | set(right)) - set(keys))]


def is_text_column(name: str, hints: tuple[str, ...] = K.TEXT_COLUMN_HINTS) -> bool:
    lowered = name.strip().lower()
    return any(hint in lowered for hint in hints)


def normalize_text_columns(df: DataFrame, hints: tuple[str, ...] = K.TEXT_COLUMN_HINTS) -> DataFrame:
    return df.select(
        *[
            text_cell(named(f.name), f.dataType).alias(f.name)
            if is_text_column(f.name, hints)
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def sink_cells(df: DataFrame, hints: tuple[str, ...] = K.TEXT_COLUMN_HINTS) -> DataFrame:
    """Cells as a result file shows them: identifiers as text, dates as ``YYYY-MM-DD`` text."""
    out = []
    for f in df.schema.fields:
        cell, dtype = named(f.name), f.dataType
        if is_text_column(f.name, hints):
            cell = text_cell(cell, dtype)
            dtype = dtype if isinstance(dtype, T.BooleanType) else T.StringType()
        out.append(date_cell(cell, dtype).alias(f.name))
    return df.select(*out)


def find_column(columns: list[str], hints: tuple[str, ...]) -> str | None:
    """The first hint that any header contains decides."""
    return next((c for hint in hints for c in columns if hint in c), None)


def contact_roles(columns: list[str]) -> ContactRoles:
    return ContactRoles(
        name=find_column(columns, K.NAME_HINTS),
        phone=find_column(columns, K.PHONE_HINTS),
        email=find_column(columns, K.EMAIL_HINTS),
        date=find_column(columns, K.DATE_HINTS),
    )


def sales_roles(columns: list[str]) -> SalesRoles:
    """Exact aliases first; a column taken by one is not taken again by a partial match."""
    exact = {
        role: next((c for a in aliases for c in columns if c.strip() == a), None)
        for role, aliases in K.SALES_ALIASES.items()
    }
    free = [c for c in columns if c not in exact.values()]
    return SalesRoles(**{role: exact[role] or find_column(free, aliases) for role, aliases in K.SALES_ALIASES.items()})


def suggest_dedupe_key(columns: list[str]) -> str | None:
    hinted = next((c for c in columns if K.DEDUPE_KEY_HINT in c), None)
    common = next((c for c in K.DEDUPE_KEY_PREFERENCE if c in columns), None)
    return hinted or common or (columns[0] if columns else None)


def suggest_latest_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(h in c for h in K.LATEST_COLUMN_HINTS)), None)


def suggest_compare_key(left: list[str], right: list[str]) -> str:
    shared = [c for c in left if c in set(right)]
    if not shared:
        raise ValueError("the two tables share no column")
    return next((c for c in shared if any(h in c for h in K.COMPARE_KEY_HINTS)), shared[0])


#: registers of a sketch of distinct cells, as a power of two: counts are within about 1 %
SKETCH_BITS = 14
#: what makes a column a key: distinct cells a row in both tables, shared cells of the smaller side
KEY_UNIQUE, KEY_SHARED = 0.9, 0.5


def key_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per shared column: what its header and its cells say for comparing the two tables by it.

    ``hinted`` is the header's word; ``unique_left`` and ``unique_right`` say that at least ``KEY_UNIQUE`` of the
    rows have a cell of their own; ``overlaps``, that both tables share at least ``KEY_SHARED`` of the cells of the
    side with fewer.  ``rank`` puts the column to compare by first: unique and overlapping ones, then
    overlapping ones, then hinted ones, then as they stand.  Distinct cells are counted by mergeable sketches:
    each table is read once, and one row of fixed size per column and partition is shuffled.
    Blank cells count as none.  Tables without rows have no cells that overlap.
    """
    shared = [c for c in data_columns(left) if c in set(data_columns(right))]
    if not shared:
        raise ValueError("the two tables share no column")

    def sketches(df: DataFrame, side: str) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        measures = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(shared):
            text = plain_text(named(c), types[c])
            cell = F.when(~is_blank(text, "compare"), ustrip(text))
            measures.append(F.hll_sketch_agg(cell, F.lit(SKETCH_BITS)).alias(f"s{i}"))
        cells = [F.struct(F.lit(i).alias("position"), F.col(f"s{i}").alias("sketch")) for i in range(len(shared))]
        return df.agg(*measures).select(F.lit(side).alias("side"), "rows", F.inline(F.array(*cells)))

    def of(side: str, value) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    distinct = F.hll_sketch_estimate("sketch")
    counts = sketches(left, "left").unionByName(sketches(right, "right")).groupBy("position").agg(
        *[of(side, F.col("rows")).alias(f"rows_{side}") for side in ("left", "right")],
        *[of(side, distinct).alias(f"cells_{side}") for side in ("left", "right")],
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cells"),
    )
    at = F.col("position") + 1
    hints = [any(h in c for h in K.COMPARE_KEY_HINTS) for c in shared]
    fewer = F.least("cells_left", "cells_right")
    facts = counts.select(
        F.element_at(F.lit(shared), at).alias("column"),
        "position",
        F.element_at(F.lit(hints), at).alias("hinted"),
        ((F.col("cells_left") > 0) & (F.col("cells_left") >= KEY_UNIQUE * F.col("rows_left"))).alias("unique_left"),
        ((F.col("cells_right") > 0) & (F.col("cells_right") >= KEY_UNIQUE * F.col("rows_right"))).alias("unique_right"),
        ((fewer > 0) & (F.col("cells_left") + F.col("cells_right") - F.col("cells") >= KEY_SHARED * fewer)).alias("overlaps"),
    )
    key = F.col("unique_left") & F.col("unique_right") & F.col("overlaps")
    # one row per column of a header
    order = W.orderBy(key.desc(), F.col("overlaps").desc(), F.col("hinted").desc(), "position")
    return facts.withColumn("rank", F.row_number().over(order))


def require_columns(df: DataFrame, names: list[str | None], what: str) -> None:
    missing = [n for n in names if not n or n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found in the table: {', '.join(str(m) for m in missing)}")


def data_columns(df: DataFrame) -> list[str]:
    """Columns that belong to the table itself, not to our bookkeeping."""
    return [c for c in df.columns if c not in BOOKKEEPING]


def refuse_reserved(df: DataFrame, allowed: tuple[str, ...] = ("_row_id", "_source_file", "_source_order")) -> DataFrame:
    """``df`` as it is, or an error if it brings columns under names a job keeps for its own."""
    clash = sorted(BOOKKEEPING.intersection(df.columns).difference(allowed))
    if clash:
        raise ValueError(f"rename these columns first, their names are reserved: {', '.join(clash)}")
    return df


def restored_header(name: str, others: list[str]) -> str:
    """A header that a scan had to tell apart from bookkeeping, as it stood in the file."""
    plain = name.removesuffix(".1")
    return plain if plain in BOOKKEEPING and plain not in others else name


def role_profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column: the role its header suggests and what its cells look like."""
    columns = data_columns(df)
    contact, sales = contact_roles(columns), sales_roles(columns)
    roles = {
        c: ",".join(
            [r for r in ("name", "phone", "email", "date") if getattr(contact, r) == c]
            + [f"sales_{r}" for r in K.SALES_ALIASES if getattr(sales, r) == c]
            + (["dedupe_key"] if suggest_dedupe_key(columns) == c else [])
            + (["latest"] if suggest_latest_column(columns) == c else [])
        )
        for c in columns
    }
    types = {f.name: f.dataType for f in df.schema.fields}
    # classify once per cell below the aggregate
    cells = bind(
        df.select(*[named(c) for c in columns]),
        {
            f"p{i}": F.struct(
                classify_contact(plain_text(named(c), types[c])).alias("kind"),
                parse_date(named(c), types[c]).isNotNull().alias("is_date"),
            )
            for i, c in enumerate(columns)
        },
    )
    measures = []
    for i in range(len(columns)):
        measures += [
            F.count_if(F.col(f"p{i}.kind") == kind).alias(f"p{i}_{kind}")
            for kind in ("blank", "phone", "email", "name", "unknown")
        ]
        measures.append(F.count_if(F.col(f"p{i}.is_date")).alias(f"p{i}_date"))
        if distinct:
            measures.append(F.approx_count_distinct(named(columns[i])).alias(f"p{i}_distinct"))
    kinds = ["blank", "phone", "email", "name", "unknown", "date"] + (["distinct"] if distinct else [])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                F.lit(roles[c]).alias("role"),
                *[F.col(f"p{i}_{k}").alias(f"{k}_cells" if k != "distinct" else "distinct_cells") for k in kinds],
            )
            for i, c in enumerate(columns)
        ]
    )
    return cells.agg(*measures).select(F.inline(rows))


def blank_row(df: DataFrame, columns: list[str] | None = None):
    """Condition: every data cell is blank."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = [
        is_blank(named(c), "clean")
        if isinstance(types[c], T.StringType)
        else is_blank(plain_text(named(c), types[c]), "clean")
        for c in (columns or data_columns(df))
    ]
    return reduce(lambda a, b: a & b, tests)
