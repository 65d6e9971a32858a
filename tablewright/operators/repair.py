"""Repairs of contact and date cells with a per-row audit.

Each step binds one struct column, so an expensive intermediate is computed once
and read by field.  Nothing here shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import fix_date, parse_date
from tablewright.functions.names import bind, named
from tablewright.functions.shift import (
    BITS,
    KINDS,
    KNOWN,
    blocked_slots,
    found_kinds,
    kind_bit,
    kinds_met_twice,
    misplaced_kinds,
    moved_value,
)
from tablewright.functions.text import (
    fix_email,
    fix_phone,
    is_blank,
    plain_text,
    ustrip,
)
from tablewright.operators.schema import ContactRoles

FIX_TYPE = "array<struct<seq:int,field:string,old:string,new:string,reason:string>>"
REVIEW_TYPE = "array<struct<field:string,reason:string>>"


@dataclass(frozen=True)
class RepairSteps:
    trim_names: bool = True
    move_shifted: bool = False
    phones: bool = False
    emails: bool = False
    dates: bool = False
    required: bool = False
    strict_shift: bool = False


def role_slots(df: DataFrame, roles: ContactRoles) -> dict[str, Column]:
    """Text of the contact columns that the table has."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = {k: getattr(roles, k) for k in KINDS if getattr(roles, k)}
    return {k: plain_text(named(c), types[c]) for k, c in present.items()}


def plan_shift(df: DataFrame, slots: list[str], source: str = "_was", strict: bool = False) -> DataFrame:
    """Add ``_kind`` (kind bits) and ``_shift`` for the contact values held in struct ``source``.

    ``_shift`` holds problem, fixed and the moved values.  Values move only when
    each kind occurs once and no unrecognised text stands where one belongs.  A
    foreign value whose own column does not exist is blanked, or with ``strict``
    reported and left alone.
    """
    values = {k: F.col(f"{source}.{k}") for k in slots}
    kinds = {k: F.col(f"_kind.{k}") for k in slots}
    work = bind(df, {"_kind": F.struct(*[kind_bit(values[k]).alias(k) for k in slots])})
    work = bind(work, {"_found": found_kinds(kinds)})
    work = bind(
        work,
        {
            "_twice": kinds_met_twice(kinds) > 0,
            "_misplaced": misplaced_kinds(kinds) > 0,
            "_blocked": blocked_slots(kinds, F.col("_found"), strict) > 0,
        },
    )
    problem = F.when(F.col("_twice"), F.lit("shift_ambiguous")).when(
        F.col("_misplaced") & F.col("_blocked"), F.lit("shift_unrecognised")
    )
    work = bind(work, {"_problem": problem, "_fixed": F.expr("_misplaced AND NOT _twice AND NOT _blocked")})
    moved = [
        (
            F.when(F.col("_fixed"), moved_value(k, values, kinds, F.col("_found"))).otherwise(values[k])
            if k in values
            else F.lit(None).cast("string")
        ).alias(k)
        for k in KINDS
    ]
    shift = F.struct(F.col("_problem").alias("problem"), F.col("_fixed").alias("fixed"), *moved)
    return bind(work, {"_shift": shift})


Entry = tuple[Column, Column]  # (condition, audit struct)


def _fix(seq: int, field: str, old: Column, new: Column, reason: str, when: Column) -> Entry:
    entry = F.struct(
        F.lit(seq).alias("seq"),
        F.lit(field).alias("field"),
        old.alias("old"),
        new.alias("new"),
        F.lit(reason).alias("reason"),
    )
    return when, entry


def _review(field: str, reason: Column, when: Column | None = None) -> Entry:
    entry = F.struct(F.lit(field).alias("field"), reason.alias("reason"))
    return reason.isNotNull() if when is None else when & reason.isNotNull(), entry


def _present(entries: list[Entry], kind: str) -> Column:
    """Array of the entries whose condition holds.

    Concatenation of one-element arrays compiles; dropping nulls from an array
    afterwards would be interpreted row by row.
    """
    none = F.array().cast(kind)
    if not entries:
        return none
    return F.concat(*[F.when(condition, F.array(entry).cast(kind)).otherwise(none) for condition, entry in entries])


def repair_contacts(df: DataFrame, roles: ContactRoles, steps: RepairSteps) -> DataFrame:
    """Repair the role columns in place; add ``_fixes`` and ``_reviews``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    original = role_slots(df, roles)
    slots = list(original)
    column_of = {k: getattr(roles, k) for k in slots}
    fixes: list[Entry] = []
    reviews: list[Entry] = []
    work = df

    if slots:
        # the name is trimmed before anything looks at it
        trim = steps.trim_names and "name" in slots and isinstance(types[column_of["name"]], T.StringType)
        work = bind(work, {"_raw": F.struct(*[c.alias(k) for k, c in original.items()])})
        first = {k: F.col(f"_raw.{k}") for k in slots}
        if trim:
            raw_name = first["name"]
            first["name"] = F.when(is_blank(raw_name), raw_name).otherwise(ustrip(raw_name))
        work = bind(work, {"_was": F.struct(*[c.alias(k) for k, c in first.items()])})
        if trim:
            old, new = F.col("_raw.name"), F.col("_was.name")
            fixes.append(_fix(1, column_of["name"], old, new, "fix_trim", new != old))

    now = {k: F.col(f"_was.{k}") for k in slots}
    problem = F.lit(None).cast("string")
    if steps.move_shifted and slots:
        work = plan_shift(work, slots, "_was", steps.strict_shift)
        problem = F.col("_shift.problem")
        for seq, k in enumerate(slots, start=2):
            kind, becomes = F.col(f"_kind.{k}"), F.col(f"_shift.{k}")
            filled = (kind == 0) & (F.col("_found").bitwiseAND(BITS[k]) > 0)
            foreign = kind.bitwiseAND(KNOWN & ~BITS[k]) > 0
            was = F.when(kind == 0, F.lit("")).otherwise(F.col(f"_was.{k}"))
            fixes.append(_fix(seq, column_of[k], was, becomes, "fix_shift", F.col("_shift.fixed") & (filled | foreign)))
            reviews.append(_review(column_of[k], problem, ~kind.isin(0, BITS[k])))
            now[k] = becomes

    repaired: list[Column] = []
    untouched = problem.isNull()  # rows under shift review keep phone and email as they are
    if slots:
        checked = {f"check_{k}": F.when(untouched, now[k]) for k in ("phone", "email") if k in slots}
        work = bind(work, {"_now": F.struct(*[c.alias(k) for k, c in {**now, **checked}.items()])})
        now = {k: F.col(f"_now.{k}") for k in slots}
    for k, wanted, fixer in (("phone", steps.phones, fix_phone), ("email", steps.emails, fix_email)):
        if wanted and k in slots:
            repaired.append(fixer(F.col(f"_now.check_{k}")).alias(k))
    date_column = roles.date if steps.dates else None
    if date_column:
        work = bind(work, {"_day": parse_date(named(date_column), types[date_column])})
        repaired.append(fix_date(named(date_column), F.col("_day"), types[date_column]).alias("date"))
    if repaired:
        work = bind(work, {"_fix": F.struct(*repaired)})

    for seq, k, wanted, reason in (
        (5, "phone", steps.phones, "fix_phone"),
        (6, "email", steps.emails, "fix_email"),
    ):
        if not (wanted and k in slots):
            continue
        done = F.col(f"_fix.{k}.fixed")
        new = F.when(done, F.col(f"_fix.{k}.value")).otherwise(now[k])
        fixes.append(_fix(seq, column_of[k], now[k], new, reason, done))
        reviews.append(_review(column_of[k], F.col(f"_fix.{k}.problem")))
        now[k] = new
    out = {column_of[k]: c for k, c in now.items() if _touched(k, steps, types[column_of[k]])}
    if date_column:
        old = plain_text(named(date_column), types[date_column])
        fixes.append(_fix(7, date_column, old, F.col("_fix.date.value"), "fix_date", F.col("_fix.date.fixed")))
        reviews.append(_review(date_column, F.col("_fix.date.problem")))
        if date_column not in column_of.values():
            out[date_column] = F.col("_fix.date.value")
    if steps.required:
        for k in ("name", "phone"):
            if k in slots:
                reviews.append((is_blank(now[k]), _review(column_of[k], F.lit(f"missing_{k}"))[1]))

    after = {f"_new{i}": c for i, c in enumerate(out.values())}
    # one bind each: a generated method past 8 KB would be left to the bytecode interpreter
    work = bind(work, {**after, "_reviews": _present(reviews, REVIEW_TYPE)})
    work = bind(work, {"_fixes": _present(fixes, FIX_TYPE)})
    renamed = dict(zip(out, after))
    return work.select(
        *[F.col(renamed[c]).alias(c) if c in renamed else named(c) for c in df.columns], "_fixes", "_reviews"
    )


def _touched(slot: str, steps: RepairSteps, dtype: T.DataType) -> bool:
    if steps.move_shifted:
        return True
    if slot == "name":
        return steps.trim_names and isinstance(dtype, T.StringType)
    return steps.phones if slot == "phone" else steps.emails


def review_reasons(reviews: Column) -> Column:
    """Distinct reasons of a row in the order they were found."""
    return F.array_distinct(reviews["reason"])


def row_markers(fixes: Column, reviews: Column, fixed: str = "fixed", to_review: str = "to_review") -> Column:
    return F.concat_ws(
        "；",
        F.when(F.size(fixes) > 0, F.lit(fixed)),
        F.when(F.size(reviews) > 0, F.lit(to_review)),
    )
