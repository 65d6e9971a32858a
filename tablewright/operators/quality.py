"""Data-health profile of a table before it is cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_date
from tablewright.functions.names import bind, named
from tablewright.functions.shift import BITS, UNKNOWN
from tablewright.functions.text import fix_email, fix_phone, is_blank, plain_text
from tablewright.operators.repair import plan_shift, role_slots
from tablewright.operators.schema import ContactRoles, blank_row, contact_roles, data_columns

# measure: (highest deduction, weight)
PENALTIES = {
    "blank_rows": (25, 100),
    "dup_rows": (25, 80),
    "shifted": (20, 120),
    "bad_phone": (15, 100),
    "bad_email": (10, 80),
    "bad_date": (10, 80),
    "missing_key": (15, 100),
}


def quality_profile(df: DataFrame, roles: ContactRoles | None = None) -> DataFrame:
    """One row of problem counts.

    Identical rows are folded first (with map-side combine), so one shuffle
    serves the duplicate count and every other measure is taken once per
    distinct row and weighted by its copies.
    """
    columns = data_columns(df)
    roles = roles or contact_roles(columns)
    folded = df.groupBy(*[named(c) for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    types = {f.name: f.dataType for f in df.schema.fields}
    slots = role_slots(df, roles)

    tests: dict[str, Column] = {m: F.lit(False) for m in PENALTIES}
    tests["blank_rows"] = blank_row(df, columns)
    work = folded
    if slots:
        work = bind(work, {"_was": F.struct(*[c.alias(k) for k, c in slots.items()])})
        work = plan_shift(work, list(slots))
        checks = [
            fixer(F.col(f"_was.{k}"))["problem"].isNotNull().alias(k)
            for k, fixer in (("phone", fix_phone), ("email", fix_email))
            if k in slots
        ]
        if checks:
            work = bind(work, {"_bad": F.struct(*checks)})
        tests["shifted"] = F.col("_shift.fixed") | F.col("_shift.problem").isNotNull()
        for k in ("phone", "email"):
            if k in slots:
                # another contact kind in the cell counts as shifted, not as bad
                kind = F.col(f"_kind.{k}")
                tests[f"bad_{k}"] = ((kind == BITS[k]) & F.col(f"_bad.{k}")) | (kind == UNKNOWN)
        missing = [is_blank(F.col(f"_was.{k}")) for k in ("name", "phone") if k in slots]
        if missing:
            tests["missing_key"] = missing[0] | missing[-1]
    if roles.date:
        cell = plain_text(named(roles.date), types[roles.date])
        tests["bad_date"] = ~is_blank(cell) & parse_date(named(roles.date), types[roles.date]).isNull()

    flagged = bind(work, {m: t for m, t in tests.items() if m != "dup_rows"})
    copies = F.col("_copies")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return flagged.agg(
        total(copies).alias("total"),
        *[
            total(copies - 1).alias(m) if m == "dup_rows" else total(F.when(F.col(m), copies).otherwise(0)).alias(m)
            for m in PENALTIES
        ],
    )


def health_score(profile: DataFrame) -> DataFrame:
    """Add ``score`` (0-100), ``level`` and ``advice`` to a quality profile."""
    score = F.lit(100.0)
    for measure, (cap, weight) in PENALTIES.items():
        # ratio first, weight second, then half-even rounding
        score = score - F.least(F.lit(float(cap)), F.rint(F.col(measure) / F.col("total") * F.lit(float(weight))))
    bounded = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(F.lit(100.0))
    scored = profile.withColumn("score", bounded.cast("int"))
    level = F.when(F.col("score") >= 85, F.lit("good")).when(F.col("score") >= 60, F.lit("fair")).otherwise(F.lit("poor"))
    return scored.withColumn("level", level).withColumn("advice", F.concat(F.lit("advice_"), F.col("level")))
