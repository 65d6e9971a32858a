"""The five table jobs: each returns its result and its audit tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.constants import DEFAULT_ROWS_PER_CHUNK, LABELS
from tablewright.functions.names import named, option
from tablewright.functions.text import label_text
from tablewright.operators import compare as cmp
from tablewright.operators import merge as mrg
from tablewright.operators import sales as sls
from tablewright.operators import split as spl
from tablewright.operators.dedupe import (
    REASON,
    keep_mode,
    mark_blank_rows,
    mark_duplicates,
    recency,
    split_kept_removed,
)
from tablewright.operators.identity import ROW_ID, global_position, rank_rows, spread, with_row_id
from tablewright.operators.quality import health_score, quality_profile
from tablewright.operators.repair import RepairSteps, repair_contacts, review_reasons, row_markers
from tablewright.operators.schema import (
    ContactRoles,
    SalesRoles,
    contact_roles,
    data_columns,
    normalize_text_columns,
    refuse_reserved,
    require_columns,
    sales_roles,
)
from tablewright.operators.staging import stage


@dataclass(frozen=True)
class JobResult:
    """``result`` is for handing on, ``report`` for internal review."""

    result: DataFrame
    report: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class CleanOptions:
    drop_duplicates: bool = False
    drop_blank_rows: bool = False
    dedupe_columns: tuple[str, ...] = ()
    dedupe_keep: str = "first"
    dedupe_latest_column: str | None = None
    check_shifted_rows: bool = False
    fix_phone: bool = False
    fix_email: bool = False
    fix_dates: bool = False
    check_required_fields: bool = False
    trim_spaces: bool = True
    strict_shift: bool = False
    unparseable: str = "text"

    def chosen(self) -> bool:
        return any(
            (
                self.drop_duplicates,
                self.drop_blank_rows,
                self.dedupe_columns,
                self.check_shifted_rows,
                self.fix_phone,
                self.fix_email,
                self.fix_dates,
                self.check_required_fields,
                self.trim_spaces,
            )
        )

    def steps(self) -> RepairSteps:
        return RepairSteps(
            trim_names=self.trim_spaces,
            move_shifted=self.check_shifted_rows,
            phones=self.fix_phone,
            emails=self.fix_email,
            dates=self.fix_dates,
            required=self.check_required_fields,
            strict_shift=self.strict_shift,
        )


def _keeps_latest(options: CleanOptions) -> bool:
    return bool(options.dedupe_columns) and keep_mode(options.dedupe_keep) == "latest"


def mark_cleaned(df: DataFrame, options: CleanOptions, roles: ContactRoles | None = None) -> DataFrame:
    """Every input row repaired, with ``_fixes``, ``_reviews`` and ``_removed_reason``.

    Rows are dealt out evenly before they are repaired.  The repaired rows are
    written once, and so are the groups that lose a row; whoever reads the result scans those, so nothing is repaired or grouped twice.
    """
    if not options.chosen():
        raise ValueError("choose at least one cleaning step")
    if options.dedupe_columns:
        require_columns(df, list(options.dedupe_columns), "dedupe column")
    if _keeps_latest(options):
        require_columns(df, [options.dedupe_latest_column], "date column for keeping the latest row")
    roles = roles or contact_roles(data_columns(df))
    marked = mark_blank_rows(df) if options.drop_blank_rows else df
    repaired = stage(repair_contacts(spread(marked), roles, options.steps()), "repaired")
    return mark_duplicates(
        repaired,
        full=options.drop_duplicates,
        key_columns=list(options.dedupe_columns),
        keep=options.dedupe_keep,
        latest_column=options.dedupe_latest_column,
        unparseable=options.unparseable,
        staged=True,
    )


def with_result_row(kept: DataFrame, options: CleanOptions, name: str = "result_row") -> DataFrame:
    """1-based row number in the cleaned result.

    Keeping the latest row leaves the result in old-to-new order; otherwise rows
    stay in table order.
    """
    if _keeps_latest(options):
        age = recency(kept, options.dedupe_latest_column, options.unparseable)
        return rank_rows(kept.withColumn("_recency", age), [F.col("_recency"), F.col(ROW_ID)], name).drop("_recency")
    numbered = global_position(kept, ROW_ID, name)
    return numbered.withColumn(name, F.col(name) + 1)


def fix_log(kept: DataFrame) -> DataFrame:
    """One row per repair of a surviving row."""
    return kept.select("result_row", F.inline("_fixes")).select("result_row", "field", "seq", "old", "new", "reason")


def review_table(kept: DataFrame, columns: list[str]) -> DataFrame:
    """Rows to look at by hand, with their reasons."""
    flagged = kept.filter(F.size("_reviews") > 0)
    return flagged.select("result_row", review_reasons(F.col("_reviews")).alias("reasons"), *[named(c) for c in columns])


def clean_summary(marked: DataFrame) -> DataFrame:
    """One row of counts over the marked table."""
    kept = F.col(REASON).isNull()

    def removed(reason: str) -> Column:
        return F.count_if(F.col(REASON) == reason)

    return marked.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(kept).alias("cleaned_rows"),
        F.count_if(~kept).alias("deleted_rows"),
        removed("blank_row").alias("blank_deleted"),
        removed("full_duplicate").alias("duplicate_deleted"),
        removed("key_duplicate").alias("field_deleted"),
        F.coalesce(F.sum(F.when(kept, F.size("_fixes"))), F.lit(0)).cast("bigint").alias("fixed_cells"),
        F.count_if(kept & (F.size("_reviews") > 0)).alias("review_rows"),
    )


def clean_table(df: DataFrame, options: CleanOptions, roles: ContactRoles | None = None) -> JobResult:
    """Profile, repair, dedupe and audit one table.

    The repaired rows are written once, the numbered result once; the report
    tables read those, each only the columns it needs.
    """
    table = normalize_text_columns(with_row_id(refuse_reserved(df)))
    columns = data_columns(table)
    roles = roles or contact_roles(columns)
    marked = mark_cleaned(table, options, roles)
    kept, removed = split_kept_removed(marked)
    # the numbered rows serve the result, the fix log and the review tables; ranking
    # by recency has staged them already
    numbered = with_result_row(kept, options)
    if not _keeps_latest(options):
        numbered = stage(numbered, "cleaned-rows")
    markers = row_markers(F.col("_fixes"), F.col("_reviews"))
    report = {
        "quality": health_score(quality_profile(table.select(*[named(c) for c in columns]), roles)),
        "review_view": numbered.select("result_row", markers.alias("marker"), *[named(c) for c in columns]),
        "fixed": fix_log(numbered),
        "review": review_table(numbered, columns),
        "removed": removed.select(REASON, *[named(c) for c in columns], ROW_ID),
        "summary": clean_summary(marked),
    }
    return JobResult(numbered.select(*[named(c) for c in columns], F.col("result_row").alias(ROW_ID)), report)


def removal_text(code: Column, options: CleanOptions) -> Column:
    keyed = LABELS["key_duplicate"].format(
        key=" + ".join(options.dedupe_columns), keep=LABELS[keep_mode(options.dedupe_keep)]
    )
    return label_text(code, {k: LABELS[k] for k in ("blank_row", "full_duplicate")} | {"key_duplicate": keyed})


CODED = ("reason", REASON, "level", "advice", "note", "_status", "marker", "reasons")


def with_wording(table: DataFrame) -> DataFrame:
    """Replace the codes of a report table by the wording people read."""

    def worded(name: str) -> Column:
        cell = named(name)
        if name == "reasons":
            return F.array_join(F.transform(cell, lambda r: label_text(r, LABELS)), "；")
        if name == "marker":
            for code in ("fixed", "to_review"):
                cell = F.replace(cell, F.lit(code), F.lit(LABELS[code]))
            return cell
        return label_text(cell, LABELS)

    return table.select(*[worded(c).alias(c) if c in CODED else named(c) for c in table.columns])


def merge_job(
    groups: list[mrg.HeaderGroup], add_source: bool = True, aliases: dict[str, str] | None = None
) -> JobResult:
    """Merge sources by aligned column name; sources without rows are left out of the audit."""
    # a few counts per source and column: written once, read by three audit tables
    stats = stage(mrg.null_stats(groups, add_source, aliases), "fill")
    warnings = mrg.alignment_warnings(stats)
    report = {
        "summary": mrg.merge_summary(stats, warnings, add_source),
        "warnings": mrg.warning_text(warnings),
        "groups": mrg.alignment_groups(stats),
        "headers": mrg.header_matrix(groups, stats, aliases),
        "null_stats": stats,
    }
    return JobResult(mrg.merge_tables(groups, add_source, aliases), report)


def split_job(
    df: DataFrame,
    mode: str = "column",
    column: str | None = None,
    rows: int = DEFAULT_ROWS_PER_CHUNK,
    sources: list[str] | None = None,
) -> JobResult:
    """Split by field or by row count; the result carries its part in ``_bucket`` or ``_chunk``.

    Tables read from several sheets or files split by them with
    ``mode="sheet"``: the part is ``_source_file``.  ``sources`` names the
    sheets that were read, so that those without rows are reported.
    The report holds ``manifest``, ``warnings`` and ``summary``, and for a
    field ``review``, the rows that lack it.
    """
    mode = option(mode or "column", ("column", "sheet", "rows"))
    if mode is None:
        raise ValueError("split mode must be column, sheet or rows")
    table = with_row_id(refuse_reserved(df))
    empty = None
    if mode == "rows":
        result = spl.chunk_by_rows(table, rows)
        manifest = spl.chunk_manifest(table.sparkSession, table.count(), rows)
    else:
        field_name = column if mode == "column" else mrg.SOURCE
        require_columns(table, [field_name], "split column")
        # a row per part, read by three report tables and the writer
        manifest = stage(spl.group_sequence(spl.split_manifest(table, field_name)), "manifest")
        result = spl.with_bucket(table, field_name)
        if mode == "sheet" and sources is not None:
            known = table.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(sources)], "name string")
            empty = known.join(manifest, F.col("name") == F.col("value"), "left_anti")
    warnings = spl.split_warnings(manifest, empty)
    report = {
        "manifest": manifest,
        "warnings": spl.split_warning_text(warnings),
        "summary": spl.split_summary(manifest, warnings),
    }
    if mode == "column":
        report["review"] = spl.split_blank_key(table, field_name)[1]
    return JobResult(result, report)


def compare_job(a: DataFrame, b: DataFrame, keys: list[str]) -> JobResult:
    """Difference list, with only-A, only-B, changed and a summary."""
    left, right = (with_row_id(normalize_text_columns(refuse_reserved(t))) for t in (a, b))
    columns = cmp.compared_columns(left, right, keys)
    # counted on their way to the stage, which holds differences alone
    seen = Observation("compared")
    pairs = cmp.statuses(left, right, keys).observe(seen, *cmp.summary_counts())
    compared = stage(cmp.with_cells(pairs.filter(F.col("_status") != "same"), left, right, keys), "compared")
    counts = [F.lit(n).cast("bigint").alias(name) for name, n in seen.get.items()]
    report = {
        "summary": compared.sparkSession.range(1).select(*counts),
        "only_a": cmp.only_a(compared, columns),
        "only_b": cmp.only_b(compared, columns),
        "changed": cmp.changed_rows(compared, columns),
    }
    return JobResult(cmp.difference_list(compared, columns), report)


def sales_report(df: DataFrame, roles: SalesRoles | None = None) -> JobResult:
    """Totals per person (the result), product and month."""
    roles = roles or sales_roles(data_columns(df))
    rows = sls.sales_rows(df, roles)
    report = {
        "product": sls.sales_by_product(rows),
        "month": sls.sales_by_month(rows),
        "coerced": sls.coerced_amounts(df, roles.amount),
        "source_rows": df,
    }
    return JobResult(sls.sales_by_person(rows), report)
