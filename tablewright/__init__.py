"""Merge, split, clean, compare and summarise tables with Spark DataFrames."""

from tablewright.operators.schema import ContactRoles, SalesRoles
from tablewright.plans.jobs import (
    CleanOptions,
    clean_table,
    compare_job,
    merge_job,
    sales_report,
    split_job,
    with_wording,
)
from tablewright.sources.files import discover_tables, scan_many, scan_table
from tablewright.sources.sinks import output_layout, split_files, write_report, write_result, write_split
from tablewright.sources.workbook import scan_workbooks

__all__ = [
    "CleanOptions",
    "ContactRoles",
    "SalesRoles",
    "clean_table",
    "compare_job",
    "discover_tables",
    "merge_job",
    "output_layout",
    "sales_report",
    "scan_many",
    "scan_table",
    "scan_workbooks",
    "split_files",
    "split_job",
    "with_wording",
    "write_report",
    "write_result",
    "write_split",
]
