"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space that separates words in every contract of this folder: space, tab, line feed, VT, FF, CR
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names; whatever else the table holds cannot clash."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run, *forget: Callable[[], None]) -> Run:
    """``run`` for mapInArrow; when a task ends, ``forget`` is called and freed memory goes back to the system.

    Python workers outlive tasks and stages, so what each leaves behind would add up.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for drop in forget:
                drop()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return whole


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that reruns and retried tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


@functools.lru_cache(maxsize=4)
def tokenizer_file(name_or_path: str) -> str:
    """A path as given; a bare file name is looked up among the installed public tokenizers of this machine."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
