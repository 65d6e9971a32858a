"""Column references for arbitrary header text, and columns computed once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Reference a column whose header may hold dots, spaces or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: list[str], name: str) -> str:
    """``name``, or as many underscores more as it takes to be none of ``taken``."""
    folded = {c.lower() for c in taken}
    while name.lower() in folded:
        name += "_"
    return name


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under positional names (x0, x1, …), which no working column has, and the new name of each column."""
    names = {c: f"x{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns that later steps read as plain attributes.

    A ``select`` would do for the result, but the optimizer inlines projected
    expressions into every later use and into pushed-down filters, and layered
    repairs then grow exponentially.  Generating the one row keeps each
    expression evaluated once, inside whole-stage code, while filters on the
    original columns still move below it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def option(given: str | None, choices: tuple[str, ...]) -> str | None:
    """The choice a caller names, whatever the case and the space around it; null if it names none."""
    folded = {c.casefold(): c for c in choices}
    return folded.get(given.strip().casefold()) if given else None
