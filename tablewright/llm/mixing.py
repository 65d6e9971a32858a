"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every source has a target number of words.  A document of a source is to be
taken target / source size times: a whole number of copies and a fraction.
Fractions become copies by the pivotal method: two documents meet, words move
from the chance of one to the chance of the other, in a direction drawn so
that neither chance changes on average, until one chance is 0 or 1.  The other
document, the residual, meets the next.  The words expected of the pair stay
exactly the same, so a source misses its target by less than one document.

The tree.  Documents meet in blocks of about ``BLOCK`` (by a hash of the row,
so a source with a third of all rows is many blocks); the residuals of
``FAN_IN`` blocks meet in a group of the next level, and so on until each
source has one residual.  A level holds a ``FAN_IN``-th of the rows of the one
below.  The last residual tends to be a long document.  So about ``POOL``
documents of each power of two of length stay out of the tree, chosen by hash,
and meet it last, the longest first: it becomes integral among documents
somewhat shorter than itself, the next residual likewise, and the one that is
drawn in the end is among the shortest.

Draws depend on the rows alone: reruns and retried tasks agree.  Null sources
are a source of their own, last in order.  A document without words (null,
empty, blank) takes none and has no copies.  Rows that repeat each other are
drawn one by one.  Without any words all targets are 0.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD_PATTERN, uniform
from tablewright.operators.identity import rank_rows
from tablewright.operators.staging import stage

BLOCK = 128
FAN_IN = 64
POOL = 64
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 33
#: sources up to so many are broadcast (under 10 MB: place, four numbers and a name each); more are joined by shuffling
BROADCAST_SOURCES = 50_000
SALTS = 16

TOP = -1  # where the residual of the tree stands among the documents of the pool
ITEM = "struct<hash:bigint,at:bigint,size:double,chance:double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def row_hash(doc_id: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, source, text)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``place`` (order of sources), ``weight`` and ``target`` to (source, source_size, ...), one row per source.

    Shares beyond ``cap`` times a source are dealt again, by weight, among the
    sources below it, until none is above.  A round is one aggregate over the
    sources; only its sums come to the driver.
    """
    placed = rank_rows(sources, [F.col("source").asc_nulls_last()], "place", start=0)
    by_place = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stage(placed.withColumn("weight", by_place.cast("bigint")), "weights")
    total, parts = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, parts, full = total or 0, parts or 0, -1

    def above(rest: int, parts: int) -> Column:
        return F.col("source_size") * cap * parts < F.col("weight") * F.lit(float(rest))

    while parts:
        at_cap = above(rest, parts)
        n, capped, weight = rows.agg(
            F.count_if(at_cap),
            F.sum(F.when(at_cap, F.col("source_size") * cap).otherwise(0)),
            F.sum(F.when(at_cap, 0).otherwise(F.col("weight"))),
        ).first()
        if n == full:
            break
        full, rest, parts = n, (total or 0) - capped, weight
    if parts:
        share = F.when(above(rest, parts), (F.col("source_size") * cap).cast("double"))
        share = share.otherwise(F.col("weight") * F.lit(float(rest)) / F.lit(float(parts)))
    else:
        share = (F.col("source_size") * cap).cast("double")
    return rows.withColumn("target", share)


def _meet(state: Column, item: Column) -> Column:
    """The residual ``state`` meets ``item``: one of the two becomes integral, the other is the new residual."""
    a, b = state["rest"], item
    up = F.least(a["size"] * (1 - a["chance"]), b["size"] * b["chance"])  # words that can move to a
    down = F.least(a["size"] * a["chance"], b["size"] * (1 - b["chance"]))  # words that can move to b
    to_a = uniform(F.lit(SEED), a["hash"], b["hash"]) < F.coalesce(F.try_divide(down, up + down), a["chance"])
    a_done = F.when(to_a, a["size"] * (1 - a["chance"]) <= b["size"] * b["chance"])
    a_done = a_done.otherwise(a["size"] * a["chance"] <= b["size"] * (1 - b["chance"]))
    moved = F.when(to_a, up).otherwise(-down)

    def left(x: Column, words: Column) -> Column:
        chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["chance"] + words / x["size"]))
        return F.struct(x["hash"].alias("hash"), x["at"].alias("at"), x["size"].alias("size"), chance.alias("chance"))

    done_at = F.when(a_done, a["at"]).otherwise(b["at"])
    one = to_a == a_done  # words that move to a leave a at 1 or b at 0; the other way a at 0 or b at 1
    ones = F.when(one, F.array_append(state["ones"], done_at)).otherwise(state["ones"])
    return F.struct(F.when(a_done, left(b, -moved)).otherwise(left(a, moved)).alias("rest"), ones.alias("ones"))


def _rounded(items: Column) -> Column:
    """(rest, ones): the residual of a block and where in it the chosen ones are."""
    start = F.struct(items[0].alias("rest"), F.array().cast("array<bigint>").alias("ones"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, _meet)


def copies(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """Per row: doc_id, row_hash, source, size, source_size, target and copies (0 to ``cap``)."""
    read = df.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        row_hash(F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`")).alias("row_hash"),
    )
    slim = stage(read, "sizes")
    power = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")
    lengths = F.array(*(F.count_if((F.col("size") > 0) & (power == k)) for k in range(32)))  # a text has under 2**31 words
    found = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("worded"), lengths.alias("lengths"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    sources = targets(found, weights, cap).select(
        F.col("source").alias("of_source"),
        "place",
        "source_size",
        "target",
        F.floor(ratio).cast("bigint").alias("whole"),
        (ratio - F.floor(ratio)).alias("chance"),
        F.greatest(F.ceil(F.col("worded") / BLOCK), F.lit(1)).alias("blocks"),
        "lengths",
    )
    sources = stage(sources, "sources")
    n_sources, most = sources.agg(F.count("*"), F.max("blocks")).first()
    if n_sources <= BROADCAST_SOURCES:
        joined = slim.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of_source")))
    else:  # a source's rows go to several tasks, each with its own copy of the source's row
        salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = slim.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("source").eqNullSafe(F.col("of_source")) & (rows["salt"] == salted["salt"])).drop("salt")
    shown = ["doc_id", "row_hash", "source", "size"]
    pooled = uniform(F.lit(SEED + 1), F.col("row_hash")) * F.element_at("lengths", power + 1) < POOL
    joined = joined.withColumn("block", F.when(pooled, F.lit(-1)).otherwise(F.pmod("row_hash", F.col("blocks"))))

    row = F.struct((-F.col("size")).alias("longest_first"), "row_hash", "doc_id", "source", "size")
    blocks = joined.where("size > 0").groupBy("place", "block")
    blocks = blocks.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("chance").alias("chance"))
    items = F.transform(
        "rows",
        lambda x, i: F.struct(
            F.xxhash64(x["row_hash"], i).alias("hash"), i.cast("bigint").alias("at"), x["size"].cast("double").alias("size"), F.col("chance").alias("chance")
        ),
    )
    blocks = stage(blocks.select("place", "block", "rows", items.cast(f"array<{ITEM}>").alias("items")), "blocks")
    base = stage(blocks.where("block >= 0").select("place", "block", "rows", _rounded(F.col("items")).alias("done")), "rounded")

    level = base.select("place", F.col("block").alias("part"), "block", F.col("done.rest.hash").alias("hash"), *(F.col(f"done.rest.{c}").alias(c) for c in ("size", "chance")))
    settled = None
    parts = most or 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        item = F.struct("hash", F.col("block").alias("at"), "size", "chance")
        grouped = level.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("place", "part")
        done = stage(grouped.agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("done", _rounded(F.col("items"))), "level")
        decided = done.select("place", "done", F.explode("items.at").alias("block")).where(F.col("block") != F.col("done.rest.at"))
        decided = decided.select("place", "block", F.array_contains("done.ones", F.col("block")).alias("taken"))
        settled = decided if settled is None else settled.unionByName(decided)
        level = done.select("place", "part", F.col("done.rest.at").alias("block"), *(F.col(f"done.rest.{c}").alias(c) for c in ("hash", "size", "chance")))
    top = F.array(F.struct("hash", F.lit(TOP).alias("at"), "size", "chance").cast(ITEM))
    pool = blocks.where("block < 0").join(level.select("place", F.col("block").alias("top_block"), top.alias("top")), "place", "full")
    met = F.concat(F.coalesce("top", F.array().cast(f"array<{ITEM}>")), F.coalesce("items", F.array().cast(f"array<{ITEM}>")))
    pool = stage(pool.select("place", "rows", "top_block", _rounded(met).alias("done")), "pool")
    drawn_last = uniform(F.lit(SEED), F.col("done.rest.hash")) < F.col("done.rest.chance")

    def chosen_in(rows: str, at_rest: Column) -> Column:
        def bit(i: Column) -> Column:
            return F.when(i == F.col("done.rest.at"), at_rest).otherwise(F.array_contains("done.ones", i))

        return F.transform(rows, lambda x, i: F.struct(*(x[c].alias(c) for c in shown), bit(i.cast("bigint")).alias("extra")))

    top_taken = F.when(F.col("done.rest.at") == TOP, drawn_last).otherwise(F.array_contains("done.ones", F.lit(TOP)))
    last = pool.where("top_block IS NOT NULL").select("place", F.col("top_block").alias("block"), top_taken.alias("taken"))
    settled = last if settled is None else settled.unionByName(last)

    drawn = base.join(settled, ["place", "block"]).select("place", F.inline(chosen_in("rows", F.col("taken"))))
    drawn = drawn.union(pool.where("rows IS NOT NULL").select("place", F.inline(chosen_in("rows", drawn_last))))
    facts = sources.select("place", "source_size", "target", "whole")
    drawn = drawn.join(F.broadcast(facts) if n_sources <= BROADCAST_SOURCES else facts, "place")
    drawn = drawn.select(*shown, "source_size", "target", (F.col("whole") + F.col("extra").cast("bigint")).alias("copies"))
    wordless = joined.where("size = 0").select(*shown, "source_size", "target", F.lit(0).cast("bigint").alias("copies"))
    return drawn.unionByName(wordless)


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns as they are, as often as the mix takes them."""
    counts = copies(df, key, source, text, **options).groupBy("doc_id", "row_hash")
    counts = counts.agg(F.sum("copies").alias("total"), F.count("*").alias("times")).where("total > 0")
    counts = stage(counts.select(F.col("doc_id").alias("_mix_id"), F.col("row_hash").alias("_mix_hash"), "total", "times"), "copies")
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_mix_row"),
        F.col(f"`{key}`").cast("bigint").alias("_mix_key"),
        row_hash(F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`")).alias("_mix_own"),
    )

    def repeat(rows: DataFrame, counts: DataFrame, times: Column) -> DataFrame:
        same = (F.col("_mix_own") == F.col("_mix_hash")) & F.col("_mix_key").eqNullSafe(F.col("_mix_id"))
        return rows.join(counts, same).select("_mix_row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("_mix_row.*")

    out = repeat(rows, counts, F.floor(F.col("total") / F.col("times")))
    # rows that repeat each other share their copies; what doesn't divide evenly goes to one of them
    uneven = counts.where("total % times > 0")
    if uneven.limit(1).count():
        once = rows.join(uneven, F.col("_mix_own") == F.col("_mix_hash"), "left_semi").dropDuplicates(["_mix_key", "_mix_own"])
        out = out.union(repeat(once, uneven, F.col("total") % F.col("times")))
    return out
