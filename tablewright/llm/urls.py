"""URL lists in time: dated entries become validity intervals, and every capture is judged by those active when it was fetched.

A list entry names a key (a host, a domain above it, or a host with the first
parts of a path, however many), an action (``add`` or ``remove``) and a day.
Entries of one list and key, in order of day (on one day removals count last),
follow each other: an addition holds from its day until the day of the next
entry.

A capture looks up all its keys.  The join runs on key and period of
``PERIOD`` days, to which intervals are dealt out, so a key with very many
dated entries doesn't meet all its captures.  Keys that hold more than one in
``HOT`` of all lookups (at most ``HOT`` keys, so their table is small) are
split: their captures over several salts, their intervals copied to each.
Lookups of one address and day are made once.

The active entry with the longest key decides; of equal keys, the allowing list
does.  A capture without any active entry is kept, so is one without a host or
a day, or with one further than ``LAST_DAY`` days from 1970.  Entries without
list, key, day or a known action count for nothing; their days may be any.
Repeated captures get a row each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 128
HOT = 1_000
#: days further than this from 1970 (some 2,700 years) are no days; so the periods that occur are at most 15,626
LAST_DAY = 1_000_000


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and last dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_parts(url: Column) -> Column:
    """The parts of the path that aren't empty, without query and fragment."""
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def keys_of(host: Column, parts: Column, depths: list[int] | None = None) -> Column:
    """Everything a list may name an address by: host, domains above it, host with the first parts of the path.

    ``depths`` says how many parts; all numbers if it isn't given.
    """
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if depths is None:
        wanted = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    else:
        wanted = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: i <= F.size(parts))
    paths = F.transform(wanted, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) of the additions in entries (list, key, action, day); ``until`` is the day it ends, null if never."""
    good = entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    # what repeats counts once, so a key's window is as long as its days, not as its rows
    good = good.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("list", "key").orderBy("day"))
    dated = good.withColumn("until", following)
    return dated.where("action = 'add'").select("list", "key", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "day", allow: str = "allow") -> DataFrame:
    """Per capture: page_id, host, day, n_active, decided_by (list and key) and verdict (keep or drop)."""
    rows = captures.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{day}`").cast("bigint").alias("day"))
    # as deep as any entry names a path, and only the depths that any entry has: as many numbers as those
    slashes = F.length("key") - F.length(F.replace(F.col("key"), F.lit("/"), F.lit("")))
    depths = sorted(r[0] for r in entries.where("key LIKE '%/%'").select(slashes).distinct().toLocalIterator())
    deepest = max(depths, default=0)
    rows = rows.select("page_id", "day", host_of(F.col("url")).alias("host"), F.slice(path_parts(F.col("url")), 1, deepest).alias("parts"))
    lookups = rows.where(f"host IS NOT NULL AND abs(day) <= {LAST_DAY}").select("host", "parts", "day").distinct()
    asked = lookups.select("host", "parts", "day", F.explode(keys_of(F.col("host"), F.col("parts"), depths)).alias("key"))
    period = F.floor(F.col("day") / PERIOD).alias("period")
    asked = asked.withColumn("period", period)

    counts = asked.groupBy("key").agg(F.count("*").alias("n"))
    total, periods = asked.agg(F.count("*"), F.sort_array(F.collect_set("period"))).first()
    share = max(1, (total or 0) // HOT)
    hot = F.broadcast(counts.where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias("salts")))
    one = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64("host", "parts", "day"), one).cast("int").alias("salt")
    asked = asked.join(hot, "key", "left").select("host", "parts", "day", "key", "period", salt)

    since, until = F.floor(F.col("since") / PERIOD), F.floor((F.col("until") - 1) / PERIOD)
    valid = intervals(entries).withColumn("from", since).withColumn("to", until).where("until IS NULL OR since < until")
    # an interval stands in the periods that any capture asks for, so a long span costs no more than a short one
    held = F.filter(F.array(*map(F.lit, periods or [])).cast("array<bigint>"), lambda p: (p >= F.col("from")) & (F.col("to").isNull() | (p <= F.col("to"))))
    valid = valid.join(hot, "key", "left").select("list", "key", "since", "until", F.explode(held).alias("period"), one.alias("salts"))
    valid = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    at = (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    active = asked.join(valid, ["key", "period", "salt"]).where(at)
    order = F.struct(F.length("key").alias("length"), (F.col("list") == allow).alias("allows"), F.col("list"), F.col("key"))
    best = active.groupBy("host", "parts", "day").agg(F.count("*").alias("n_active"), F.max(order).alias("best"))
    out = rows.join(best, ["host", "parts", "day"], "left")
    return out.select(
        "page_id",
        "host",
        "day",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.concat_ws(":", F.col("best.list"), F.col("best.key")).alias("decided_by"),
        F.when(~F.col("best.allows"), F.lit("drop")).otherwise(F.lit("keep")).alias("verdict"),
    )
