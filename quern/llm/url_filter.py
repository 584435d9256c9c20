"""URL filters as a temporal list join (operator 9), in DataFrame functions only.

A list is a log of dated entries: from a time on, a key (a host, a parent domain, or a host with the first segment of the path) is
blocked, allowed or off the list. Entries become validity intervals, from each entry to the next one of the same list and
key. A capture has the keys of its own url, from most to least specific, and each key is held against the entry that was
valid at fetch time. The most specific key decides; for one key, allowing goes before blocking, then the
smaller list name.

The as-of join is an equality join: the span of all fetch times is cut into SLICES slices of whole days, an interval has a row
for each slice that it touches, a capture's key lies in one, and the two meet by key and slice. So a key's history of any length is
never one row, an interval has SLICES rows at most, and a capture is held only against what was listed about its time. Keys that
captures ask for more than HOT times are dealt at random into parts of about HOT rows, with their intervals beside each part; where
the counted list is small it is broadcast instead. Equal captures are counted before the join.

Defined cases. A url that is null or has no host, and a null fetch time, match nothing: verdict 'none'. Entries with a null key,
list, action or time are ignored; of entries with the same list, key and time the smallest action counts. Repeated
captures keep their rows. Hosts and listed keys are compared in lower case, without port, user and final dot. Empty tables: no
captures, no rows; no entries, all 'none'. Times are dates, timestamps (both kinds) or whole numbers, of the same type on both sides.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, small_side, stored

OFF = "off"
#: Slices of time; rows of one key and slice that one task holds.
SLICES, HOT = 64, 100_000


def host_of(url: Column) -> Column:
    """The host in lower case, or an empty string."""
    return F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))


def keys_of(url: Column) -> Column:
    """Keys from most to least specific: host with first path segment, host, then each parent of two labels or more."""
    host, first = host_of(url), F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    own = F.when(first != "", F.array(F.concat(host, F.lit("/"), first))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(own, parents))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, action, valid_from, valid_to (null: still valid) of the entries that are not off."""
    clean = entries.select("list", F.lower("key").alias("key"), "action", "at").dropna()
    order = Window.partitionBy("list", "key").orderBy("at")
    return (
        clean.groupBy("list", "key", "at").agg(F.min("action").alias("action"))
        .withColumn("valid_to", F.lead("at").over(order))
        .where(F.col("action") != OFF)
        .select("list", "key", "action", F.col("at").alias("valid_from"), "valid_to")
    )


def _step(at: Column, kind: str) -> Column:
    """A whole number that never falls as time rises: days, or the number itself."""
    return F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long") if kind.startswith(("date", "timestamp")) else at.cast("long")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, verdict, matched (key), list, listed_at, n_active: a row for each of captures."""
    kind = captures.schema["fetched_at"].dataType.simpleString()
    seen = captures.select("page_id", "url", "fetched_at").groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n"))
    step = _step(F.col("fetched_at"), kind)
    low, high = captures.select(step.alias("s")).agg(F.min("s"), F.max("s")).first()
    low, high = (low or 0), (high or 0)
    width = (high - low) // SLICES + 1

    def slice_of(at: Column) -> Column:
        return F.call_function("div", _step(at, kind) - low, F.lit(width))

    first = F.greatest(F.lit(0), slice_of(F.col("valid_from")))
    last = F.coalesce(slice_of(F.col("valid_to")), F.lit(SLICES))
    spans = intervals(entries).withColumn("_last", F.least(F.lit((high - low) // width), last)).withColumn("_first", first)
    spans = spans.where("_first <= _last").withColumn("slice", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    spans = stored(spans, "list-spans")

    asked = seen.select("page_id", "url", "fetched_at", F.posexplode(keys_of(F.col("url"))).alias("depth", "key"))
    asked = asked.withColumn("slice", slice_of(F.col("fetched_at")))
    small = spans.count() <= BROADCAST_ROWS
    if small:
        met = asked.join(F.broadcast(spans), ["key", "slice"])
    else:
        met = _dealt(asked, spans)
    met = met.where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = F.struct("depth", F.when(F.col("action") == "allow", 0).otherwise(1).alias("late"), "list", "action", "key", F.col("valid_from").alias("listed_at"))
    found = met.groupBy("page_id", "url", "fetched_at").agg(F.min(best).alias("best"), F.count("*").alias("n_active"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("page_id", "url", "fetched_at")]
    held = seen.alias("s").join(found.alias("f"), same[0] & same[1] & same[2], "left")
    return held.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("s.n").cast("int")))).select(
        "s.page_id",
        "s.url",
        "s.fetched_at",
        F.coalesce("f.best.action", F.lit("none")).alias("verdict"),
        F.col("f.best.key").alias("matched"),
        F.col("f.best.list").alias("list"),
        F.col("f.best.listed_at").alias("listed_at"),
        F.coalesce("f.n_active", F.lit(0)).cast("long").alias("n_active"),
    )


def _dealt(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """The join by key and slice, very frequent ones in parts."""
    wanted = stored(spans.select("key", "slice").distinct(), "list-keys")
    often = asked.join(wanted, ["key", "slice"], "left_semi").groupBy("key", "slice").agg(F.count("*").alias("_often")).where(F.col("_often") > HOT)
    parts = stored(often.select("key", "slice", F.ceil(F.col("_often") / HOT).cast("int").alias("_parts")), "hot-keys")
    parts = small_side(parts)
    dealt = asked.join(parts, ["key", "slice"], "left").withColumn("_part", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    copied = spans.join(parts, ["key", "slice"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(copied, ["key", "slice", "_part"]).drop("_part")
