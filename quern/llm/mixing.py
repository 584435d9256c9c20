"""Mixing sources to target weights by pivotal dependent rounding (operator 8).

Each source gets a target number of words; each document of the source gets the same expected number of copies,
target / source size. Its whole part is taken as it is, its fractional part is the chance of one copy more. Chances are rounded
in pairs, larger documents first: the open document and the next one trade mass, counted in words so that the source's
total stays put, by one random draw, until one of the two has a whole number of copies; the other meets the next. Where the next
document is less than half as large, the open one trades with all smaller ones of the group as with one, since they still have one
common chance. A trade never changes what is expected of anybody. Documents are dealt into groups that are rounded on their own;
what a group leaves open goes up a reduction tree of fixed fan-in, in pairs again. The one document that a source
has open in the end is drawn with the chance that it is left with. What the source then misses, less than that document, is made
up as far as smaller documents of the last group can, again in pairs; the chances of these move a little, and more
where a source has but a few documents.

Defined cases. Null or empty text: size 0, never taken. Null source: a source of its own, last in order. Rows
that agree in doc_id, source and text get the same number of copies. Nothing depends on the order or partitioning of
the input. An empty table gives an empty result. Further columns pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD, fresh, key_of, small_side, stored

#: Documents of a source that are rounded together on average, and groups whose open documents meet on each step up.
GROUP, FAN_IN = 128, 64
#: Sources whose totals the driver may hold; more are an error.
MAX_SOURCES = 1_000_000
#: Sources up to which their table is broadcast.
SMALL = 50_000


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], ratio: float, cap: float) -> list[float]:
    """Words for each source: shares of ratio * all words by cycling weights, capped at cap times the source's size.

    What a capped source can't take is shared among the others by weight, until none is above its cap.
    """
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k][0] is None, sizes[k][0] or ""))
    weight = [0.0] * len(sizes)
    for rank, k in enumerate(order):
        weight[k] = float(weights[rank % len(weights)])
    out, left, free = [0.0] * len(sizes), ratio * sum(s for _, s in sizes), set(range(len(sizes)))
    while free:
        unit = left / math.fsum(weight[k] for k in free)
        full = [k for k in free if weight[k] * unit > cap * sizes[k][1]]
        for k in full:
            out[k] = cap * sizes[k][1]
        if not full:
            for k in free:
                out[k] = weight[k] * unit
            break
        left -= math.fsum(out[k] for k in full)
        free.difference_update(full)
    return out


def _trade(p: float, size: float, other: float, other_size: float, draw: float) -> tuple[float, float]:
    """Both chances after a trade of words, by which at least one becomes whole; each is expected to stay as it was."""
    up, down = min((1 - p) * size, other * other_size), min(p * size, (1 - other) * other_size)
    move = up if draw * (up + down) < down else -down
    p, other = p + move / size, other - move / other_size
    return tuple(float(round(x)) if x < 1e-9 or x > 1 - 1e-9 else x for x in (p, other))


def rounded(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Chances of documents in order of falling size, of which one at most is left open. Needs two draws for each."""
    out, n, draws = p.astype(float), len(p), iter(draw.tolist())
    shared = float(out[0]) if n and (out == out[0]).all() else None  # the chance of all documents not met yet
    rest = np.concatenate([np.cumsum(size[::-1], dtype=float)[::-1], [0.0]])
    held, b = -1, 0
    while b < n:
        if shared is not None and not 0 < shared < 1:
            out[b:] = shared
            break
        if held < 0:
            held = b
            if shared is not None:
                out[b] = shared
            b += 1
        elif shared is not None and 2 * size[b] < size[held]:
            out[held], shared = _trade(out[held], size[held], shared, rest[b], next(draws))
            held = held if 0 < out[held] < 1 else -1
        else:
            out[held], out[b] = _trade(out[held], size[held], out[b] if shared is None else shared, size[b], next(draws))
            held = next((k for k in (held, b) if 0 < out[k] < 1), -1)
            b += 1
    return out


def _rounding(last: bool, seed: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    return lambda key, rows: _round_group(key, rows, last, seed, level)


def _round_group(key: tuple, rows: pd.DataFrame, last: bool, seed: int, level: int) -> pd.DataFrame:
    """Trades words inside a group until one document at most is open; the last of a source is drawn."""
    rows = rows.sort_values(["unit", "id", "digest"], ascending=[False, True, True], kind="stable", ignore_index=True)
    p, at = rows["p"].to_numpy(copy=True), np.flatnonzero(rows["open"].to_numpy())
    source = zlib.crc32(str(key[0]).encode("utf-8", "surrogatepass"))
    draws = np.random.default_rng([seed, level, int(key[1]), source])
    size = rows["unit"].to_numpy(dtype=float)
    p[at] = rounded(p[at], size[at], draws.random(2 * len(at)))
    while last and len(left := np.flatnonzero((p > 0) & (p < 1))):
        k = left[0]
        drawn = float(draws.random() < p[k])
        missing, p[k] = (p[k] - drawn) * size[k], drawn
        smaller = at[(at > k) & (p[at] == (missing < 0))]
        if len(smaller):  # they have what is missing, all of it or a share each
            share = min(1.0, abs(missing) / size[smaller].sum())
            p[smaller] = rounded(np.full(len(smaller), share if missing > 0 else 1 - share), size[smaller], draws.random(2 * len(smaller)))
    rows["p"], rows["open"] = p, (p > 0) & (p < 1)
    return rows


def copies(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: int = 17, group: int = GROUP, fan_in: int = FAN_IN
) -> DataFrame:
    """doc_id, source, digest (of text and source), n_rows (equal rows), size, source_size, target, copies: a row for each distinct document."""
    spark = docs.sparkSession
    units = stored(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text", "source").alias("digest"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "digest", "size")
        .agg(F.count("*").alias("n_rows")),
        "sizes",
    ).withColumn("source_key", key_of(F.col("source")))
    found = (
        units.groupBy("source_key", "source")
        .agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.count("*").alias("n"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = targets([(r["source"], r["words"]) for r in found], weights, ratio, cap)
    plan = [(r["source_key"], r["words"], t, max(1, -(-r["n"] // group))) for r, t in zip(found, goals, strict=True)]
    groups = max([1, *(x[3] for x in plan)])
    table = spark.createDataFrame(plan, "source_key string, source_size long, target double, groups long")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if len(plan) <= SMALL:
        table = F.broadcast(table)
    rows = (
        units.join(table, "source_key")
        .withColumn("id", F.coalesce("doc_id", F.lit(0)))  # pandas would make floats of ids beside nulls
        .withColumn("no_id", F.isnull("doc_id"))
        .drop("doc_id")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(each)).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, each - F.floor(each)).otherwise(0.0))
        .withColumn("unit", F.col("size") * F.col("n_rows"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "digest", F.lit(seed)), F.col("groups")))
        .withColumn("open", (F.col("p") > 0) & (F.col("p") < 1))
    )
    done, level = [], 0
    while True:
        last = groups == 1
        met = stored(rows.groupBy("source_key", "bucket").applyInPandas(_rounding(last, seed, level), rows.schema), "rounded")
        if last:
            done.append(met)
            break
        done.append(met.where(~F.col("open")))
        rows = met.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        groups, level = -(-groups // fan_in), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "source", "digest", "n_rows", "size", "source_size", "target",
        (F.col("whole") + F.col("p").cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs with all their columns, each as often as the mix takes it."""
    key, digest, other, again, times = (fresh(docs, n) for n in ("_key", "_digest", "_other_key", "_other_digest", "_times"))
    took = copies(docs, **options).where("copies > 0").select(F.col("doc_id").alias(other), F.col("digest").alias(again), F.col("copies").cast("int").alias(times))
    took = small_side(stored(took, "copies"))
    keyed = docs.withColumn(key, F.col("doc_id")).withColumn(digest, F.xxhash64("text", "source"))
    joined = keyed.join(took, keyed[key].eqNullSafe(took[other]) & (keyed[digest] == took[again])).drop(key, digest, other, again)
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(True), F.col(times)))).drop(times)
