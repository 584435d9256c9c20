"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from quern.llm.common import BROADCAST_ROWS, lean, small_side, stored

#: Links up to which one task joins them at once: some 30 MB.
FEW_LINKS = 100_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all links a, b."""
    above: dict = {}
    kind = None

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(above.setdefault(a, a)), top(above.setdefault(b, b))
            if x != y:
                above[max(x, y)] = min(x, y)
    ids = list(above)
    for k in range(0, len(ids), 10_000):
        part = ids[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) for each id that occurs in columns a and b of edges.

    Each round hooks every component onto its smallest neighbour, shortens the chains of hooks, and rewrites the
    links between components; the number of components that still have links at least halves. All
    rounds are joins and partially aggregated minima over tables in the shared folder. When no more than FEW_LINKS links are left, one
    task joins these, since rounds of small tables cost more than the links. Loops and repeated links are
    harmless; ids may be of any orderable type (only integers, strings and binaries are joined by one task) and are not null.
    """
    kind = edges.schema["a"].dataType
    few = FEW_LINKS if isinstance(kind, (IntegralType, StringType, BinaryType)) else 0

    def oriented(links: DataFrame) -> DataFrame:
        return stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def at_once(links: DataFrame) -> DataFrame:
        kinds = f"id {kind.simpleString()}, component {kind.simpleString()}"
        return stored(links.select("a", "b").repartition(1).mapInArrow(lean(_at_once), kinds), "components")

    links = edges
    if few and links.count() <= few:
        return at_once(links)
    links = oriented(links)
    if few and links.count() <= few:
        return at_once(links)
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("component"))
    links = links.where("a <> b")
    while (n := links.count()) > few:
        small = n <= BROADCAST_ROWS  # hooks are no more than links
        hooks = links.groupBy("a").agg(F.min("b").alias("b"))
        while True:  # each hook jumps to where its target is hooked
            to = hooks.select(F.col("a").alias("b"), F.col("b").alias("_to"))
            jumped = hooks.join(F.broadcast(to) if small else to, "b", "left")
            hooks = stored(jumped.select("a", F.coalesce("_to", "b").alias("b"), F.col("_to").isNotNull().alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.select("a", "b")
        to = hooks.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        to = F.broadcast(to) if small else to
        labels = labels.join(to, F.col("component") == F.col("_from"), "left").select("id", F.coalesce("_to", "component").alias("component"))
        labels = stored(labels, "labels")
        moved = links.join(to, F.col("a") == F.col("_from"), "left").select(F.coalesce("_to", "a").alias("a"), "b")
        links = oriented(moved.join(to, F.col("b") == F.col("_from"), "left").select("a", F.coalesce("_to", "b").alias("b")).where("a <> b"))
    if n:
        to = small_side(at_once(links).select(F.col("id").alias("_from"), F.col("component").alias("_to")))
        labels = labels.join(to, F.col("component") == F.col("_from"), "left").select("id", F.coalesce("_to", "component").alias("component"))
        labels = stored(labels, "labels")
    return labels
