"""Near-duplicate vectors by spherical k-means cells and blocked cosine products (operator 5).

Equal vectors of a label are one weighted unit. Spherical k-means, fitted on a bounded sample of units, gives each unit
its cell, that of the centroid with the largest cosine. The number of cells grows with the largest label: with its root at first, then
in proportion. Beyond TOP cells there are two levels: each top cell has cells of its own, fitted on a bounded sample of its units.
Two unit vectors of cosine >= t are at most chord = sqrt(2 - 2t) apart, so where x lives in cell a and y in cell b > a,
y.(c_b - c_a) <= chord * |c_b - c_a|: y visits every smaller cell for which that holds, and no link is lost between cells; the same
holds once more for the cells inside a top cell. Inside a cell, blocks of BLOCK units at most are multiplied pairwise, and a pair counts
where one of the two is at home, on each level; each block gives link counts and a spanning forest of the links, never the pairs.
Cosines are taken of unit vectors, and once more from the vectors themselves where they lie within 1e-9 of the threshold.
Components of the forests give the groups, and the smallest vec_id of a group is kept.

Defined cases. A vector that is null, empty, zero, or holds null or non-finite components, and any vector with a null
label, links with nothing: n_links 0, component_id its own vec_id, kept. Vectors of different length don't link. Repeated
rows count as different vectors that link with each other. A null vec_id is never a component's smallest beside others; a
group of nulls has a null component_id and is kept. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, hash_sample, lean, small_side, stored
from quern.llm.graph import components

#: Units that the top cells are fitted on at most, those that the cells inside one are, and units of a label that a cell should hold.
SAMPLE, SAMPLE_INSIDE, PER_CELL = 8192, 4096, 4096
#: Top cells, and cells inside one, at most.
TOP = 128
#: Units on either side of one block product.
BLOCK = 2048


def cells_for(units: int) -> int:
    """Cells for so many units of one label: some root of them at first, later one for each PER_CELL."""
    return 1 + math.ceil(max(math.sqrt(units) / 8, units / PER_CELL))


def fit_cells(units: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    if len(units) == 0 or k < 2:
        return np.zeros((1, units.shape[1] if units.ndim == 2 else 1))
    cells = units[np.random.default_rng(seed).choice(len(units), min(k, len(units)), replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(units @ cells.T, axis=1)
        sums = np.zeros_like(cells)
        np.add.at(sums, home, units)
        norm = np.linalg.norm(sums, axis=1)
        cells[norm > 1e-12] = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return cells


def visits(units: np.ndarray, cells: np.ndarray, chord: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cell, rows and whether they live there, for each cell: all that may take part in a link of that cell."""
    cosines = units @ cells.T
    home = np.argmax(cosines, axis=1)
    at_home = cosines[np.arange(len(units)), home]
    for cell in range(len(cells)):
        gap = np.linalg.norm(cells - cells[cell], axis=1)[home]
        here = (home == cell) | ((home > cell) & (at_home - cosines[:, cell] <= chord * gap + 1e-9))
        rows = np.flatnonzero(here)
        if len(rows):
            yield cell, rows, home[rows] == cell


def placed_in(units: np.ndarray, top: np.ndarray, inside: dict[int, np.ndarray], chord: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of a cell, rows, and their homes as bits: 1 at home in the top cell, 2 in the cell inside."""
    for cell, rows, home in visits(units, top, chord):
        own = inside.get(cell)
        if own is None:
            yield cell * TOP, rows, home + np.int8(2)
        else:
            for small, some, lives in visits(units[rows], own, chord):
                yield cell * TOP + small, rows[some], home[some] + np.int8(2) * lives


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1; first by a power of two, so that squares stay in range."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _units(names: list[str], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            digests, vectors, dims = [], [], []
            for label, item in zip(labels.to_pylist(), lists, strict=True):
                v = None
                if label is not None and item.is_valid and len(item) and item.values.null_count == 0:
                    v = item.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no -0.0
                if v is None or not np.isfinite(v).all() or not v.any():
                    digest, v = None, None
                else:
                    digest = hashlib.blake2b(repr(label).encode() + b"\0" + v.tobytes(), digest_size=16).hexdigest()
                digests.append(digest)
                vectors.append(None if v is None else v.astype(kind).tobytes())
                dims.append(0 if v is None else len(v))
            cols = [ids, labels, pa.array(digests, pa.string()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return read


def _forest(near: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches in a symmetric boolean matrix."""
    root = np.full(len(near), -1)
    for k in range(len(near)):
        if root[k] < 0:
            front = np.zeros(len(near), dtype=bool)
            front[k] = True
            while front.any():
                root[front] = k
                front = near[front].any(axis=0) & (root < 0)
    return root


def _product(threshold: float, kind: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[-2]), int(key[-1])
        raw = rows["vec"].tolist()
        v = unit_vectors(raw, kind)
        home, side, weight = rows["home"].to_numpy(), rows["chunk"].to_numpy(), rows["weight"].to_numpy()
        cosines = v @ v.T
        near = cosines >= threshold
        for a, b in np.argwhere(np.triu(np.abs(cosines - threshold) <= 1e-9)).tolist():
            x, y = np.frombuffer(raw[a], kind).astype(np.float64), np.frombuffer(raw[b], kind).astype(np.float64)
            x, y = (np.ldexp(z, -np.frexp(np.abs(z).max())[1]) for z in (x, y))
            near[a, b] = near[b, a] = (x @ y) / math.sqrt((x @ x) * (y @ y)) >= threshold
        near &= (home[:, None] | home[None, :]) == 3
        if i != j:
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        root = _forest(near)
        digest = rows["digest"].to_numpy()
        linked = near.any(axis=1)
        return pd.DataFrame({"digest": digest[linked], "links": (near @ weight)[linked], "root": digest[root][linked]})

    return multiply


def fitted(units: DataFrame, most: int, kind: str) -> dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]:
    """By length of vectors: the top cells, and the cells inside each where there are two levels."""
    k = cells_for(most)
    place = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    sample = hash_sample(units.select("digest", "dim", "vec"), place, SAMPLE).collect()
    sample.sort(key=lambda r: r["digest"])
    top = {dim: fit_cells(unit_vectors([bytes(r["vec"]) for r in sample if r["dim"] == dim], kind), min(k, TOP)) for dim in {r["dim"] for r in sample}}
    if k <= TOP:
        return {dim: (cells, {}) for dim, cells in top.items()}
    inside = min(TOP, -(-k // TOP))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cell = [int(np.argmax(unit_vectors([x], kind) @ top[d].T)) if d in top else -1 for d, x in zip(dims, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["digest", "dim", "vec", "cell"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest")
        cells = fit_cells(unit_vectors(rows["vec"].tolist(), kind), inside)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "cell": rows["cell"].iloc[:1], "cells": [cells.astype("<f8").tobytes()]})

    n = units.count()
    some = units.select("digest", "dim", "vec").where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(min(1.0, TOP * SAMPLE_INSIDE / n) * (1 << 30)))
    some = some.mapInArrow(lean(homes), "digest string, dim int, vec binary, cell int").where("cell >= 0")
    share = F.count("*").over(Window.partitionBy("dim", "cell"))
    some = some.withColumn("_n", share).where(F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_INSIDE) / F.col("_n")) * (1 << 30))
    found = some.select("digest", "dim", "vec", "cell").groupBy("dim", "cell").applyInPandas(fit, "dim int, cell int, cells binary").collect()  # TOP rows for each length
    return {dim: (cells, {r["cell"]: np.frombuffer(r["cells"]).reshape(-1, dim) for r in found if r["dim"] == dim}) for dim, cells in top.items()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vec_id, label, embedding."""
    bounded_batches(vectors.sparkSession)
    names = ["vec_id", "label", "digest", "dim", "vec"]
    label = vectors.schema["label"].dataType.simpleString()
    kind, number = ("<f4", "float") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else ("<f8", "double")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{number}>").alias("embedding")
    ).mapInArrow(lean(_units(names, kind)), f"vec_id long, label {label}, digest string, dim int, vec binary")
    rows = stored(rows, "vectors")
    units = stored(
        rows.where("digest is not null").groupBy("digest", "label", "dim")
        .agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("least")),
        "units",
    )
    most = units.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    chord = math.sqrt(max(0.0, 2 - 2 * threshold))
    cells = units.sparkSession.sparkContext.broadcast(fitted(units, most, kind))  # TOP * TOP centroids for each length at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    top, inside = cells.value.get(int(dim), (np.zeros((1, int(dim))), {}))
                    for cell, took, home in placed_in(unit_vectors(part.column(3).to_pylist(), kind), top, inside, chord):
                        cols = part.take(pa.array(took)).columns
                        number = pa.array(np.full(len(took), cell), pa.int32())
                        yield pa.RecordBatch.from_arrays([*cols, number, pa.array(home, pa.int8())], ["digest", "label", "dim", "vec", "weight", "cell", "home"])

    placed = stored(
        units.select("digest", "label", "dim", "vec", "weight")
        .mapInArrow(lean(assign), f"digest string, label {label}, dim int, vec binary, weight long, cell int, home byte"),
        "placed",
    )
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / BLOCK))
    sizes = small_side(stored(sizes, "cell-sizes"))
    chunk = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("chunks")).cast("int")
    pairs = F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)
    blocks = (
        placed.join(sizes, key)
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(pairs))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .drop("n", "chunks", "other")
    )
    found = stored(
        blocks.groupBy(*key, "i", "j").applyInPandas(_product(threshold, kind), "digest string, links long, root string"), "found"
    )
    groups = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    member = units.select("digest", "weight", "least").join(links, "digest", "left").join(
        groups.select(F.col("id").alias("digest"), "component"), "digest", "left"
    ).withColumn("component", F.coalesce("component", "digest"))
    member = stored(member, "members")
    least = stored(member.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    each = stored(member.join(least, "component").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "each")
    joined = rows.select("vec_id", "digest").join(each, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
