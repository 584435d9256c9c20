"""Exact top-k by inner product with MaxScore (operator 6).

A vector is a sparse document whose terms are its dimensions, with whole-number weights. Candidates are dealt at random into shards; a
shard has two posting lists for each dimension, one of the candidates with a positive weight and one of those with a negative weight.
For a query, the list whose sign is that of the query's weight can raise a score, by its largest product at most, its bound; the
other can only lower one. The lists of smallest bounds that together stay below the k-th best score so far are non-essential: who stands
in none of the others can't enter. So the essential lists are traversed, block after block of candidates, and the rest of a score
is probed only for candidates that stay competitive. Each shard gives its k best for each query, and a ranking merges them.

The k-th best score is carried on from block to block, and from one shard to all: every query is asked of the first shard before, whose
k-th score is where the others begin. Queries travel in blocks, and where there are many in groups of blocks, each of which meets
each shard in a task of its own. Sums are exact: in doubles below 2 ** 53, in Python integers
beyond, held to the range of a long in the result.

Defined cases. Vectors that are null, or hold null or non-finite components, take no part. An empty vector scores 0, and a
missing dimension counts as 0. Ties go to the smaller id. Rows with the query's id are its own and no candidates.
Equal query rows are one query. Null ids take no part. With no candidate there is no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, lean, stored

SCALE = 256
#: Candidates that a shard holds on average, candidates that are scored together, dimensions probed together.
SHARD, ROWS, PROBED = 8192, 2048, 16
#: A posting list of one candidate in so many, or more, has a place for each candidate.
DENSE = 8
#: Queries in a block on average, and blocks that meet a shard in one task, for the first shard alone and for all.
QUERIES, FIRST_BLOCKS, BLOCKS = 64, 4, 256
_EXACT = 1 << 53


def _quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kept = [], []
        for vec_id, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vec_id is None or not item.is_valid or item.values.null_count:
                continue
            v = item.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(v).all():
                ids.append(vec_id)
                kept.append(np.floor(SCALE * v).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["vec_id", "terms"])


class Shard:
    """The posting lists of some candidates, with the vectors for probes."""

    def __init__(self, ids: list[int], terms: list[bytes]):
        width = max([0, *(len(x) // 8 for x in terms)])
        self.ids = np.array(ids, dtype=np.int64)
        self.weights = np.zeros((len(ids), width))
        for k, x in enumerate(terms):
            self.weights[k, : len(x) // 8] = np.frombuffer(x, "<f8")
        self.low, self.high = self.weights.min(axis=0, initial=0), self.weights.max(axis=0, initial=0)
        self.top = np.abs(self.weights).max(initial=0)
        self._across = np.ascontiguousarray(self.weights.T)
        #: Posting lists by sign and dimension: as places, weights and where each block begins; or, of those that hold a good part of the
        #: candidates, as a row of weights with zeros between.
        self._sparse: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list[int]]] = {}
        self._dense = {sign: np.zeros((width, len(ids))) for sign in (1, -1)}
        self._sizes = {sign: np.zeros((width, len(range(0, len(ids), ROWS))), dtype=np.int64) for sign in (1, -1)}
        cuts = np.arange(0, len(ids) + ROWS, ROWS)
        for sign in (1, -1):
            for d in range(width):
                places = np.flatnonzero(sign * self.weights[:, d] > 0)
                begins = np.searchsorted(places, cuts)[: self._sizes[sign].shape[1] + 1]
                self._sizes[sign][d] = np.diff(begins)
                if DENSE * len(places) < len(ids):
                    self._sparse[sign, d] = places, self.weights[places, d], begins.tolist()
                else:
                    self._dense[sign][d, places] = self.weights[places, d]
        #: Postings that queries have traversed, and that the lists they could have used hold.
        self.traversed = self.listed = 0

    def best(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; those below floor may be left out."""
        if not len(self.ids):
            return []
        width = self.weights.shape[1]
        q = np.zeros(width)
        q[: min(width, len(query))] = query[:width]
        if np.abs(q).max(initial=0) * self.top * max(width, 1) >= _EXACT:
            return self._large(query_id, q, k)
        bound = np.maximum(q * self.low, q * self.high)
        order = np.argsort(bound, kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(bound[order])])  # what the lists of smallest bounds add at most
        signs = np.where(bound > 0, np.sign(q), 0).astype(np.int64)
        self.listed += sum(int(self._sizes[sign][signs == sign].sum()) for sign in (1, -1))
        scores, ids, threshold = np.zeros(0), np.zeros(0, dtype=np.int64), floor
        for n, a in enumerate(range(0, len(self.ids), ROWS)):
            split = int(np.searchsorted(sums, threshold, side="left")) - 1  # the first split lists are non-essential
            gains = np.zeros(min(ROWS, len(self.ids) - a))
            every, split = split < 0, max(0, split)  # at first a score of nothing but losses may enter
            essential = order[split:]
            for sign in (1, -1):
                dims = essential[signs[essential] == sign]
                thin = [d for d in dims.tolist() if (sign, d) in self._sparse]
                wide = dims if not thin else np.array([d for d in dims.tolist() if (sign, d) not in self._sparse], dtype=np.int64)
                gains += q[wide] @ self._dense[sign][:, a : a + ROWS][wide]
                for d in thin:
                    places, weights, cuts = self._sparse[sign, d]
                    here = slice(cuts[n], cuts[n + 1])
                    gains[places[here] - a] += q[d] * weights[here]
                self.traversed += int(self._sizes[sign][dims, n].sum())
            met = np.ones(len(gains), dtype=bool) if every else gains > 0  # products of an essential list are above 0
            met &= (gains + sums[split] >= threshold) & (self.ids[a : a + ROWS] != query_id)
            rows = np.flatnonzero(met)
            rows, found = self._probe(a + rows, gains[rows], q, bound, order, split, threshold)
            if len(rows):
                scores, ids = np.concatenate([scores, found]), np.concatenate([ids, self.ids[rows]])
                keep = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[keep], ids[keep]
                if len(scores) == k:
                    threshold = max(threshold, scores[-1])
        return [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]

    def _probe(self, rows: np.ndarray, partial: np.ndarray, q: np.ndarray, bound: np.ndarray, order: np.ndarray, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The competitive ones of rows and their scores, from what the essential lists have given."""
        gained = np.zeros(len(q), dtype=bool)
        gained[order[split:]] = True
        can_gain = np.where(gained, 0.0, bound)
        can_lose = np.minimum(q * self.low, q * self.high)
        telling = np.argsort(can_lose - can_gain, kind="stable")
        first, end = (int(rows[0]), int(rows[-1]) + 1) if len(rows) else (0, 0)
        left = np.concatenate([np.cumsum(can_gain[telling][::-1])[::-1], [0.0]])
        for at in range(0, len(q), PROBED):
            if not len(rows):
                break
            dims = telling[at : at + PROBED]
            product = self._across[dims, first:end] * q[dims, None]
            product = product if len(rows) == end - first else product[:, rows - first]
            np.minimum(product, 0.0, out=product, where=gained[dims, None])
            partial = partial + product.sum(axis=0)
            alive = partial + left[min(len(q), at + PROBED)] >= threshold
            rows, partial = rows[alive], partial[alive]
        return rows, partial

    def _large(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        own = [int(x) for x in q]
        found = [(sum(a * int(b) for a, b in zip(own, row, strict=True)), int(i)) for row, i in zip(self.weights, self.ids, strict=True) if i != query_id]
        return [(max(-(2**63), min(2**63 - 1, s)), i) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def _scored(candidates: DataFrame, asked: DataFrame, shards: int, k: int, together: int) -> DataFrame:
    """query_id, terms, vec_id, score of the k best of each shard, for asked with its floors."""
    blocks = max(1, -(-asked.count() // QUERIES))
    groups = -(-blocks // together)
    each = F.collect_list(F.struct("vec_id", "terms", "floor")).alias("q")
    block = F.pmod(F.xxhash64("vec_id", "terms"), F.lit(blocks))
    queries = asked.groupBy(block.alias("block")).agg(each).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("block", F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("asks"),
        F.col("q.vec_id").alias("ids"), F.col("q.terms").alias("terms"), F.col("q.floor").alias("floors"),
    )
    held = candidates.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("asks"),
        F.array("vec_id").alias("ids"), F.array("terms").alias("terms"), F.array(F.lit(None).cast("double")).alias("floors"),
    )
    rows = held.unionByName(queries).repartitionByRange(shards * groups, "shard", "group").sortWithinPartitions("shard", "group", "asks")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, terms, shard = None, [], [], None
        for batch in batches:
            out: list[tuple[int, bytes, int, int]] = []
            for number, group, asks, some, own, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (number, group) != at:
                    at, ids, terms, shard = (number, group), [], [], None
                if not asks:
                    ids += some
                    terms += own
                    continue
                if shard is None:
                    shard = Shard(ids, terms)
                for query_id, query, floor in zip(some, own, floors, strict=True):
                    out += [(query_id, query, i, s) for s, i in shard.best(query_id, np.frombuffer(query, "<f8"), k, -np.inf if floor is None else floor)]
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["query_id", "terms", "vec_id", "score"])

    return rows.mapInArrow(lean(score), "query_id long, terms binary, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vec_id, embedding in queries."""
    bounded_batches(queries.sparkSession)
    shape = "vec_id long, terms binary"

    def read(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lean(_quantized), shape)

    found = stored(read(candidates), "candidates")
    asked = stored(read(queries).distinct(), "asked").withColumn("floor", F.lit(None).cast("double"))
    shards = max(1, -(-found.count() // shard))
    dealt = found.withColumn("shard", (F.rand(3) * shards).cast("int"))
    if shards > 1:  # the first shard's k-th score is where all others begin
        begun = _scored(dealt.where("shard = 0"), asked, 1, k, FIRST_BLOCKS).groupBy("query_id", "terms").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        begun = begun.select(F.col("query_id").alias("vec_id"), "terms", F.when(F.col("n") == k, F.col("least")).cast("double").alias("floor"))
        asked = stored(asked.drop("floor").join(begun, ["vec_id", "terms"], "left"), "asked-from")
    best = _scored(dealt, asked, shards, k, BLOCKS)
    order = Window.partitionBy("query_id", "terms").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
