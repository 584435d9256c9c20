"""N-gram Jaccard join of documents with a count-vector R-tree (operator 2).

1. Each text's set of five-word shingles is hashed once; documents with equal sets are one unit.
2. Under the root of the tree stand single shingles: a unit goes down to those of its bottom sketch, the KEYS smallest hashes of a set. A
   linked pair shares none of them with a chance of at most 0.25 ** 32 = 5e-20, like that of two equal 64-bit hashes;
   sets of 124 shingles or fewer have the exact prefix length. Very frequent shingles (estimated from a sample; this touches
   speed, never results) are passed over by units that have few of them: of its first SKETCH hashes 30 % at most.
3. Below each shingle is an R-tree of count vectors, with nodes of several levels. Summed coordinate minima bound the overlap of nodes, then of sets;
   what is found is a spanning forest of the pairs that could be linked, never all pairs. Forests join to classes.
4. In each class, sets meet once more under a finer tree, and pairs that survive its bound are verified by exact
   intersection, pairs already joined being skipped. The links found join to components.

A subtree or class is dealt into chunks of bounded rows and bytes, so no task holds a whole large group, and no link is lost:
chunks are joined alone; then one member of each component of a group meets those of others, until that joins no more; then
only members of different components are left to meet, chunk by chunk. So a large group of like documents costs about as much as
its rows, and not their square. What one group joins is joined in all: like documents stand under many shingles, dealt otherwise
under each, and so their subtrees are mostly done after the first meeting. Shingles with the same members are one subtree.

Defined cases. Null, empty or blank text: an empty set, n_shingles 0, alone in its component. Fewer than five words: one shingle of all of
them. Rows that repeat a doc_id or a text are linked by their equal sets. A null doc_id is never a component's
smallest beside others; nulls alone have a null component_id. Texts of any length are read whole. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, bounded_batches, discard, fresh, lean, ranges_for, slices, small_side, stored
from quern.llm.count_tree import count_vector, forest, groups_for
from quern.llm.graph import components
from quern.llm.shingles import grouped_sets

KEYS, SKETCH = 32, 64
#: Shingles in about this many of every HOT_SAMPLE-th unit's sketches are frequent; at most MAX_HOT of them are told apart.
HOT_SAMPLE, HOT_COUNT, MAX_HOT = 8, 48, 500_000
#: Members and bytes of a chunk, about, and rows of chunks that a task gets.
CHUNK, CHUNK_BYTES, TASK_ROWS = 512, 8 << 20, 20_000
#: Rows of chunks, with their labels and digests, up to which they are broadcast: some 25 MB.
WIDE_ROWS = 200_000


def _sketches():
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n", "digest", "keys", "vec"]
        for batch in batches:
            for piece in slices(batch, 1024, "text"):
                sets = grouped_sets(piece.column(2).to_pylist())
                cols = [
                    piece.column(0),
                    piece.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([count_vector(s, groups_for(len(s), 6)).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    return read


def _keys(frequent: Broadcast, percent: int):
    """The shingles under which units stand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            for piece in slices(batch, 4096):
                out_keys, out_units = [], []
                flat = piece.column(2).flatten().to_numpy()
                among = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat if len(hot) else np.zeros(len(flat), dtype=bool)
                ends = np.cumsum(pc.list_value_length(piece.column(2)).to_numpy())
                for row, n, end in zip(range(piece.num_rows), piece.column(1).to_pylist(), ends.tolist(), strict=True):
                    place = slice(end - min(n, SKETCH), end)
                    keys, here = flat[place], among[place]
                    if not here.any():
                        keys = keys[: min(KEYS, n - -(-percent * n // 100) + 1)]
                    elif here.sum() <= 0.3 * len(keys):
                        keys = keys[~here][:KEYS]
                    else:
                        keys = np.union1d(keys[:KEYS], keys[~here][:KEYS])
                    out_keys.append(keys)
                    out_units.append(np.full(len(keys), row))
                if out_keys:
                    rows = np.concatenate(out_units)
                    places = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), piece.column(0).take(places), piece.column(3).take(places)], ["key", "digest", "bytes"])

    return read


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows that agree in the first columns, from sorted batches."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        a = 0
        for b in range(1, batch.num_rows + 1):
            if b < batch.num_rows and all(c[b] == c[a] for c in columns[:keys]):
                continue
            part = [c[a:b] for c in columns]
            if held and all(h[0] == c[0] for h, c in zip(held[:keys], part, strict=False)):
                for h, c in zip(held, part, strict=True):
                    h += c
            else:
                if held:
                    yield held
                held = part
            a = b
    if held:
        yield held


def _bound(percent: int) -> Callable[..., np.ndarray]:
    """Components of units by the bound of their vectors."""

    def join(side: np.ndarray, joined: np.ndarray, size: list[int], vec: list[bytes]) -> np.ndarray:
        return forest(np.array(size), [np.frombuffer(v, np.uint8) for v in vec], percent, side=side, joined=joined)

    return join


def _verified(percent: int) -> Callable[..., np.ndarray]:
    """Components of sets by exact intersection."""

    def join(side: np.ndarray, joined: np.ndarray, size: list[int], tokens: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(t, np.uint64) for t in tokens]

        def linked(a: int, b: int) -> bool:
            x, y = sets[a], sets[b]
            merged = np.concatenate([x, y])
            merged.sort()
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return forest(np.array(size), [count_vector(s, groups_for(len(s), 2)) for s in sets], percent, linked, side, joined)

    return join


def _meetings(join: Callable[..., np.ndarray]):
    """What rows (group, chunk, side, label, digest, size, payload) are joined to, a meeting being the rows of a group and chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[bytes, bytes], None] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

        for _, _, side, label, digest, size, payload in runs(batches, 2):
            if len(digest) > 1:
                joined = np.unique(np.array(label, dtype=object), return_inverse=True)[1]
                sides = np.array(side) if len(set(side)) > 1 else None
                component = join(sides, joined, size, payload)
                if len(np.unique(component)) < len(np.unique(joined)):
                    least: dict[int, bytes] = {}
                    for c, d in zip(component.tolist(), label, strict=True):
                        least[c] = min(d, least.get(c, d))
                    out |= {(d, least[c]): None for c, d in zip(component.tolist(), label, strict=True) if d != least[c]}
            if len(out) > 20_000:
                yield flush()
        yield flush()

    return read


def linked(members: DataFrame, payload: DataFrame, join: Callable[..., np.ndarray], chunk: int | None = None) -> DataFrame:
    """id, component: what join() joins among the members of each group, directly or not, and the smallest digest of it.

    Members has group, digest, chunks (how many the group needs); payload has digest, size, payload, once for each digest.
    A label is the smallest digest of what has been joined, in this group or another.
    """
    chunk = chunk or CHUNK

    def meet(rows: DataFrame, n: int) -> DataFrame:
        rows = payload.join(F.broadcast(rows) if n <= WIDE_ROWS else rows, "digest").select("group", "chunk", "side", "label", "digest", "size", "payload")
        # by rows and not by bytes, since a row costs more than its bytes tell
        parts = max(ranges_for(rows.sparkSession, None), n // TASK_ROWS)
        rows = rows.repartition(parts, "group", "chunk").sortWithinPartitions("group", "chunk")
        return stored(rows.mapInArrow(lean(_meetings(join)), "a binary, b binary"), "links")

    def dealt(chunks: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("group", "digest", F.lit(salt)), chunks).cast("long")

    one_side = F.lit(0).alias("side")
    found = meet(members.select("group", dealt(F.col("chunks"), 0).alias("chunk"), one_side, F.col("digest").alias("label"), "digest"), members.count())
    joined = components(found)
    held = members.where("chunks > 1").select("group", "digest", F.col("digest").alias("label"))
    if held.isEmpty():
        return joined
    links, new, before = joined.select(F.col("id").alias("a"), F.col("component").alias("b")), joined, held.count()
    while True:  # one member of each component of a group, dealt anew, as long as that halves what is left
        new = small_side(new.select(F.col("id").alias("label"), "component"))
        held = stored(held.join(new, "label", "left").select("group", "digest", F.coalesce("component", "label").alias("label")), "held")
        labels = stored(held.groupBy("group", "label").agg(F.count("*").alias("n"), F.min("digest").alias("digest")), "labels")
        # groups with more than one label still, and their members in components of less than a chunk
        several = labels.groupBy("group").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") < chunk, F.col("n")).otherwise(0)).alias("rest"))
        several = small_side(stored(several.where("labels > 1"), "several"))
        held, labels = held.join(several.select("group"), "group"), labels.join(several, "group")
        left = labels.count()
        if not left:
            return components(links)
        if 2 * left > before:
            break
        found = meet(labels.select("group", dealt(F.ceil(F.col("labels") / chunk), 1).alias("chunk"), one_side, "label", "digest"), left)
        if found.isEmpty():
            break
        links, new, before = links.unionByName(found), components(found), left
    # members of different components: a large component has chunks of its own, small ones share chunks
    large, own, shared = F.col("n") >= chunk, F.ceil(F.col("n") / chunk), F.ceil(F.col("rest") / chunk)
    owner = F.when(large, F.col("label")).otherwise(F.lit(b"")).alias("owner")
    number = F.when(large, dealt(own, 2)).otherwise(F.pmod(F.xxhash64("label"), shared)).alias("number")
    counts = labels.select("group", "label", "n", "rest")
    held = held.join(F.broadcast(counts) if left <= BROADCAST_ROWS else counts, ["group", "label"]).select("group", "label", "digest", owner, number)

    def numbers(chunks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).alias("number")

    one = labels.where(large).select("group", owner, numbers(own)).unionByName(several.where("rest > 0").select("group", F.lit(b"").alias("owner"), numbers(shared)))
    two = small_side(one.select("group", F.col("owner").alias("owner2"), F.col("number").alias("number2")))
    apart = (F.col("owner") < F.col("owner2")) | ((F.col("owner") == b"") & (F.col("owner2") == b"") & (F.col("number") <= F.col("number2")))
    pairs = stored(one.join(two, "group").where(apart).withColumn("chunk", F.monotonically_increasing_id()), "chunk-pairs")
    left_side = pairs.select("group", "owner", "number", "chunk", one_side)
    right_side = pairs.where("owner <> owner2 or number <> number2").select("group", F.col("owner2").alias("owner"), F.col("number2").alias("number"), "chunk", F.lit(1).alias("side"))
    rows = held.join(small_side(left_side.unionByName(right_side)), ["group", "owner", "number"])
    rows = stored(rows.select("group", "chunk", "side", "label", "digest"), "pair-members")
    return components(links.unionByName(meet(rows, rows.count())))


def similar_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs."""
    return _grouped(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, of each group that which has the smallest doc_id (ties: smallest text hash); rows without words all stay."""
    found = stored(_grouped(docs, percent), "grouped").where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k")
    shared = found.groupBy("component").agg(first, F.count("*").alias("members")).where("members > 1")
    shared = stored(shared.select("component", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")), "shared")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    rows = found.join(shared, "component").groupBy("doc_id", "text_hash").agg(F.first(stays).alias("stays"), F.count("*").alias("times"))
    rows = stored(rows.where("not stays or times > 1"), "repeated")

    key, hash_, other, again = (fresh(docs, n) for n in ("_key", "_hash", "_other_key", "_other_hash"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64("text"))
    gone = small_side(rows.select(F.col("doc_id").alias(other), F.col("text_hash").alias(again)))
    match = keyed[key].eqNullSafe(gone[other]) & (keyed[hash_] == gone[again])
    kept = keyed.join(gone, match, "left_anti")
    once = rows.where("stays").select(F.col("doc_id").alias(other), F.col("text_hash").alias(again))
    if not once.isEmpty():  # equal rows of which one stays
        same = keyed[key].eqNullSafe(once[other]) & (keyed[hash_] == once[again])
        kept = kept.union(keyed.join(once, same, "left_semi").dropDuplicates([key, hash_]))
    return kept.drop(key, hash_)


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n, component (null without words), component_id."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(texts.mapInArrow(lean(_sketches()), "doc_id long, text_hash long, n long, digest binary, keys array<long>, vec binary"), "sketches")
    units = stored(
        rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "keys", "vec")).alias("s"))
        .select("digest", "least", "s.*"),
        "units",
    )
    classes = stored(_classes(units, percent).join(units.select(F.col("digest").alias("id"), "least", "n"), "id"), "classes")
    weight = classes.groupBy("component").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8).alias("bytes"))
    weight = small_side(stored(weight.select("component", _chunks().alias("chunks")), "class-sizes"))
    members = stored(classes.join(weight, "component").select(F.col("component").alias("group"), F.col("id").alias("digest"), "least", "chunks"), "class-members")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1024, "text"):
                sets = [s for s in grouped_sets(piece.column(2).to_pylist()) if len(s)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                cols = [pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["digest", "size", "payload"])

    # only texts that stand for a unit of a class are read again
    chosen = small_side(members.select("least"))
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = texts.mapInArrow(lean(again), "digest binary, size long, payload binary").groupBy("digest").agg(F.first(F.struct("size", "payload")).alias("s"))
    sets = stored(sets.select("digest", "s.*"), "sets")
    found = linked(members.select("group", "digest", "chunks"), sets, _verified(percent)).withColumnRenamed("id", "digest")
    discard(sets)
    member = stored(units.select("digest", "least").join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "members")
    least = small_side(stored(member.groupBy("component").agg(F.min("least").alias("component_id")), "least"))
    each = stored(member.join(least, "component").select("digest", "component", "component_id"), "each")
    joined = rows.select("doc_id", "text_hash", "n", "digest").join(each, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n", "component", component.alias("component_id"))


def _chunks() -> Column:
    """Chunks for so many members and bytes."""
    return F.greatest(F.lit(1), F.ceil(F.col("members") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES))


def _classes(units: DataFrame, percent: int) -> DataFrame:
    """id, component: units that the tree's bounds join, directly or not."""
    hot = (
        units.where(F.pmod(F.xxhash64("digest"), F.lit(HOT_SAMPLE)) == 0).select(F.explode("keys").alias("key"))
        .groupBy("key").count().where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "key").limit(MAX_HOT).collect()
    )
    frequent = units.sparkSession.sparkContext.broadcast(np.array(sorted(r["key"] for r in hot), dtype=np.int64))  # 4 MB at most
    vectors = units.select("digest", F.col("n").alias("size"), F.col("vec").alias("payload"))
    keyed = units.select("digest", "n", "keys", F.length("vec").cast("long").alias("bytes"))
    keyed = stored(keyed.mapInArrow(lean(_keys(frequent, percent)), "key long, digest binary, bytes long"), "keys")
    # two hashes of the set of members: shingles with the same members are one subtree
    same = [F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"x{k}") for k in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"), *same).where("members > 1")
    shared = shared.groupBy("members", "bytes", "x0", "x1").agg(F.min("key").alias("key"))
    shared = small_side(stored(shared.select("key", _chunks().alias("chunks")), "subtrees"))
    members = stored(keyed.join(shared, "key").select(F.col("key").alias("group"), "digest", "chunks"), "tree-members")
    discard(keyed)
    return linked(members, vectors, _bound(percent))
