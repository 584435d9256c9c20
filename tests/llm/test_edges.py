"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each operator's defined results."""

import hashlib
import io
import math
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import graph, language, licenses, mixing, neardup_text, neardup_vectors, packing, token_files, topk, url_filter, warc
from quern.llm.common import stored
from quern.llm.count_tree import Tree, count_vector, forest, groups_for, needed
from quern.llm.graph import components
from quern.llm.shingles import shingle_sets
from quern.llm.tokens import WordEncoder, default_tokenizer, encoder

CLASHING = ["_key", "_kept", "_once", "_mix_key", "_mix_copies", "_copy", "lang_pred", "n", "digest", "size", "copies", "p", "open", "bucket", "component", "lang_pred_", "ids", "place", "key", "vec", "source_key", "unit"]


def clash(df):
    """Columns whose names operators use inside, of another type."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LONG = " ".join(f"word{k % 977} and{k}" for k in range(60_000))


# encoding


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZé.,!?' \n\t\x01ñÉßİΣ1 ́<|endoftx>", max_size=40), max_size=6))
def test_words_give_the_ids_of_the_text(texts):
    own = encoder(default_tokenizer())
    direct = own._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in direct]


def test_other_tokenizers_encode_directly():
    import public_tokenizers

    own = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some  text\n with   spaces."
    assert not own._by_word and np.frombuffer(own.encode([text])[0], "<u4").tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    own = WordEncoder(default_tokenizer(), remembered=50)
    for k in range(20):
        own.encode([" ".join(f"w{k}x{j}" for j in range(100))])
    assert len(own._known) <= 500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aestrvlmd'É0 5.,!\n\x0bñßơ_<", max_size=60), max_size=5), st.sampled_from(["", "× x", "<|endoftext|>", "\u0249\u0250", "H\u0331", "a\xa0b"]))
def test_pieces_of_plain_texts(texts, other):
    own, texts = encoder(default_tokenizer()), [*texts, other, "it's 'sure we''re'll " + "they've" * 30, *texts]
    direct = own._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in direct]


def test_new_words_are_merged_together():
    """Plain words that were never met cost no call of the library each, and none of them is remembered."""
    own, rng = WordEncoder(default_tokenizer()), np.random.default_rng(5)
    parts = ["the", "on", "é", "qu", "x", "ing", "zz", "er", "ção", "Th", "a"]
    words = ["".join(rng.choice(parts, int(n))) + tail for n, tail in zip(rng.integers(1, 9, 5000), ["", ",", "'s", "7.", "!?"] * 1000, strict=True)]
    want = [own._tokenizer.encode(x, add_special_tokens=False).ids for x in words]
    own._model = None
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)] == want
    assert own.encode([" ".join(words)]) == [b"".join(own.encode(words))] and len(own._known) == 1


# language


def test_language(spark, docs):
    train = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat with the dog", "en"), ("der hund und die katze sind nicht da", "de")] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !!", "en"), (103, "der hund " * 9000, None), (None, "the cat", None), (104, "the cat", "en"), (104, "the cat", "en"), (105, "ꙮ", None)]
    every = clash(docs(*train, *odd))
    model = language.train(every, language.remainder(F.col("doc_id")) != 0)
    assert model[0] == ["de", "en"] and np.allclose(model[1][:-1].sum(axis=0), 1, atol=0.01)
    found = language.identify(every, model)
    own = [c for c in every.columns if c != "lang_pred"]
    assert found.columns == [*own, "lang_pred", "lang_score"] and found.count() == 48
    by = {(r["doc_id"], r["text"]): (r["lang_pred"], r["lang_score"]) for r in found.collect()}
    assert by[100, None] == by[101, ""] == by[102, "12 34 !!"] == ("und", 0.0)
    assert by[103, "der hund " * 9000][0] == "de" and by[None, "the cat"][0] == "en"
    assert by[105, "ꙮ"][0] in model[0] and 0 < by[105, "ꙮ"][1] < 1
    assert language.identify(every.limit(0), model).count() == 0
    nothing = language.train(docs((1, "text")), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(every, nothing).collect()} == {"und"}


def test_letters():
    assert language.runs_of("a1b_c²d'é") == ["▁a", "▁b", "▁c", "▁d", "▁é"] and language.runs_of("²Ⅷ½_9") == []
    assert language.runs_of("x" * 70) == ["▁" + "x" * 32, "x" * 32, "x" * 6]  # no word begins inside


def test_remembered_likelihoods_are_bounded_in_bytes():
    many = [f"l{k}" for k in range(256)]
    pieces = language.pieces_of(language.default_vocabulary())
    scorer = language.Scorer(many, np.full((pieces.size, 256), 1e-4), pieces)
    assert scorer._limit * 257 * 8 <= language.TABLE_BYTES


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(language.default_vocabulary())
    chances = np.random.default_rng(1).random((pieces.size, 2)) * 1e-3
    index = {w: k for k, w in enumerate(pieces.words)}

    def total(word):
        sums = [np.ones(2)] + [np.zeros(2)] * len(word)
        for b in range(1, len(word) + 1):
            for a in range(max(0, b - language.PIECE), b):
                p = index.get(word[a:b], pieces.size - 1 if b - a == 1 else None)
                if p is not None:
                    sums[b] = sums[b] + sums[a] * chances[p]
        return np.log(sums[-1])

    words = ["▁the", "▁unterschied", "▁я", "▁zx", "▁a", "tinued"]
    assert np.allclose(language.likelihoods(words, pieces, chances), [total(w) for w in words])


def test_fitting_counts_all_segmentations():
    """One round of expectation maximisation, with each segmentation written out."""
    pieces = language.pieces_of(language.default_vocabulary())
    index = {w: k for k, w in enumerate(pieces.words)}

    def segmentations(word):
        if not word:
            return [[]]
        out = []
        for b in range(1, len(word) + 1):
            p = index.get(word[:b], pieces.size - 1 if b == 1 else None)
            if p is not None:
                out += [[p, *rest] for rest in segmentations(word[b:])]
        return out

    words, counts = [("▁hund", 0, 3), ("▁the", 0, 2), ("é", 0, 1)], np.zeros(pieces.size)
    for word, _, n in words:
        ways = segmentations(word)
        chance = np.array([(1 / pieces.size) ** len(w) for w in ways])
        for way, c in zip(ways, chance / chance.sum(), strict=True):
            np.add.at(counts, way, n * c)
    counts[-1] = 0
    expected = (counts + 0.05) / (counts.sum() + 0.05 * pieces.size)
    expected[-1] = 1e-7
    assert np.allclose(language.fit(words, 1, pieces, rounds=1)[:, 0], expected)


def test_long_pieces_are_used():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=language.default_vocabulary())
    every = {w for w in map(own.id_to_piece, range(own.get_piece_size())) if w.strip("▁").isalpha() and w == w.lower() and "▁" not in w[1:]}
    pieces = language.Pieces(language.default_vocabulary())
    assert every == set(pieces.words) - {"▁"} and max(map(len, every)) == 16
    chances = np.zeros((pieces.size, 1))
    for word in ("something", "information", "important"):
        chances[pieces.words.index("▁" + word)] = 0.25
        assert np.allclose(language.likelihoods(["▁" + word], pieces, chances), np.log(0.25))


def test_all_words_of_all_languages_are_learned(spark, docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**j % 26] for j in range(4))
    large = [(k, " ".join(word(k * 2000 + j) for j in range(2000)) + " " + " ".join(word(k * 2000 + j) for j in range(2000)), "aa") for k in range(100)]
    data = docs(*large, (1000, "zzyzx qwghlm", "zz"), (1001, "12 34", "zy"))
    languages, chances = language.train(data, F.lit(True))
    pieces = language.Pieces(language.default_vocabulary())
    assert languages == ["aa", "zy", "zz"] and chances.shape == (pieces.size, 3)
    alone = language.fit([("▁zzyzx", 0, 1), ("▁qwghlm", 0, 1)], 1, pieces)[:, 0]
    assert np.allclose(chances[:, 2], alone) and np.allclose(chances[:-1, 1], chances[0, 1])
    assert not np.allclose(chances[:, 2], chances[:, 1])


def test_pipeline_keeps_short_documents(spark, docs):
    import corpus_pipeline

    every = docs(*[(k, "hotel radio taxi", lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)], (100, "hotel", None), (101, "a", "aa"), (102, "12", "aa"), (103, None, "aa"))
    kept = corpus_pipeline.identified(spark, every, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 100, 101]


def test_pipeline_edges(spark, docs, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, columns with clashing names."""
    import corpus_pipeline

    rows_ = [(k, f"the cat number {k} sat on the mat and saw another dog", "en", f"s{k % 3}") for k in range(30)]
    rows_ += [rows_[0], rows_[0], (None, "the cat has no number at all but sits here with us", None, None), (40, None, None, None), (41, "", "en", "s1"), (42, "12 !!", None, "s1")]
    rows_ += [(43, LONG, None, "s2"), (44, rows_[1][1], "de", "s0"), (45, "zzz", None, None)]
    every = clash(docs(*rows_))
    at = every
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, "")
        assert at.columns == every.columns
        at = stored(at, "stage")
    ids = [r["doc_id"] for r in at.collect()]
    assert not {40, 41, 42} & set(ids) and max(map(ids.count, ids)) <= 2
    packed = corpus_pipeline.packed(spark, at, "")
    assert {r["doc_id"] for r in packed.collect()} == set(ids)
    folder = str(tmp_path / "empty")
    docs().write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


# similar documents


def test_similar(spark, docs):
    base = [f"w{k}" for k in range(100)]
    near = base.copy()
    near[50] = "other"  # 91 of 101 shingles
    far = base.copy()
    for k in (10, 40, 70):
        far[k] = "gone"  # 81 of 111: below
    edge = ["a b c d e f g h i j k", "a b c d e f g"]  # 3 of 7 shingles
    data = [
        (9, " ".join(base)), (3, " ".join(near).upper()), (5, " ".join(far)), (1, None), (2, ""), (4, " \t\n"), (6, "one two"), (7, "ONE  two"), (8, "one three"),
        (11, edge[0]), (12, edge[1]), (20, LONG), (21, LONG + " tail"), (9, " ".join(base)), (None, " ".join(base)), (None, "alone here"),
    ]
    mine = neardup_text.similar_documents(clash(docs(*data)))
    assert rows(mine) == sorted(
        [
            (9, 96, 3), (9, 96, 3), (None, 96, 3), (3, 96, 3), (5, 96, 5), (1, 0, 1), (2, 0, 2), (4, 0, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8),
            (11, 7, 11), (12, 3, 12), (20, 119996, 20), (21, 119997, 20), (None, 1, None),
        ],
        key=repr,
    )
    assert neardup_text.similar_documents(docs()).count() == 0


def test_kept(spark, docs):
    text = "a b c d e f g"
    data = clash(docs((5, text), (2, text), (2, text), (2, "something else that is here"), (7, None), (7, None), (None, text)))
    kept = neardup_text.without_near_duplicates(data)
    assert kept.columns == data.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == [(2, text), (2, "something else that is here"), (7, None), (7, None)]


def test_blocks_in_chunks(spark, docs, monkeypatch):
    """Large blocks and classes meet chunk by chunk and lose nothing."""
    monkeypatch.setattr(neardup_text, "CHUNK", 4)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(60)]
    data = []
    for k in range(40):
        words = base.copy()
        words[int(rng.integers(60))] = f"x{k}"
        data.append((100 + k, " ".join(words)))
    chain = [f"c{k}" for k in range(60)]
    for k in range(12):  # each links with its neighbours only
        data.append((k, " ".join(chain[k * 3 : k * 3 + 24])))
    for k in range(30):  # one passage and two thirds of another text: alike, and linked with few
        own = [f"y{k // 2}-{j}" for j in range(14)]
        own[k % 2] = f"z{k}"
        data.append((200 + k, " ".join(base[:40] + own)))
    found = {r["doc_id"]: r["component_id"] for r in neardup_text.similar_documents(docs(*data)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in data}
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_forest_spans_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(int(rng.integers(2, 90))):
        if sets and rng.random() < 0.6:
            own = sets[int(rng.integers(len(sets)))]
            keep = own[rng.random(len(own)) < 0.93]
            sets.append(np.union1d(keep, rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)))
        else:
            sets.append(np.unique(rng.integers(0, 2**63, int(rng.integers(1, 80)), dtype=np.uint64)))
    sets = [s if len(s) else np.array([7], dtype=np.uint64) for s in sets]
    linked = lambda a, b: 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)
    found = forest(np.array([len(s) for s in sets]), [count_vector(s, groups_for(len(s), 3)) for s in sets], 75, linked)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    first = {c: k for k, c in reversed(list(enumerate(found.tolist())))}
    assert [first[c] for c in found.tolist()] == root


def test_tree_prunes_and_keeps_every_pair_within_the_bound():
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 4000, 600)
    points = np.stack([rng.poisson(s / 64, 64) for s in sizes]).astype(np.uint16)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = Tree(points, sizes)
    assert len(tree.levels) == 3
    near = tree.near_leaves(75)
    leaves = -(-600 // 8)
    assert len(near) < 0.5 * leaves * (leaves + 1) / 2
    kept = set(near)
    for a in range(600):
        shared = np.minimum(tree.points[a], tree.points[a:]).sum(axis=1)
        for b in (a + np.flatnonzero(shared >= needed(tree.sizes[a], tree.sizes[a:], 75))).tolist():
            assert (a // 8, b // 8) in kept


def test_near_copies_of_a_very_long_text_take_little_memory():
    rng = np.random.default_rng(4)
    text = np.unique(rng.integers(0, 2**63, 200_000, dtype=np.uint64))
    tokens = []
    for _ in range(32):
        own = text.copy()
        own[rng.integers(0, len(own), 500)] = rng.integers(0, 2**63, 500, dtype=np.uint64)
        tokens.append(np.unique(own).tobytes())
    tracemalloc.start()
    joined = neardup_text._verified(75)(None, np.arange(32), [len(t) // 8 for t in tokens], tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(joined.tolist())) == 1 and peak < 100e6


def test_joined_in_one_group_is_joined_in_all(spark, monkeypatch):
    """Two subtrees of the same 60 like members, each in chunks: one meeting joins all of them, and none of them meets again."""
    tables = []
    monkeypatch.setattr(neardup_text, "stored", lambda df, name: tables.append(name) or stored(df, name))
    digests = [bytes([k]) * 16 for k in range(60)]
    members = spark.createDataFrame([(g, d, 3) for g in range(6) for d in digests], "group long, digest binary, chunks long")
    vector = np.full(16, 2, dtype=np.uint8).tobytes()
    payload = spark.createDataFrame([(d, 32, vector) for d in digests], "digest binary, size long, payload binary")
    found = neardup_text.linked(members, payload, neardup_text._bound(75), 20)
    assert {(bytes(r["id"]), bytes(r["component"])) for r in found.collect()} == {(d, digests[0]) for d in digests}
    assert tables.count("links") == 1 and "pair-members" not in tables


@pytest.mark.parametrize("few", [100_000, 20, 0])
def test_few_links_are_joined_at_once(spark, monkeypatch, few):
    """The same components by one task, by rounds, and by rounds that leave the rest to one task."""
    tables = []
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    monkeypatch.setattr(graph, "stored", lambda df, name: tables.append(name) or stored(df, name))
    order = np.random.default_rng(3).permutation(60).tolist()
    edges = [(bytes([a]), bytes([b])) for a, b in zip(order[:30], order[1:30], strict=False)] + [(bytes([a]), bytes([b])) for a, b in zip(order[30:], order[31:], strict=False)]
    edges += [(b"z", b"z"), edges[0], edges[0][::-1]]
    found = {bytes(r["id"]): bytes(r["component"]) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    wanted = {bytes([k]): bytes([min(part)]) for part in (order[:30], order[30:]) for k in part}
    assert found == wanted | {b"z": b"z"}
    assert len(tables) == 1 if few > 100 else "hooks" in tables
    assert ("components" in tables) == (few > 0)


def test_bounds():
    assert int(needed(np.array(10), np.array(10), 75)) == 9 and int(needed(np.array(4), np.array(3), 75)) == 3
    assert [len(s) for s in shingle_sets([b"", b"  ", b"a", b"a b c d e", b"a b c d e f", b"a a a a a a a"])] == [0, 0, 1, 1, 2, 1]
    upper, lower, other = shingle_sets(["É Ä a B".encode(), "É Ä A b".encode(), "é ä a b".encode()])
    assert upper.tolist() == lower.tolist() != other.tolist()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60) if k != 30] + [(100, 100), (200, 150), (200, 151), (200, 152), (151, 200)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 if k <= 30 else 31 for k in range(61)} | {100: 100} | dict.fromkeys((150, 151, 152, 200), 150)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# licenses


def test_licenses(docs):
    data = [
        (1, None), (2, ""), (3, "MIT-License! mit\nlicense"), (4, "mit x license, mitlicense, mit licenseé"), (5, "Licensed under the Apache License, Version 2.0"),
        (6, "GNU Lesser General Public License v2.1"), (7, LONG + " mit license"), (3, "MIT-License! mit\nlicense"), (None, "the general public license"),
    ]
    mine = licenses.scan_licenses(clash(docs(*data)), with_spans=True).collect()
    assert len(mine) == 9
    found = {r["doc_id"]: r for r in mine}
    assert tuple(found[1])[1:8] == tuple(found[2])[1:8] == (0, 0, None, None, "", "", 0.0)
    assert tuple(found[3])[1:6] == (4, 2, 0, 2, "mit") and tuple(found[4])[2:7] == (0, None, None, "", "")
    assert (found[5]["n_base"], found[5]["labels"], {s["label"] for s in found[5]["spans"]}) == (1, "apache", {"apache"})
    assert found[6]["base_labels"] == "gpl" and found[6]["labels"] == "gpl,lgpl" and found[6]["n_base"] == 1
    assert found[7]["first_word"] == found[7]["last_word"] == 120_000 and found[None]["first_word"] == 1
    assert licenses.scan_licenses(docs()).count() == 0


def test_rules_are_gated_and_ordered():
    every = licenses.rules()
    assert len(every) > 300 and [r.priority for r in every] == sorted(r.priority for r in every)
    scanner = licenses.Scanner()
    for label, (names, identifiers, signatures) in licenses.LICENSES.items():
        texts = [f"licensed under the {n}" for n in names.split("|") if n] + [f"SPDX-License-Identifier: {i}" for i in identifiers.split("|") if i] + [s for s in signatures.split("|") if s]
        for text in texts:
            assert label in [r.label for _, _, r in scanner.spans(text.lower().encode())], text
    inside = scanner.spans(b"licensed under the apache license, version 2.0")
    assert [(a, b) for a, b, _ in inside] and all(not (a <= c and d <= b) for k, (a, b, _) in enumerate(inside) for j, (c, d, _) in enumerate(inside) if k != j)


def test_gates_let_all_gaps_through():
    every = licenses.rules()
    assert all(any(g in k for g in licenses.gates(every) for k in r.keywords) for r in every)
    scanner = licenses.Scanner()
    for label, (names, _, signatures) in licenses.LICENSES.items():
        for text in filter(None, (names + "|" + signatures).split("|")):
            for gap in ("\n", "  ", "-", "\r\n * "):
                assert label in [r.label for _, _, r in scanner.spans(gap.join(text.split()).encode())], (text, gap)
    for text, label in (("placed in the public\ndomain", "public-domain"), ("all rights\nreserved", "proprietary"), ("creative\ncommons attribution", "cc-by"), ("altered\nsource versions must be plainly marked as such", "zlib")):
        _, kept, labels, score = scanner.scan(text.encode())
        assert label in labels and kept and score > 0


# archives

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_archives(spark):
    big, small, wide = "x" * 1000, "y" * 999, "é" * 500
    data = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (5, "u", big), (5, "u", big), (None, "u", big), (7, "u", small), (8, "u", small), (9, "u", None), (10, "u", ""), (11, "u", wide), (12, "é", wide), (None, "u", "z" * 2000), (13, "u", "q\r\n\r\nWARC/1.1" * 9000)]
    found = warc.read_bundles(warc.write_bundles(clash(spark.createDataFrame(data, PAGES))))
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    b, s, w, none = sha(big), sha(small), sha(wide), sha("")
    assert rows(found) == sorted(
        [
            (1, 1000, b, "revisit", 5), (2, 1000, b, "revisit", 5), (5, 1000, b, "response", None), (5, 1000, b, "response", None), (None, 1000, b, "revisit", 5),
            (7, 999, s, "response", None), (8, 999, s, "response", None), (9, 0, none, "response", None), (10, 0, none, "response", None),
            (11, 1000, w, "revisit", 12), (12, 1000, w, "response", None), (None, 2000, sha("z" * 2000), "response", None),
            (13, 13 * 9000, sha("q\r\n\r\nWARC/1.1" * 9000), "response", None),
        ],
        key=repr,
    )
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], PAGES))).count() == 0


def test_bundles_are_plain_zstandard(monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    writer = warc.BundleWriter()
    payloads = [bytes([65 + k % 26]) * (k * 37 % 1500) for k in range(60)]
    for k, p in enumerate(payloads):
        writer.add(warc.record_id(k), warc.record(k, f"http://h/{k}", p, hashlib.sha1(p).hexdigest(), None, False))
    count, data = writer.close()
    bundle = warc.BundleReader(data)
    assert count == 60 and len(bundle._starts) > 5
    for k in (0, 59, 31):
        (fields, payload), = bundle.find(f"<urn:page:{k}>")
        assert payload == payloads[k] and fields["WARC-Target-URI"] == f"http://h/{k}"
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 60
    with pytest.raises(ValueError):
        warc.BundleReader(data[:-1])


# vectors

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_links(data, threshold=0.98):
    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = len(data), {}
    unit = [np.array(v, dtype=np.float32).astype(float) if ok(v, label) else None for _, v, label in data]
    root = list(range(n))
    for a in range(n):
        links[a] = 0
        for b in range(n):
            if a != b and unit[a] is not None and unit[b] is not None and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= threshold:
                    links[a] += 1
                    x, y = root[a], root[b]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    ids = {}
    for k in range(n):
        ids.setdefault(root[k], []).append(data[k][0])
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return sorted(((data[k][0], links[k], least[root[k]], data[k][0] == least[root[k]]) for k in range(n)), key=repr)


@pytest.mark.parametrize("top", [3, 128])
def test_vectors(spark, monkeypatch, top):
    for name, value in (("PER_CELL", 5), ("BLOCK", 12), ("TOP", top)):
        monkeypatch.setattr(neardup_vectors, name, value)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    data = []
    for k in range(150):
        v = centres[k % 6] + rng.standard_normal(8) * rng.choice([0.05, 0.15, 0.4])
        data.append((1000 - k, [float(x) for x in np.float32(v)], int(k % 3)))
    data += [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [float("nan")] * 8, 0), (5, [None] + [1.0] * 7, 0), (6, data[0][1], None), (7, [float("inf")] * 8, 0)]
    data += [data[0], data[0], (900, data[0][1], data[0][2]), (None, data[3][1], data[3][2]), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1e-30, 0.0], 0)]
    assert rows(neardup_vectors.near_duplicates(clash(spark.createDataFrame(data, VECTORS)))) == brute_links(data)
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame([(None, None, None)], VECTORS)
    assert rows(neardup_vectors.near_duplicates(only)) == [(None, 0, None, True)]


def test_vectors_of_two_kinds(spark):
    """At the constants of production: planted groups in several cells, pairs next to the threshold, doubles of any size."""
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((40, 16))
    data = [(k, [float(x) for x in np.float32(centres[k % 40] + rng.standard_normal(16) * 0.1 * (k % 3))], k % 2) for k in range(900)]
    assert neardup_vectors.cells_for(450) > 3
    assert rows(neardup_vectors.near_duplicates(spark.createDataFrame(data, VECTORS))) == brute_links(data)
    turn = np.arccos(0.98)
    edge = [(2 * k + j, [float(np.cos(a)), float(np.sin(a))], k) for k, d in enumerate((-1e-6, -1e-13, 1e-13, 1e-6)) for j, a in enumerate((0.3, 0.3 + turn + d))]
    wide = T.StructType([VECTORS["vec_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), VECTORS["label"]])
    found = {r["vec_id"]: r["n_links"] for r in neardup_vectors.near_duplicates(spark.createDataFrame(edge, wide)).collect()}
    assert (found[0], found[6]) == (1, 0)
    for k in range(4):
        x, y = (np.array(edge[2 * k + j][1]) for j in range(2))
        assert found[2 * k] == found[2 * k + 1] == int((x @ y) / math.sqrt((x @ x) * (y @ y)) >= 0.98)
    huge = spark.createDataFrame([(1, [1e300, 2e300], 0), (2, [1e-300, 2e-300], 0), (3, [2e300, -1e300], 0)], wide)
    assert rows(neardup_vectors.near_duplicates(huge)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("shard", [7, 10_000])
def test_top_k(spark, monkeypatch, shard):
    for name, value in (("ROWS", 9), ("QUERIES", 2), ("FIRST_BLOCKS", 1), ("BLOCKS", 2), ("PROBED", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    data = [(k, [float(x) for x in np.float32(np.round(rng.standard_normal(6), 1))], 0) for k in range(120)]
    data += [(200, None, 0), (250, [None] * 6, 0), (300, [float("nan")] * 6, 0), (350, [], 0), (400, [9.0], 0), (7, data[7][1], 1), (None, [1.0] * 6, 0)]
    frame = clash(spark.createDataFrame(data, VECTORS))
    found = rows(topk.top_k(frame.where("vec_id % 50 = 0"), frame, shard=shard))
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, own in ints:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in ints if i != q)[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == sorted(expected, key=repr)
    assert topk.top_k(frame.limit(0), frame).count() == 0 == topk.top_k(frame.where("vec_id = 50"), frame.where("vec_id = 50")).count()


def test_max_score_leaves_postings_out():
    rng = np.random.default_rng(9)
    width, n = 40, 9000
    weights = np.floor(np.where(rng.random((n, width)) < 0.2, rng.exponential(60, (n, width)) * rng.choice([1, -1], (n, width)), 0.0))
    shard = topk.Shard(list(range(n)), [w.astype("<f8").tobytes() for w in weights])
    for _ in range(20):
        query = np.floor(np.where(rng.random(width) < 0.3, rng.standard_normal(width) * 100, 0.0))
        scores = weights @ query
        best = sorted(zip(-scores, range(n)))[:5]
        assert shard.best(-1, query, 5) == [(int(-s), k) for s, k in best]
        assert shard.best(-1, query, 5, floor=float(-best[-1][0])) == [(int(-s), k) for s, k in best]
        negative = -np.abs(query)
        assert shard.best(-1, negative, 5) == [(int(-s), k) for s, k in sorted(zip(-(weights @ negative), range(n)))[:5]]
    assert shard.traversed < 0.7 * shard.listed


def test_top_k_large_numbers(spark):
    data = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [-1e30, 3.0], 0), (3, [2.0**40, 1.0], 0)]
    found = rows(topk.top_k(spark.createDataFrame(data[:1], VECTORS), spark.createDataFrame(data, VECTORS)))
    assert found == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


# packing and files

ODD = [(5, None), (3, ""), (3, ""), (None, "some text"), (9, "Some, TEXT!! of tokens"), (9, "other"), (-4, LONG), (5, "<|endoftext|> inside")]


def ids_of(text):
    own = encoder(default_tokenizer())._tokenizer
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


def test_packing(spark, docs):
    frame = clash(docs(*ODD))
    pieces = packing.pack(frame, with_ids=True).collect()
    docs_found, sequences = {}, {}
    for r in pieces:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], 0) + r["length"]
        docs_found.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    for (doc_id, total), own in docs_found.items():
        texts = [ids_of(t) for i, t in ODD if i == doc_id and len(ids_of(t)) == 4 * total]
        assert sorted(x for _, x in own) if len(texts) > 1 else b"".join(x for _, x in sorted(own)) == texts[0]
    assert sum(r["length"] for r in pieces) == sum(len(ids_of(t)) // 4 for _, t in ODD)
    assert packing.pack(docs()).count() == 0


def test_hilbert_neighbours():
    side = 1 << 3
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = points[np.argsort(packing.hilbert_keys(points, 3))]
    assert sorted(packing.hilbert_keys(points, 3).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 2)
    files, dictionary = token_files.write_files(clash(docs(*ODD)))
    found = sorted(token_files.read_files(files, dictionary, with_ids=True).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in found]
    assert keys == [None, -4, 3, 3, 5, 5, 9, 9] and files.count() >= 4
    assert sorted(bytes(r["ids"]) for r in found) == sorted(ids_of(t) for _, t in ODD)
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    content = bytes(files.first()["content"])
    with pytest.raises(ValueError):
        token_files.FileReader(content, b"another")
    with pytest.raises(ValueError):
        token_files.FileReader(b"?" + content[1:], dictionary)
    none, empty = token_files.write_files(docs())
    assert token_files.read_files(none, empty).count() == 0


def test_dictionary_learns_from_whole_texts(spark, docs):
    rng = np.random.default_rng(8)
    tail = " ".join(f"zebra{k} quartz{k * 7}" for k in range(40))
    data = [(k, " ".join(str(x) for x in rng.integers(0, 10**9, 500)) + " " + tail) for k in range(300)]
    assert all(len(t) > 4000 + len(tail) for _, t in data)
    dictionary = token_files.train_dictionary(docs(*data), default_tokenizer())
    ids = np.frombuffer(ids_of(" " + tail), "<u4")[5:-5].astype("<u2")
    assert any(ids[k : k + 12].tobytes() in dictionary for k in range(0, len(ids) - 12, 4))


def test_short_document_is_read_alone():
    writer = token_files.FileWriter(b"", False)
    arrays = [np.arange(k, dtype="<u4") for k in (3, 5000, 1)]
    for k, a in enumerate(arrays):
        writer.add(k, a.tobytes())
    _, _, n, total, content = writer.close()
    reader = token_files.FileReader(content, b"")
    assert (n, total) == (3, 5004) and reader.ids(2).tolist() == [0] and reader.ids(1).tolist() == arrays[1].tolist()


def sample(pattern, rng):
    """Some text that a pattern of bytes matches."""

    def some(parsed):
        out = b""
        for op, value in parsed:
            op = str(op)
            if op == "LITERAL":
                out += bytes([value])
            elif op == "IN":
                ranges = [v if str(k) == "RANGE" else (v, v) for k, v in value]
                allowed = [c for a, b in ranges for c in range(a, b + 1) if c in b" \n-*,." or 48 <= c < 58 or 97 <= c < 123]
                out += bytes([allowed[int(rng.integers(len(allowed)))]])
            elif op == "MAX_REPEAT":
                low, high, inner = value
                out += b"".join(some(inner) for _ in range(int(rng.integers(low, min(int(high), low + 2) + 1))))
            elif op == "SUBPATTERN":
                out += some(value[-1])
            elif op == "BRANCH":
                out += some(value[1][int(rng.integers(len(value[1])))])
            else:
                assert op == "ASSERT_NOT", op
        return out

    return some(re._parser.parse(pattern.pattern))


def test_every_rule_passes_gates_and_keywords():
    rng, scanner = np.random.default_rng(21), licenses.Scanner()
    assert len(scanner._rules) > 600 and len(licenses.SIGNATURES) > 60
    for rule in scanner._rules:
        for _ in range(4):
            text = b"some words . " + sample(rule.pattern, rng) + b" . and more"
            assert rule.pattern.search(text), (rule.label, text)
            kept = scanner.spans(text)
            at = "at" if rule.pattern.groupindex else 0
            spans = [(m.start(at), m.end(at)) for m in rule.pattern.finditer(text)]
            assert all(any(a <= s and e <= b for a, b, _ in kept) for s, e in spans), (rule.label, text)


def test_detections_against_brute_force():
    """All rules on all places, suppression pair by pair, the score as a product."""
    rng, scanner = np.random.default_rng(22), licenses.Scanner()
    every = scanner._rules
    for _ in range(60):
        parts = [sample(every[int(rng.integers(len(every)))].pattern, rng) if rng.random() < 0.5 else b"plain words of text\n" for _ in range(8)]
        text = b" \n".join(parts)
        found = []
        for n, r in enumerate(every):
            at = "at" if r.pattern.groupindex else 0
            found += [(r.priority, m.start(at) - m.end(at), m.start(at), m.end(at), n) for m in r.pattern.finditer(text)]
        kept = []
        for _, _, a, b, n in sorted(found):
            if not any(s <= a and b <= e for s, e, _ in kept):
                kept.append((a, b, every[n].label))
        base, spans, labels, score = scanner.scan(text)
        assert sorted(kept) == sorted((a, b, r.label) for a, b, r in spans)
        doubt = dict.fromkeys((x for _, _, x in base), 0.4) | {label: min(1 - r.certainty for _, _, r in spans if r.label == label) for label in {x for _, _, x in kept}}
        assert labels == sorted(doubt) and score == pytest.approx(1 - math.prod(doubt.values()) if doubt else 0.0)


def test_expressions_give_all_terms():
    labels = lambda text: licenses.Scanner().scan(text.lower().encode())[2]
    assert labels("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["apache", "mit"]
    assert labels("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause") == ["bsd-3-clause", "gpl"]
    assert labels("wtfpl") == ["wtfpl"] and labels("psf-2.0") == ["python"] and labels("mit bsd ruby") == []


# mixing


def test_mixing(spark, docs):
    tree = {"group": 10, "fan_in": 3}
    rng = np.random.default_rng(6)
    data = [(k, "w " * int(rng.integers(1, 60)), None, "hot" if k % 2 else f"s{k % 7}") for k in range(400)]
    data += [(500, None, None, "empty"), (501, " ", None, None), (502, "a b c", None, None), (503, LONG, None, "one"), (None, "x y", None, "s1"), (3, data[3][1], None, "hot")]
    frame = clash(docs(*data))
    found = mixing.copies(frame, **tree).collect()
    assert sum(r["n_rows"] for r in found) == len(data)
    by = {}
    for r in found:
        assert 0 <= r["copies"] <= 2
        if r["size"] == 0:
            assert r["copies"] == 0
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        taken = sum(r["copies"] * r["size"] * r["n_rows"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] * r["n_rows"] for r in own)
    assert sorted(found, key=repr) == sorted(mixing.copies(frame.repartition(7), **tree).collect(), key=repr)
    mixed = mixing.mix(frame, **tree)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["copies"] * r["n_rows"] for r in found)
    assert mixing.copies(docs()).count() == 0 == mixing.mix(docs()).count()


def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)], (3, 1, 2), 1.5, 2) == pytest.approx([83.3333333, 200, 166.6666667])
    assert mixing.targets([("a", 10), ("b", 0)], (3, 1, 2), 1.5, 2) == [15.0, 0] and mixing.targets([], (1,), 1.5, 2) == []
    assert mixing.targets([("a", 0)], (3, 1, 2), 1.5, 2) == [0]


def brute_pivotal(p, size, draws):
    """Plain pivotal rounding in words: the open one meets the next."""
    p, held, draws = list(p), None, iter(draws)
    for b in range(len(p)):
        if held is None:
            held = b
            continue
        a = held
        up, down = min((1 - p[a]) * size[a], p[b] * size[b]), min(p[a] * size[a], (1 - p[b]) * size[b])
        move = up if next(draws) * (up + down) < down else -down
        p[a], p[b] = p[a] + move / size[a], p[b] - move / size[b]
        held = next((k for k in (a, b) if 1e-9 < p[k] < 1 - 1e-9), None)
    return p


@pytest.mark.parametrize("sizes", [[7], [100, 10, 10], [2000, *range(90, 40, -2)], sorted(np.exp(np.linspace(0, 6, 40)).round().tolist(), reverse=True)])
def test_rounding_keeps_words_and_chances(sizes):
    rng, size = np.random.default_rng(7), np.array(sizes, dtype=float)
    taken, times = np.zeros(len(size)), 4000
    for _ in range(times):
        p = mixing.rounded(np.full(len(size), 0.3), size, rng.random(2 * len(size)))
        assert abs(p @ size - 0.3 * size.sum()) < 1e-6 * size.sum() and ((p > 0) & (p < 1)).sum() <= 1
        taken += p
    assert np.abs(taken / times - 0.3).max() < 0.04


def test_rounding_is_pivotal():
    rng = np.random.default_rng(8)
    for _ in range(50):
        own, size, draws = rng.random(30), np.sort(rng.integers(1, 50, 30))[::-1].astype(float), rng.random(60)
        assert mixing.rounded(own, size, draws) == pytest.approx(brute_pivotal(own, size, draws), abs=1e-6)
    even = np.full(20, 0.35)  # sizes that are alike: equal chances make no difference
    assert mixing.rounded(even, np.full(20, 8.0), draws) == pytest.approx(brute_pivotal(even, np.full(20, 8.0), draws), abs=1e-6)


def test_copies_are_expected_in_proportion(spark):
    """Over seeds, each document's mean number of copies is target / size of its source, a lone one's too."""
    kinds = {"alone": [40], "many": list(range(60, 20, -1))}
    for name, sizes in kinds.items():
        rows = pd.DataFrame({"id": range(len(sizes)), "digest": 1, "unit": sizes, "p": 0.4, "open": True})
        mean = np.zeros(len(sizes))
        for seed in range(1500):
            done = mixing._round_group((name, 0), rows, True, seed, 0)
            assert not done["open"].any() and done["p"].isin([0, 1]).all()
            mean[done["id"]] += done["p"]
        assert np.abs(mean / 1500 - 0.4).max() < 0.06


def test_neighbours_on_the_curve_share_sequences(spark, docs):
    rng = np.random.default_rng(31)
    words = [f"word{k}" for k in range(3000)]
    data = []
    for group in range(60):
        base = [words[int(k)] for k in rng.integers(0, 3000, 60)]
        for copy in range(6):
            own = base.copy()
            own[int(rng.integers(60))] = "changed"
            data.append((copy * 60 + group, " ".join(own)))  # copies lie far apart by doc_id
    found = {}
    for r in packing.pack(docs(*data)).collect():
        found.setdefault(r["doc_id"] % 60, set()).add(r["sequence_id"])
    spread = np.mean([len(x) for x in found.values()])
    assert len(set.union(*found.values())) > 15 and spread < 4  # at random nearly 6


# url filters


@pytest.mark.parametrize("few", [500_000, 0])
def test_url_filter(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", few)
    monkeypatch.setattr(url_filter, "HOT", 2)
    entries = spark.createDataFrame(
        [
            ("l1", "bad.example.com", "block", 10), ("l1", "bad.example.com", "off", 20), ("l1", "bad.example.com", "block", 30), ("l2", "bad.example.com", "allow", 35),
            ("l1", "example.com", "block", 5), ("l1", "BAD.example.com/ok", "allow", 0), ("l1", None, "block", 0), ("l1", "x.com", None, 0), ("l1", "tie.com", "block", 1), ("l1", "tie.com", "allow", 1),
            ("l1", "MIXED.org", "block", 10), ("l1", "mixed.ORG", "off", 20),
        ],
        "list string, key string, action string, at long",
    )
    data = [
        ("http://bad.example.com/x", 9, "block", "example.com"), ("http://bad.example.com/x", 10, "block", "bad.example.com"), ("http://bad.example.com/x", 20, "block", "example.com"),
        ("https://user@BAD.Example.com.:80/ok/deep", 40, "allow", "bad.example.com/ok"), ("http://bad.example.com/x", 36, "allow", "bad.example.com"), ("http://example.com", 4, "none", None),
        ("http://notbad.example.com/x", 12, "block", "example.com"), ("http://other.org", 50, "none", None), (None, 50, "none", None), ("no url", 50, "none", None), ("http://example.com", None, "none", None),
        ("http://tie.com/a", 1, "allow", "tie.com"), ("http://tie.com/a", 1, "allow", "tie.com"), ("http://mixed.org", 15, "block", "mixed.org"), ("http://mixed.org", 30, "none", None),
    ]
    captures = spark.createDataFrame([(k // 2, u, t) for k, (u, t, _, _) in enumerate(data)], "page_id long, url string, fetched_at long")
    found = url_filter.filter_urls(clash(captures), entries)
    assert sorted(((r["page_id"], r["url"], r["fetched_at"], r["verdict"], r["matched"]) for r in found.collect()), key=repr) == sorted(((k // 2, *d) for k, d in enumerate(data)), key=repr)
    assert {r["verdict"] for r in url_filter.filter_urls(captures, entries.limit(0)).collect()} == {"none"}
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_url_filter_times(spark, zone):
    """A long history of one key, with times of both kinds, in any zone of the session."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for kind in ("timestamp_ntz", "timestamp"):
            at = F.timestamp_seconds(1_709_251_200 + F.col("id") * 3600) if kind == "timestamp" else F.lit("2024-03-01 00:00:00").cast(kind) + F.make_dt_interval(hours=F.col("id").cast("int"))
            entries = spark.range(3000).select(F.lit("l").alias("list"), F.lit("a.org").alias("key"), F.when(F.col("id") % 2 == 0, "block").otherwise("off").alias("action"), at.alias("at"))
            captures = spark.range(3001).select(F.col("id").alias("page_id"), F.lit("http://a.org/x").alias("url"), (at - F.make_dt_interval(mins=F.lit(1))).alias("fetched_at"))
            found = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(captures, entries).collect()}
            assert found == {k: "block" if k % 2 else "none" for k in range(3001)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
