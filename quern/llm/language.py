"""Language ID by segmentation-marginalised unigrams (operator 1).

The pieces are those of a fixed public vocabulary that are made of lower-case letters, with or without a word start. Each language has
a probability for each piece, fitted by expectation maximisation over all segmentations of its training words. A word's
likelihood is the sum over all its segmentations, by a forward pass over its letters; a text's is
the product over its words. The prediction is the language of highest likelihood, its score the posterior under equal priors.

Bounds of the fit, all parameters: about PER_LANGUAGE documents of each language (those of smallest hash; counted and cut over all
labelled documents), MAX_LANGUAGES languages. All words of these documents count; each language is fitted alone, by a task of its
own, so the driver receives its piece probabilities only. Prediction reads every word of every text.

Defined cases. Null text or text without a letter: 'und' with score 0. Null languages are not learned from; with
none to learn, all is 'und'. Letters outside the vocabulary have one small probability in all languages. Runs of more than RUN letters
are cut every RUN letters, and only the first part begins a word. Equal likelihoods go to the first language in code point order. Rows keep their number;
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, lean, slices

PER_LANGUAGE, MAX_LANGUAGES, ROUNDS = 600, 256, 3
RUN = 32
#: Bytes of remembered likelihoods in a worker.
TABLE_BYTES = 32 << 20
#: Length of the longest piece that can occur, that of a whole run and its start: no piece of the vocabulary is left out.
PIECE = RUN + 1
UNKNOWN = "und"
_START = "▁"
_RUNS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    """Path of the public piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hashes(codes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of each k neighbouring codes along the last axis, for k from 1 to most."""
    codes = codes.astype(np.uint64)
    out = np.zeros_like(codes)
    for k in range(1, most + 1):
        out = (out[..., : codes.shape[-1] - k + 1] ^ codes[..., k - 1 :]) * _BASE
        out ^= out >> np.uint64(29)
        yield out


class Pieces:
    """The vocabulary, as sorted hashes by length; the last index stands for any other letter."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (own.id_to_piece(k) for k in range(own.get_piece_size()))
        words = [w for w in found if w != _START and len(w) <= PIECE and (w.lstrip(_START)).isalpha() and w == w.lower() and _START not in w[1:]]
        self.words = sorted({*words, _START}, key=lambda w: (len(w), w))
        self.tables = {}
        at = 0
        for k in range(1, PIECE + 1):
            same = [w for w in self.words if len(w) == k]
            if same:
                *_, h = _hashes(np.array([[ord(c) for c in w] for w in same], dtype=np.int64), k)
                h = h[:, 0]
                order = np.argsort(h)
                self.tables[k] = (h[order], at + order)
            at += len(same)
        self.size = len(self.words) + 1

    def lattice(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece that starts at each place of padded words, or -1."""
        out = {}
        for k, h in enumerate(_hashes(codes, min(codes.shape[1], max(self.tables))), 1):
            if k in self.tables:
                table, index = self.tables[k]
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = (table[at] == h) & (codes[:, k - 1 :] > 0)
                out[k] = np.where(hit, index[at], -1)
        one = out[1]
        out[1] = np.where((one < 0) & (codes > 0), self.size - 1, one)
        return out


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """The pieces, read once by each worker process."""
    return Pieces(path)


def _padded(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in runs])
    codes = np.zeros((len(runs), lengths.max()), dtype=np.int64)
    flat = np.frombuffer("".join(runs).encode("utf-32-le"), dtype="<u4")
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    return codes, lengths


def forward(lattice: dict[int, np.ndarray], chances: np.ndarray, places: int) -> np.ndarray:
    """Probability of all segmentations up to each place: words x places + 1 x languages."""
    n = len(lattice[1])
    alpha = np.zeros((n, places + 1, chances.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, places + 1):
        for k, pieces in lattice.items():
            if k <= end:
                rows = np.flatnonzero(pieces[:, end - k] >= 0)
                if len(rows):
                    alpha[rows, end] += alpha[rows, end - k] * chances[pieces[rows, end - k]]
    return alpha


def _groups(runs: list[str], rows: int = 4096) -> Iterator[np.ndarray]:
    """Indices of runs, like lengths together."""
    order = np.argsort([len(r) for r in runs], kind="stable")
    for k in range(0, len(order), rows):
        yield order[k : k + rows]


def likelihoods(runs: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of each run of letters in each language, over all its segmentations."""
    out = np.zeros((len(runs), chances.shape[1]))
    for at in _groups(runs):
        codes, lengths = _padded([runs[k] for k in at])
        alpha = forward(pieces.lattice(codes), chances, codes.shape[1])
        out[at] = np.log(np.maximum(alpha[np.arange(len(at)), lengths], 1e-300))
    return out


def fit(words: list[tuple[str, int, int]], languages: int, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language from (run of letters, language, count)."""
    runs = sorted({w for w, _, _ in words})
    where = {w: k for k, w in enumerate(runs)}
    times = np.zeros((len(runs), languages))
    for w, language, n in words:
        times[where[w], language] += n
    chances = np.full((pieces.size, languages), 1 / pieces.size)
    for _ in range(rounds):
        counts = np.zeros_like(chances)
        for at in _groups(runs):
            codes, lengths = _padded([runs[k] for k in at])
            lattice, places = pieces.lattice(codes), codes.shape[1]
            alpha = forward(lattice, chances, places)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(at)), lengths] = 1
            weight = times[at] / np.maximum(alpha[np.arange(len(at)), lengths], 1e-300)
            for start in range(places - 1, -1, -1):
                for k, found in lattice.items():
                    if start + k <= places:
                        rows = np.flatnonzero(found[:, start] >= 0)
                        if len(rows):
                            p = found[rows, start]
                            tail = chances[p] * beta[rows, start + k]
                            np.add.at(counts, p, alpha[rows, start] * tail * weight[rows])
                            beta[rows, start] += tail
        counts[-1] = 0
        chances = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * pieces.size)
        chances[-1] = 1e-7
    return chances


def runs_of(token: str) -> list[str]:
    """Runs of letters of a token, with a mark in front; of longer runs, parts of RUN letters, the first with the mark."""
    found = _RUNS.findall(token)
    if not all(map(str.isalpha, found)):  # numbers that are no digits
        found = "".join(c if c.isalpha() else " " for c in token).split()
    return [r[k : k + RUN] if k else _START + r[:RUN] for r in found for k in range(0, len(r), RUN)]


class Scorer:
    """Predicts texts; remembers the likelihoods of a bounded number of tokens."""

    def __init__(self, languages: list[str], chances: np.ndarray, pieces: Pieces, remembered: int = 120_000):
        self._languages, self._chances, self._pieces = languages, chances, pieces
        self._limit = min(remembered, TABLE_BYTES // (8 * len(languages) + 8))
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._table = np.zeros((1 << 15, len(self._languages) + 1))  # the last column counts runs of letters

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens)
        runs = [runs_of(t) for t in new]
        flat = [r for x in runs for r in x]
        base = len(self._known)
        while base + len(new) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        if flat:
            own = likelihoods(flat, self._pieces, self._chances)
            place = np.repeat(np.arange(base, base + len(new)), [len(x) for x in runs])
            np.add.at(self._table[:, :-1], place, own)
            np.add.at(self._table[:, -1], place, 1)
        self._known.update(zip(new, range(base, base + len(new)), strict=True))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self._languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        out, scores, at = [], [], 0
        while at < len(texts):
            split, chars = [], 0
            while at < len(texts) and chars < 1_000_000:
                split.append(texts[at].lower().split())
                chars += len(texts[at])
                at += 1
            self._learn(set().union(*split).difference(self._known))
            get = self._known.__getitem__
            for tokens in split:
                total = self._table[np.fromiter(map(get, tokens), np.int64, len(tokens))].sum(axis=0)
                if total[-1] == 0:
                    out.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                out.append(self._languages[best])
                scores.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            if len(self._known) > self._limit:
                self._forget()
        return out, scores


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.setdefault(lang, Counter()).update(r for t in (text or "").lower().split() for r in runs_of(t))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


def train(docs: DataFrame, training: Column, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, from the rows of docs for which training holds."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(training & F.col("lang").isNotNull())
    found = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return [], np.zeros((0, 0))
    cut = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(cut, F.col("lang")) * 1_000_003)
    words = chosen.select("lang", "text").mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    path = path or default_vocabulary()

    def fit_one(found: pa.Table) -> pa.Table:
        chances = fit([(w, 0, n) for w, n in zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)], 1, pieces_of(path))
        return pa.table({"lang": found["lang"][:1], "chances": pa.array([chances[:, 0].tobytes()], pa.binary())})

    fitted = {r["lang"]: np.frombuffer(r["chances"]) for r in words.groupBy("lang").applyInArrow(fit_one, "lang string, chances binary").collect()}
    wordless = fit([], 1, pieces_of(path))[:, 0]
    return languages, np.stack([fitted.get(x, wordless) for x in languages], axis=1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None, columns: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of docs with prediction and score beside them, in place of columns of these names."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*columns)
    path = path or default_vocabulary()
    languages = model[0]
    chances = docs.sparkSession.sparkContext.broadcast(model[1])  # bounded by vocabulary and MAX_LANGUAGES
    names = [*docs.columns, *columns]
    text = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(languages, chances.value, pieces_of(path))
        for batch in batches:
            for piece in slices(batch, 1024, text):
                found, scores = own.predict([x or "" for x in piece.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(predict), f"{shape}, `{columns[0]}` string, `{columns[1]}` double")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5
