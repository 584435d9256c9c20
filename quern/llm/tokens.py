"""Encoding with the tokenizers library, remembered word by word where that is exact."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from quern.llm.merges import Merges

END_ID = 1
_MARK = "\x01"
_TAIL = ".,!?;:"
_LATIN = "\u0250"  # before it, lower-case letters are single code points in NFC
_GROUP = 4_000_000  # characters of text that are encoded together
# what a tokenizer must do before its merges to have plain texts split here
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# kinds of the bytes of plain texts in lower case: ASCII, and letters up to _LATIN
_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[0x21:0x7F] = _SYMBOL
_KINDS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_KINDS[list(b"0123456789")] = _DIGIT
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER


def default_tokenizer() -> str:
    """Path of the public word-end BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lowered(text: str) -> str:
    """A text in lower case, where that gives the same ids: Latin-1 has one lower case everywhere, and special tokens have <|."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordEncoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space before its merges run never lets a token cross a space. Where it splits as the
    public vocabulary does, plain texts are split by arrays of their bytes, and the different pieces of many texts merged
    together. Of other texts each space-separated word has its own ids, and a bounded memory of words gives those of the
    whole text. Other tokenizers encode each text directly.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        mark = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._by_word = (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and r"[^\s" in first.get("pattern", {}).get("Regex", "")
            and all(" " not in t["content"] and "<|" in t["content"] for t in spec.get("added_tokens", []))
            and {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
            and len(mark) == 1
        )
        self._mark_id = mark[0] if mark else -1
        self._model = self._tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._bytes = {c: spell(chr(c))[0][0] for c in range(0x80, ord(_LATIN)) if chr(c).isalpha()}
        then = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
        self._merges = None
        if (
            self._by_word
            and first["pattern"]["Regex"] == _SPLIT
            and spec["normalizer"].get("normalizers") == _NORMAL
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in then] == [("ByteLevel", False, False)]
        ):
            letters = {b: x for c in range(0x21, ord(_LATIN)) for b, x in zip(chr(c).encode(), spell(chr(c))[0][0], strict=True)}
            self._merges = Merges(spec["model"], letters) if Merges.fit(spec["model"], letters) else None
        self._limit = remembered
        self._known: dict[str, bytes] = {"": b""}

    @property
    def wide(self) -> bool:
        """Whether ids need more than 16 bits."""
        return self._tokenizer.get_vocab_size(with_added_tokens=True) > 65_536

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        if self._merges is None:
            return self._by_words(texts)
        out, at = [], 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and chars < _GROUP:
                group.append(texts[at])
                chars += len(texts[at])
                at += 1
            out += self._by_pieces(group)
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        raw = [x.lower().encode() for x in texts]
        data = np.frombuffer(b" ".join([*raw, b"  "]), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw])
        kind = _KINDS[data]
        odd = kind == _OTHER
        one, two = data[:-1], data[1:]
        odd[:-1] |= (one == 0x3C) & (two == 0x7C) | (one == 0xC3) & ((two == 0x97) | (two == 0xB7)) | (one == 0xC9) & (two >= 0x90)  # <| × ÷ and what is beyond
        if odd.any():
            which = np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")).tolist()
            found = dict(zip(which, self._by_words([texts[k] for k in which]), strict=True))
            plain = iter(self._by_pieces([x for k, x in enumerate(texts) if k not in found]))
            return [found[k] if k in found else next(plain) for k in range(len(texts))]
        start = kind != _SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = np.flatnonzero(start & (data == 0x27))
        second, third = data[at + 1], data[at + 2]
        short = np.isin(second, list(b"stmd"))
        long = ((second == 0x72) | (second == 0x76)) & (third == 0x65) | (second == 0x6C) & (third == 0x6C)  # re, ve, ll
        start[at[short | long] + 1] = False
        after = np.append(at[short] + 2, at[long] + 3)
        start[after[kind[after] == _LETTER]] = True
        pieces = np.searchsorted(np.flatnonzero(start), ends)  # up to the end of each text
        if not pieces.any():
            return [b""] * len(texts)
        solid = kind != _SPACE
        data, cuts = data[solid], np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid))
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        place, different = coded.indices.to_numpy(), coded.dictionary
        _, cuts, data = different.buffers()
        ids, size = self._merges.encode(np.frombuffer(data, np.uint8), np.frombuffer(cuts, np.int64)[: len(different) + 1])
        first = np.cumsum(size) - size
        ids = [ids[np.arange(ids.shape[1]) < size[:, None]]]
        at = len(ids[0])
        for k in np.flatnonzero(size == 0).tolist():  # too long for arrays
            ids.append(np.frombuffer(self._merged(different[k].as_py().decode()), np.uint32))
            first[k], size[k] = at, len(ids[-1])
            at += len(ids[-1])
        n = size[place]
        ends = np.cumsum(n)
        ids = np.concatenate(ids)[np.repeat(first[place] - ends + n, n) + np.arange(ends[-1])].astype("<u4", copy=False)
        return [ids[a:b].tobytes() for a, b in pairwise(np.append(0, ends)[np.append(0, pieces)].tolist())]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            split, chars = [], 0
            while at < len(texts) and chars < _GROUP:
                split.append(_lowered(texts[at]).replace("\n", " ").split(" "))
                chars += len(texts[at])
                at += 1
            self._learn(set().union(*split).difference(self._known))
            get = self._known.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            if len(self._known) > self._limit:
                self._known = {"": b""}
        return out

    def _learn(self, words: set[str]) -> None:
        known, rest = self._known, []
        for word in words:
            stem = word.rstrip(_TAIL)
            low = stem.lower()
            if not low.isalpha() or not (low.isascii() or max(low) < _LATIN):
                rest.append(word)
                continue
            ids = known.get(low)
            if ids is None:
                ids = known[low] = self._merged(low)
            if len(stem) < len(word):
                tail = word[len(stem) :]
                if tail not in known:
                    self._ask([tail])
                ids += known[tail]
            known[word] = ids
        self._ask([x for x in rest if _MARK not in x])
        for x in rest:
            if _MARK in x:
                known[x] = np.array(self._tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, part: str) -> bytes:
        """The ids of letters, or of one other piece of ASCII, merged without the tokenizer's normalizer."""
        found = self._model.tokenize(part if part.isascii() else part.translate(self._bytes))
        return array("I", [t.id for t in found]).tobytes()

    def _ask(self, words: list[str]) -> None:
        glue = f" {_MARK} "
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            ids = np.array(self._tokenizer.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(ids == self._mark_id)).tolist()
            raw, at = ids.tobytes(), 0
            for word, cut in zip(part, [*cuts, len(raw)], strict=True):
                self._known[word] = raw[at:cut]
                at = cut + 4


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
