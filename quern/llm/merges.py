"""Byte-pair merges of many pieces at once, in arrays."""

from __future__ import annotations

import numpy as np

#: Bytes of a piece at most.
LONGEST = 32
NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a BPE model, of at most 65,536 tokens, whose pieces are bytes spelled as in ByteLevel.

    In each round every piece has its merge of lowest rank done, of equal ones the leftmost, as the library does one by one.
    """

    @staticmethod
    def fit(model: dict, letters: dict[int, str]) -> bool:
        """Whether the model is of this kind: no options that change merges, and every byte has its tokens."""
        options = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        vocab, last = model.get("vocab"), model.get("end_of_word_suffix") or ""
        return (
            model.get("type") == "BPE"
            and not any(map(model.get, options))
            and max(vocab.values()) < 65_536
            and all(x in vocab and x + last in vocab for x in letters.values())
        )

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, last = model["vocab"], model.get("end_of_word_suffix") or ""
        self._first, self._last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for byte, x in letters.items():
            self._first[byte], self._last[byte] = vocab[x], vocab[x + last]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ranks = {(vocab[a] << 16) + vocab[b]: k for k, (a, b) in enumerate(pairs)}  # of a repeated pair the last holds
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys, rank = np.array(list(ranks), np.int64), np.array(list(ranks.values()), np.int64)
        self._base, self._table = self._displaced(keys, rank)

    @staticmethod
    def _displaced(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A table with key << 20 | rank at base[first] + second (modulo its size), base chosen so that none meet."""
        size = 1 << max(16, (4 * len(keys)).bit_length())
        table, base, free = np.full(size, -1, np.int64), np.zeros(1 << 16, np.int64), np.ones(size, bool)
        order = np.argsort(keys >> 16, kind="stable")
        rows = np.split(order, np.flatnonzero(np.diff(keys[order] >> 16)) + 1)
        draw = np.random.default_rng(7)
        for row in sorted(rows, key=len, reverse=True):
            while len(row):
                at = (keys[row] & 0xFFFF) + (move := int(draw.integers(size))) & (size - 1)
                if free[at].all():
                    base[keys[row[0]] >> 16], table[at], free[at] = move, keys[row] << 20 | rank[row], False
                    break
        return base, table

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self._table[self._base[a] + b & (len(self._table) - 1)]
        return np.where(found >> 20 == (a.astype(np.int64) << 16) + b, found & 0xFFFFF, NONE).astype(np.int32)

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[cuts[k]:cuts[k + 1]] in rows of LONGEST, and the number of each one's; 0 of a longer or empty piece."""
        size = np.diff(cuts)
        ids, counts = np.zeros((len(size), LONGEST), np.uint32), np.zeros(len(size), np.int64)
        for n in range(1, LONGEST + 1):
            alike = np.flatnonzero(size == n)
            for k in range(0, len(alike), 8192):
                self._merge(data, cuts, alike[k : k + 8192], n, ids, counts)
        return ids, counts

    def _merge(self, data: np.ndarray, cuts: np.ndarray, number: np.ndarray, n: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """The same for pieces of n bytes, by number: a column each, all of one length, that leaves with its last merge."""
        raw = data[cuts[number] + np.arange(n)[:, None]]
        own = self._first[raw]
        own[-1] = self._last[raw[-1]]
        rank = self._ranks(own[:-1], own[1:])
        while n > 1:
            least = rank.min(axis=0)
            live = least != NONE
            if not live.all():
                ended = np.flatnonzero(~live)
                ids[number[ended], :n], counts[number[ended]] = own[:, ended].T, n
                live = np.flatnonzero(live)
                if not len(live):
                    return
                own, rank, least, number = own.take(live, 1), rank.take(live, 1), least[live], number[live]
            at = np.empty(len(least), np.int64)  # the leftmost pair of that rank
            for j in range(n - 2, -1, -1):
                np.copyto(at, j, where=rank[j] == least)
            own[at, np.arange(len(at))] = self._made[least]
            for j in range(1, n - 1):
                behind = at < j
                np.copyto(own[j], own[j + 1], where=behind)
                np.copyto(rank[j], rank[j + 1], where=behind) if j < n - 2 else None
            n -= 1
            own, rank = own[:n], rank[: n - 1]
            for there, column in ((at, np.flatnonzero(at < n - 1)), (at - 1, np.flatnonzero(at > 0))):
                there = there[column]
                rank[there, column] = self._ranks(own[there, column], own[there + 1, column])
        ids[number, :n], counts[number] = own.T, n
