"""Sets of hashed five-word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEPS[0]
    x = (x ^ (x >> np.uint64(29))) * _STEPS[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and where each text's words end."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    lengths = stops - starts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(lengths.max(), _ODD))
        inside = np.flatnonzero(~space)
        place = np.arange(len(inside)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        values = (_LOWER[raw[inside]] + np.uint64(1)) * powers[place]
        sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return _mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text's words are one shingle."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS if len(joined) else 0):
            joined += words[k : k + len(joined)] * _STEPS[k]
            joined = (joined ^ (joined >> np.uint64(33))) * _ODD
        joined = _mix(joined)
        out, a = [], 0
        for b in ends.tolist():
            if b - a >= WORDS:
                out.append(np.unique(joined[a : b - WORDS + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = _mix(h * _ODD + w)
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            a = b
    return out


def grouped_sets(texts: list[str | None], chars: int = 1_000_000) -> list[np.ndarray]:
    """shingle_sets in groups of bounded size."""
    out, at = [], 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and size < chars:
            group.append((texts[at] or "").encode())
            size += len(group[-1])
            at += 1
        out += shingle_sets(group)
    return out
