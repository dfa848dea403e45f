"""64-bit hashes of words and of word sequences, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_MIX = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = np.random.default_rng(6).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def encoded(texts: list[str | None], fold: bool) -> list[bytes]:
    """UTF-8; fold puts A-Z in lower case, and no other letter."""
    return [(t or "").encode().lower() if fold else (t or "").encode() for t in texts]


def _hash_chunk(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    begin = np.cumsum([1, *(len(r) + 1 for r in raws[:-1])])
    space = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, length = turn[0::2], turn[1::2] - turn[0::2]
    counts = np.bincount(np.searchsorted(begin, starts, "right") - 1, minlength=len(raws))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = data[~space].astype(np.uint64)
    off = np.cumsum(length) - length
    at = np.arange(len(letters)) - np.repeat(off, length)
    h = np.add.reduceat((letters + np.uint64(1)) * _WEIGHTS[at & 0xFFFF], off)
    h = mixed(h + length.astype(np.uint64) * _MIX[63])
    for k in np.flatnonzero(length > 1 << 16):  # beyond the table of weights
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + length[k]].tobytes())
    return h, counts


def hash_words(raws: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words -- runs of other bytes than [\\x20\\x09-\\x0D] -- of all texts end to end,
    and each text's number of words.  A word's hash is a random linear form of its bytes, mixed."""
    hashes, counts, part, size = [], [], [], 0
    for k, raw in enumerate(raws):
        part.append(raw)
        size += len(raw)
        if size >= chunk or k == len(raws) - 1:
            h, c = _hash_chunk(part)
            hashes.append(h)
            counts.append(c)
            part, size = [], 0
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word sequences: a random linear form of the words' hashes, mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _MIX[0]
    for j in range(1, k):
        out += words[j : n + j] * _MIX[j]
    return mixed(out)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of a shorter text the one of
    all its words; without words none."""
    words, counts = hash_words(encoded(texts, True))
    every = sequences(words, k)
    at = 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(every[at : at + n - k + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            yield sequences(words[at : at + n], n) + np.uint64(n)
        else:
            yield words[:0]
        at += n
