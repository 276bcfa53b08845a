"""Word shingles as 64-bit hashes, and MinHash signatures over them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import WordTable, chunks, lower_ascii, split_words, word_hashes, words_of

SIZE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], table: WordTable, size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words.

    A-Z count as lower case. A text of fewer words has one shingle, the whole sequence; without words it has none.
    """
    for a, b in chunks(texts):
        words, starts = words_of([lower_ascii(t) for t in texts[a:b]], split_words)
        if not words:
            yield from (np.zeros(0, np.uint64) for _ in range(b - a))
            continue
        h = table.take(words)
        rolled = h.copy()
        for k in range(1, size):
            rolled[:-k] = rolled[:-k] * _MIX + h[k:]
        rolled = _mixed(rolled)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            n = e - s
            if n >= size:
                x = np.sort(rolled[s : e - size + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif n:
                whole = np.array([n], np.uint64)
                for w in h[s:e]:
                    whole = whole * _MIX + w
                yield _mixed(whole)
            else:
                yield np.zeros(0, np.uint64)


def word_table(limit: int = 250_000) -> WordTable:
    return WordTable(word_hashes, limit)


class MinHasher:
    """Minima of `count` hash functions over a set: multiply-shift on the set's 64-bit hashes, top 32 bits kept."""

    def __init__(self, count: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.count = count

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """uint32 minima, one row for each set; empty sets have all ones."""
        out = np.full((len(sets), self.count), 0xFFFFFFFF, np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(full):
            # as many sets at a time as stay in the processor's cache
            end, held = at, 0
            while end < len(full) and (end == at or held + len(sets[full[end]]) <= 16_384):
                held += len(sets[full[end]])
                end += 1
            own = full[at:end]
            x = np.concatenate([sets[i] for i in own])
            begins = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own])[:-1]))
            scratch = np.empty_like(x)
            for k in range(self.count):
                np.multiply(x, self.a[k], out=scratch)
                out[own, k] = (np.minimum.reduceat(scratch, begins) >> np.uint64(32)).astype(np.uint32)
            at = end
        return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """int64 key of each band of `rows` minima; keys of different bands differ."""
    bands = minima.shape[1] // rows
    h = np.zeros((len(minima), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(rows):
        h = _mixed(h * _MIX + minima[:, r : bands * rows : rows].astype(np.uint64))
    return h.view(np.int64)


def pack_low_bits(minima: np.ndarray, bits: int) -> np.ndarray:
    """int64 words: for each of the low `bits` of the minima a plane of 64 minima a word, planes in turn."""
    planes = [np.packbits(((minima >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray, count: int, bits: int) -> np.ndarray:
    """How many of `count` minima agree in all kept bits; a and b broadcast over all axes but the last."""
    n = count // 64
    differ = a[..., :n] ^ b[..., :n]
    for k in range(1, bits):
        differ |= a[..., k * n : (k + 1) * n] ^ b[..., k * n : (k + 1) * n]
    return count - np.bitwise_count(differ.view(np.uint64)).sum(axis=-1, dtype=np.int32)


def corrected(agree, count: int, bits: int):
    """Similarity from agreeing low bits: two of 2**bits values agree by chance at times."""
    chance = 1 / (1 << bits)
    return (agree / count - chance) / (1 - chance)
