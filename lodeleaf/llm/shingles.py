"""Words and shingles of Arrow string columns as 64-bit hashes, in numpy over the column's bytes.

A-Z count as lower case; words are runs of bytes other than ASCII white space.
Bytes are worked through in blocks, so a long text needs memory for its words,
not for every byte at eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 1 << 19
#: Texts of a batch that are worked on together, in bytes.
GROUP_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), U)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(BASE, BLOCK + 1), powers(pow(BASE, -1, 2**64), BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) for runs of rows of about GROUP_BYTES."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + GROUP_BYTES, side="right")) - 1)
        own = offs[first : last + 1]
        yield first, own - own[0], raw[own[0] : own[-1]]
        first = last


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end."""
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    start[edges] = ~space[edges]
    end = ~space
    end[:-1] &= space[1:]
    closing = offsets[1:][np.diff(offsets) > 0] - 1
    end[closing] = ~space[closing]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text, where each word begins and ends)."""
    starts, ends = word_spans(offsets, data)
    hashes = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        size = int(ends[j - 1] - low)
        if size > BLOCK:  # a single word longer than a block
            h = U(0)
            for part in range(low, int(ends[i]), BLOCK):
                piece = LOWER[data[part : min(part + BLOCK, int(ends[i]))]].astype(U) + U(1)
                h = mix(np.array([h ^ np.sum(piece * POWERS[: len(piece)], dtype=U)], U))[0]
            hashes[i] = h
        else:
            sums = np.zeros(size + 1, U)
            np.cumsum((LOWER[data[low : low + size]].astype(U) + U(1)) * POWERS[:size], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            hashes[i:j] = (sums[e] - sums[s]) * INVERSES[s] ^ ((e - s).astype(U) << U(40))
        i = j
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return mix(hashes), counts, starts, ends


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, one hash of them all."""
    words, counts, _, _ = word_hashes(offsets, data)
    n = len(words)
    if not n:
        return [np.zeros(0, U)] * len(counts)
    wide = np.append(words, np.zeros(SHINGLE, U))
    rolled = np.zeros(n, U)
    for i in range(SHINGLE):
        rolled = rolled * U(BASE) + wide[i : i + n]
    rolled = mix(rolled ^ U(SHINGLE))
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            own = np.sort(rolled[at : at + c - SHINGLE + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif c:
            h = U(c)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    h = h * U(BASE) + w
            out.append(mix(np.array([h ^ U(c << 8)], U)))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out
