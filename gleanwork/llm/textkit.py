"""Words, shingles and their digests over whole batches of texts, in numpy.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D. A word's digest is
BLAKE2b of its bytes, 128 bits as two 64-bit halves, so different words can be
taken as different whoever wrote them. All hashes are fixed functions of the
bytes: no seed depends on the process.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.ones(n + 1, bool)  # edge[i]: nothing of a word stands just before i
    edge[1:] = space
    edge[offsets[offsets < n]] = True
    starts = np.flatnonzero(~space & edge[:-1])
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows of 64-bit halves: BLAKE2b of each span. Spans are ascending and don't overlap.

    Equal spans are told apart by their bytes first, so each distinct one is hashed once.
    """
    if not len(starts):
        return np.zeros((2, 0), np.uint64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    flat = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
    distinct = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in spans.dictionary.to_numpy(zero_copy_only=False)])
    return np.ascontiguousarray(np.frombuffer(distinct, np.uint64).reshape(-1, 2).T)[:, spans.indices.to_numpy()]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xC2B2AE3D27D4EB4F) + b)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words of one half; windows may cross texts (see inside()).

    Hashes of 1, 2, 4, ... words are put together, each step mixed.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, size = None, 0, words, 1
    while size <= k:
        if k & size:
            piece = power[at : at + n]
            out, at = piece if out is None else _pair(out, piece), at + size
        if 2 * size <= k:
            power = _pair(power[:-size], power[size:])
        size *= 2
    return mix(out ^ _U(k))


def text_digests(words: np.ndarray, first: np.ndarray) -> list[bytes]:
    """BLAKE2b of the word sequence of each text, from the words' digests."""
    flat = np.ascontiguousarray(words.T).tobytes()
    return [hashlib.blake2b(flat[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def text_of_word(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie in one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """For n words, whether each lies in one of the windows of k words at starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
