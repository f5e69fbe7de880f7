"""Distinct word shingles of texts as 64-bit hashes, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text hashed at once; bounds a worker's temporary arrays, not the texts.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and n powers of _STEP and of its inverse, all modulo 2**64."""
    values = np.random.default_rng(20240601).integers(0, 2**64, 256, np.uint64)
    inverse = pow(_STEP, -1, 2**64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_STEP), np.uint64(inverse)
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _words_of_piece(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of raw and the place of its first byte; ends: where documents end inside raw."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values, up, down = _tables(max(PIECE + 1, 1 << int(len(raw)).bit_length()))
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[(ends > 0) & (ends < len(raw))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    h += (e - s).astype(np.uint64)
    return mix(h), s


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of raw of about PIECE bytes that end at a document's end or at white space."""
    at, n = 0, int(offsets[-1])
    while at < n:
        to = at + PIECE
        if to >= n:
            to = n
        else:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                stop = int(offsets[k + 1])
                while to < stop:  # inside one long text
                    if len(hit := np.flatnonzero(_SPACE[raw[to : to + PIECE]])):
                        to += int(hit[0])
                        break
                    to += PIECE
                to = min(to, stop)
        yield at, to
        at = to


def word_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word of the texts raw[offsets[i]:offsets[i + 1]].

    Words are runs of bytes other than space and \\t to \\r; A-Z count as a-z.
    """
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    hashes, docs = [], []
    for a, b in _pieces(data, offsets):
        i, j = np.searchsorted(offsets, (a, b), "left")
        h, s = _words_of_piece(data[a:b], offsets[i : j + 1] - a)
        hashes.append(h)
        docs.append(np.searchsorted(offsets, s + a, "right") - 1)
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(raw: bytes, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    A text of fewer words has its whole word sequence as its one shingle; a text without words has none.
    """
    h, doc = word_hashes(raw, offsets)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    ends = np.cumsum(counts)
    g = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for j in range(words):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[j : len(h) - words + 1 + j]
    mix(g)
    for i in range(n):
        c, e = int(counts[i]), int(ends[i])
        if c >= words:
            yield np.unique(g[e - c : e - words + 1])
        elif c:
            one = np.full(1, c, np.uint64)
            for x in h[e - c : e]:
                one *= np.uint64(0xD6E8FEB86659FD93)
                one += x
            yield mix(one)
        else:
            yield np.empty(0, np.uint64)


def buffers(column) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; a null row is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data)[int(offsets[0]) : int(offsets[-1])].tobytes() if data is not None else b""
    return raw, offsets - offsets[0]


def slices(batch, name: str = "text", limit: int = 8 << 20):
    """Parts of an Arrow batch with about limit bytes of text each, and one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column if pa.types.is_binary(column.type) else column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > at and total + s > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield batch.slice(at)
