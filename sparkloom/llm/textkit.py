"""Vectorised text handling on Arrow string buffers.

Everything here works on raw UTF-8 bytes: the word classes used by the operators are cut at ASCII
bytes only, so a byte table decides membership and no text has to be decoded.  A word has a 64-bit hash, made of
blocks of eight bytes that go through a mixer one after the other; equal words always have equal hashes, and
callers that need certainty compare the bytes of what matched (``distinct_spans``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; bounds a worker's memory whatever the batch holds (one longer text is taken alone).
CHUNK_BYTES = 2 << 20


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        t[lo : hi + 1] = False
    return t


#: Words of shingles: whatever is not a blank, tab, line feed, vertical tab, form feed or carriage return.
SPACE_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of scans: digits, a-z (after lower-casing) and every byte from 0x80.
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed one by one, by BLAKE2.
LONG_SPAN = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(33))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, off


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text has a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """At each place of ``buf`` the eight bytes from there on as one number, zeros behind the end; one more entry than bytes."""
    out = np.zeros(len(buf) + 9, dtype=np.uint64)
    out[: len(buf)] = buf
    for k in (1, 2, 4):
        out[:-k] |= out[k:] << U64(8 * k)
    return out[: len(buf) + 1]


def _block(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The numbers at ``at``, cut to the ``left`` bytes that still belong to the span."""
    return eight[at] & _MASK[np.minimum(left, 8)]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """Hashes of spans; the same bytes have the same hash wherever they stand.  ``eight``: eight_bytes(buf), where it is there already.

    Eight bytes at a time go through the mixer together with what came before, so that no arrangement of blocks
    cancels out as in a sum; spans of up to eight bytes and one length never share a hash.
    """
    length = end - start
    eight = eight_bytes(buf) if eight is None else eight
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * U64(_ODD)
        out = mix(out ^ _block(eight, start, length))
        alive = np.flatnonzero((length > 8) & (length <= LONG_SPAN))
        done = 8
        while len(alive):
            out[alive] = mix(out[alive] * U64(_ODD) + _block(eight, start[alive] + done, length[alive] - done))
            done += 8
            alive = alive[length[alive] > done]
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same_spans(buf: np.ndarray, start: np.ndarray, other: np.ndarray, length: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``start`` and from ``other`` on are the same, over ``length`` bytes."""
    out = np.ones(len(start), dtype=bool)
    alive, done = np.flatnonzero((start != other) & (length > 0) & (length <= LONG_SPAN)), 0
    while len(alive):
        left = length[alive] - done
        same = _block(eight, start[alive] + done, left) == _block(eight, other[alive] + done, left)
        out[alive[~same]] = False
        done += 8
        alive = alive[same & (left > 8)]
    for i in np.flatnonzero((start != other) & (length > LONG_SPAN)).tolist():
        out[i] = np.array_equal(buf[start[i] : start[i] + length[i]], buf[other[i] : other[i] + length[i]])
    return out


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span for each distinct content, for each span the number of its content), decided by the bytes themselves.

    Hashes only put spans together; each is then compared with the one that stands for it, and what differs is
    sorted out by its bytes.
    """
    eight = eight_bytes(buf)
    _, where, inverse = np.unique(span_hashes(buf, start, end, eight), return_index=True, return_inverse=True)
    length, one = end - start, where[inverse]
    other = np.flatnonzero((length != length[one]) | ~same_spans(buf, start, start[one], np.minimum(length, length[one]), eight))
    if len(other):
        number: dict[bytes, int] = {}
        more: list[int] = []
        for i in other.tolist():
            key = buf[start[i] : end[i]].tobytes()
            if key not in number:
                number[key] = len(where) + len(more)
                more.append(i)
            inverse[i] = number[key]
        where = np.concatenate([where, np.array(more, dtype=where.dtype)])
    return where, inverse


class Words:
    """The words of some texts, in order.

    ``start``/``end``: byte range of each word in ``raw``; ``row``: its text; ``first``: index of the
    first word of each text (one more entry than texts); ``hash``: identity of the lower-cased word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        base = int(offsets[0])
        buf = raw[base : int(offsets[-1])]
        if lower:
            buf = LOWER[buf]
        self.raw, rel = buf, (offsets - base).astype(np.int64)
        inside = table[buf]
        n = len(buf)
        is_start = inside.copy()
        is_end = inside.copy()
        if n:
            is_start[1:] &= ~inside[:-1]
            is_end[:-1] &= ~inside[1:]
            heads = rel[:-1][rel[:-1] < rel[1:]]
            is_start[heads] |= inside[heads]
            tails = rel[1:][rel[:-1] < rel[1:]] - 1
            is_end[tails] |= inside[tails]
        self.start = np.flatnonzero(is_start)
        self.end = np.flatnonzero(is_end) + 1
        self.first = np.searchsorted(self.start, rel, side="left")
        self.n_rows = len(rel) - 1
        self.row = np.repeat(np.arange(self.n_rows), np.diff(self.first))
        self.hash = span_hashes(buf, self.start, self.end)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.raw[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)]


def word_hash(word: bytes) -> int:
    """Hash of one lower-cased word, as Words gives it."""
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs that start at each word but the last n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(m, 0x51_7C_C1_B7_27_22_0A_95 * (n + 1) % 2**64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : k + m]) * U64(_ODD)
            out ^= out >> U64(29)
    return mix(out)
