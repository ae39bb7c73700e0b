"""Token ids packed into rows of one length.

Texts are encoded by a byte-level BPE whose rank file the caller names; distinct pre-tokens are encoded once
a task, known again by their bytes.  A document's ids end with the end id.  Documents longer than a row are split without loss.  Pieces
are then packed best-fit-decreasing: the longest first, each into the fullest row that still holds it, which
a segment tree over free capacities finds.  Packing needs no exchange: a task packs groups of consecutive
documents of its partition (``group_tokens`` at a time), so its memory is bounded and a lost task is redone
from its input alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import textkit as T
from .common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that the rank file was made with (a fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = ~T.SPACE_WORDS


class Encoder:
    """Byte-level BPE; ids of whole texts, each distinct span between white space encoded once."""

    KEPT = 500_000

    def __init__(self, ranks_file: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.end_id = max(self.ranks.values()) + 1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes | tuple[bytes], int] = {}  # number of each span; its ids are flat[at : at + size]
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def one(self, b: bytes) -> list[int]:
        try:
            return self.bpe.encode_ordinary(b.decode())
        except UnicodeDecodeError:  # not UTF-8: byte by byte, so that nothing is lost
            return [self.ranks[b[i : i + 1]] for i in range(len(b))]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        base = int(off[0])
        buf, rel = raw[base : int(off[-1])], off - base
        n = len(buf)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(rel) - 1, np.int64)
        blank = _SPACE[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[rel[:-1]] = True
        before, after = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)  # is the neighbour blank / a letter, in one text?
        before[1:], after[:-1] = blank[:-1], ~blank[1:]
        after &= ~first[1:]
        joined = np.zeros(n, dtype=bool)
        joined[1:] = buf[:-1] == 0x20
        start = first[:n] | (blank & ~before) | (blank & after) | (~blank & before & ~joined)
        start = np.flatnonzero(start)
        end = np.concatenate([start[1:], [n]])
        row = np.searchsorted(rel, start, side="right") - 1
        odd = self._odd_rows(buf, rel)
        if len(odd):  # white space beyond ASCII: the pattern sees the whole text
            keep = ~np.isin(row, odd)
            start, end, row = start[keep], end[keep], row[keep]
            start, end, row = (np.concatenate(x) for x in ((start, rel[odd]), (end, rel[odd + 1]), (row, odd)))
            order = np.argsort(start, kind="stable")
            start, end, row = start[order], end[order], row[order]
        whole = np.isin(row, odd)
        where, inverse = T.distinct_spans(buf, start, end)
        if len(self.known) > self.KEPT:
            self._forget()
        slot = self._learn(buf, start[where], end[where], whole[where])[inverse]
        own = self.size[slot]
        out = self.flat[np.repeat(self.at[slot] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        return out, np.bincount(row, own, len(rel) - 1).astype(np.int64)

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Numbers of distinct spans; those that are not known yet are encoded, in one call as far as they can be."""
        content = [buf[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        # A span seen as a whole text may hold white space that ends a pre-token elsewhere: it has a key of its own.
        keys = [(c,) if w else c for c, w in zip(content, whole.tolist(), strict=True)]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        plain = [i for i in new if not whole[i] and not _SPACE[buf[end[i] - 1]]]
        ids = np.empty(0, np.int32)
        stops = np.empty(0, np.int64)
        if plain:  # a line feed is a pre-token of its own between such spans
            try:
                ids = np.array(self.bpe.encode_ordinary(b"\n".join([*(content[i] for i in plain), b""]).decode()), dtype=np.int32)
                stops = np.flatnonzero(ids == self.ranks[b"\n"])
            except UnicodeDecodeError:
                pass
            if len(stops) != len(plain):  # some span is no UTF-8 text
                plain, ids, stops = [], np.empty(0, np.int32), np.empty(0, np.int64)
        joined = set(plain)
        lists = [(i, self.one(content[i])) for i in new if i not in joined]
        begin = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64) if len(stops) else stops
        size = np.array([len(x) for _, x in lists], dtype=np.int64)
        at = np.concatenate([begin, len(ids) + np.cumsum(size) - size]) + len(self.flat)
        for number, i in enumerate([*plain, *(i for i, _ in lists)], len(self.known)):
            self.known[keys[i]] = number
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, stops - begin, size])
        self.flat = np.concatenate([self.flat, ids, np.array([x for _, y in lists for x in y], dtype=np.int32)])
        return np.array([self.known[k] for k in keys], dtype=np.int64)

    @staticmethod
    def _odd_rows(buf: np.ndarray, rel: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.isin(buf, (0xC2, 0xE1, 0xE2, 0xE3)))
        at = at[at < len(buf) - 1]
        a, b = buf[at], buf[at + 1]
        hit = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        return np.unique(np.searchsorted(rel, at[hit], side="right") - 1)


class Capacities:
    """Segment tree over free capacities 0..length: which of them some open row has."""

    def __init__(self, length: int):
        self.n = 1 << length.bit_length()
        self.open = [0] * (2 * self.n)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.n
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) with the smallest capacity that is least or more; the row leaves the tree."""
        i = least + self.n
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):  # up, until a right neighbour has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.n
        row = self.rows[capacity].pop()
        while i:
            self.open[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to length.  Ties go by piece number."""
    tree, rows = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = tree.take(size) if size < length else None
        if got is None:
            got = length, len(rows)
            rows.append([])
        rows[got[1]].append(i)
        if got[0] > size:
            tree.put(got[0] - size, got[1])
    return rows


def pack(docs: DataFrame, *, ranks: bytes, doc_id: str = "doc_id", text: str = "text", length: int = 2048, group_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of ``length`` ids.

    part, pack: number of the task and of the row in it; n_tokens: ids in use; ids: a row of the id matrix,
    little-endian unsigned, of 2 bytes an id (4 for large vocabularies), filled up with the end id;
    cu_seqlens: cumulative segment lengths from 0; position_resets: where a segment begins and positions restart at 0;
    doc_ids, pieces: document of each segment and number of the piece in it; offsets: its first id's place in the document.
    Null and empty texts are the end id alone; null doc_ids stay null; every row of ``docs`` is packed once, repeated ones
    too; an empty table gives no rows; other columns play no part.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks)
        kind = "<u2" if encoder.end_id < 65536 else "<u4"
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        held_ids: list[np.ndarray] = []
        held_size: list[np.ndarray] = []
        held_docs: list[pa.Array] = []
        packed = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal packed
            size = np.concatenate(held_size)
            flat = np.concatenate(held_ids)
            names = pa.chunked_array(held_docs).combine_chunks()
            held_ids.clear(), held_size.clear(), held_docs.clear()
            begin = np.cumsum(size) - size
            pieces = -(-size // length)
            doc = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            offset = number * length
            own = np.minimum(length, size[doc] - offset)
            rows = best_fit_decreasing(own, length)
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                matrix = np.full((len(some), length), encoder.end_id, dtype=kind)
                for r, row in enumerate(some):
                    x = 0
                    for p in row:
                        a = begin[doc[p]] + offset[p]
                        matrix[r, x : x + own[p]] = flat[a : a + own[p]]
                        x += own[p]
                order = np.concatenate([np.array(r) for r in some])
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in some])])
                lists = pa.array(bounds, pa.int32())
                cu = [np.concatenate([[0], np.cumsum(own[r])]) for r in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), part, np.int32)), pa.array(packed + np.arange(len(some), dtype=np.int64)),
                    pa.array(np.array([c[-1] for c in cu], dtype=np.int32)), pa.array([m.tobytes() for m in matrix], pa.binary()),
                    pa.array([c.tolist() for c in cu], pa.list_(pa.int32())), pa.array([c[:-1].tolist() for c in cu], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(lists, names.take(pa.array(doc[order]))), pa.ListArray.from_arrays(lists, pa.array(number[order].astype(np.int32))),
                    pa.ListArray.from_arrays(lists, pa.array(offset[order].astype(np.int32))),
                ], names=["part", "pack", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "offsets"])
                packed += len(some)

        waiting = 0
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            for i, j in T.chunks(off):
                ids, size = encoder.encode(raw, off[i : j + 1])
                whole = np.insert(ids, np.cumsum(size), encoder.end_id)
                held_ids.append(whole), held_size.append(size + 1), held_docs.append(batch.column(0).slice(i, j - i))
                waiting += len(whole)
                if waiting >= group_tokens:
                    yield from flush()
                    waiting = 0
        if waiting:
            yield from flush()

    ints = ArrayType(IntegerType())
    schema = docs.sparkSession.createDataFrame([], "part int, pack long, n_tokens int, ids binary").schema
    schema = schema.add("cu_seqlens", ints).add("position_resets", ints).add("doc_ids", ArrayType(source.schema["doc_id"].dataType)).add("pieces", ints).add("offsets", ints)
    return source.mapInArrow(run, schema)


def write(packs: DataFrame, path: str) -> None:
    """The packed rows as Parquet: the id matrix as one fixed-size binary a row, the rest as arrays."""
    packs.write.parquet(path)


def unpack(packs: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(part, doc_id, piece, offset, ids): the ids of each segment again, as little-endian bytes."""
    each = packs.select("part", "ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces", "offsets")).alias("i", "x"))
    a, b = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    ids = F.substring("ids", a * id_bytes + 1, (b - a) * id_bytes)
    return each.select("part", F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), F.col("x.offsets").alias("offset"), ids.alias("ids"))


def read_ranks(path: str = TOKENIZER) -> bytes:
    """The vocabulary file, read on the driver; tasks get its bytes, whose size the vocabulary bounds."""
    with open(path, "rb") as f:
        return f.read()


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ranks=read_ranks())
