"""Benchmark decontamination with a distributed positional inverted index.

``index`` stores the postings of all words of the training texts: for each term and block of documents the sorted
positions, as differences in as few bytes as hold them.  Terms go to buckets by their hash; a row holds the lists of
one bucket in one block.  The table is dealt by bucket and block, so that the list of a frequent term lies in many
partitions, and is written once, in the folder that the cluster shares; a search reads it as often as it needs.  Terms
are stored as they are, so that no hash decides a match.

A search takes the terms of the test windows, counts them in the index, and fetches their lists by block.  In a block
each window starts from the list of its rarest term, moved back by the term's offset; that is intersected with the lists
of the others in the order of their rarity, each moved by its own offset.  What is left are the exact matches.  Proximity
matches start from the rarest term too: each further term must stand within so many words of it, and the places that
remain are looked through for a span that holds all terms, in any order.

Test windows go to all tasks.  A test set over ``block_mb`` is searched in blocks of items, and what the blocks hit is united.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import arrow_groups, cut, folder, remove, stored, table

NOTHING = hashlib.sha256(b"").hexdigest()
BUCKETS = 32
#: Consecutive words in which the words of a window must stand for a proximity match, in windows.
NEAR = 2


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text; none for null."""
    raw, off = T.text_buffers(pa.array([text], pa.string()))
    return [w.decode() for w in T.Words(raw, off, T.ALNUM_WORDS).text(0, 1 << 62)]


def pack_positions(position: np.ndarray, count: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each run of ``count`` ascending positions as differences, and the bytes (1, 2 or 4) that one takes in each run."""
    if not len(count):
        return [], np.empty(0, np.uint8)
    end = np.cumsum(count)
    begin = end - count
    step = np.diff(position, prepend=0)
    step[begin] = position[begin]
    most = np.maximum.reduceat(step, begin)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)
    narrow = {k: step.astype(f"<u{k}").tobytes() for k in np.unique(width).tolist()}
    return [narrow[k][a * k : b * k] for a, b, k in zip(begin.tolist(), end.tolist(), width.tolist(), strict=True)], width


def unpack_positions(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64))


def index(docs: DataFrame, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of a table, stored at ``path`` (a new folder below the shared one): rows of postings, and one row of the directory for each block.

    Postings: block, bucket, terms (between blanks), and for each of them its occurrences (n), the bytes of a difference
    (widths) and its positions in words of the block, one after the other.  Directory: block, ids (of its rows, in order,
    null ids and repeated rows included) and firsts (the position of each row's first word, and the number of words).
    A null text has no words; an empty table has an index without rows.  Other columns play no part.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names = ["block", "bucket", "terms", "n", "widths", "positions", "ids", "firsts"]
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in T.chunks(off):
                w = T.Words(raw, off[i : j + 1], T.ALNUM_WORDS)
                where, term = T.distinct_spans(w.raw, w.start, w.end)
                bucket = (w.hash[where] % T.U64(BUCKETS)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # terms by bucket, positions by term in that order
                place = np.empty(len(where), dtype=np.int64)
                place[order] = np.arange(len(where))
                count = np.bincount(place[term], minlength=len(where)).astype(np.int32)
                lists, width = pack_positions(np.argsort(place[term], kind="stable"), count)
                content = [w.raw[a:b].tobytes() for a, b in zip(w.start[where[order]].tolist(), w.end[where[order]].tolist(), strict=True)]
                ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
                some = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
                blobs = [[b" ".join(content[a:b]) for _, a, b in some], [count[a:b].tobytes() for _, a, b in some], [width[a:b].tobytes() for _, a, b in some], [b"".join(lists[a:b]) for _, a, b in some]]
                own = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(4)), own, pa.array([w.first.astype(np.int64).tobytes()], pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(some), pa.int64()), pa.array([k for k, _, _ in some], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs),
                    pa.nulls(len(some), own.type), pa.nulls(len(some), pa.binary()),
                ], names=names)
                block += 1

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"block long, bucket int, terms binary, n binary, widths binary, positions binary, ids array<{kind}>, firsts binary")
    return stored(rows.repartition("bucket", "block"), path or folder(docs.sparkSession, "index"))


@dataclass
class Phrases:
    """Distinct phrases (word lists) and the ids of the items each stands in."""

    terms: list[str] = field(default_factory=list)
    by_length: dict[int, np.ndarray] = field(default_factory=dict)  # phrase length -> term numbers, a row a phrase
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, str | None]], window: int | None) -> Phrases:
        """The windows of items; one with fewer words, but not none, is one phrase, as is any without a window.  A null id stands in no list."""
        owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            w = words_of(text)
            size = window or len(w)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                owners[tuple(w[i : i + size])] |= {str(item_id)} if item_id is not None else set()
        out = cls(sorted({w for p in owners for w in p}))
        number = {w: i for i, w in enumerate(out.terms)}
        for n in sorted({len(p) for p in owners}):
            own = sorted(p for p in owners if len(p) == n)
            out.by_length[n] = np.array([[number[w] for w in p] for p in own], dtype=np.int32)
            out.items[n] = [tuple(sorted(owners[p])) for p in own]
        return out

    def by_rarity(self, frequency: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the offsets in a phrase, that of the rarest term first."""
        return {n: np.argsort(frequency[rows], axis=1, kind="stable") for n, rows in self.by_length.items()}


class Lists:
    """The posting lists of a block for some terms, as one sorted array of (term, position)."""

    STEP = 4_000_000  # candidates at once

    def __init__(self, lists: dict[int, np.ndarray], n_terms: int, firsts: np.ndarray):
        self.firsts, self.words = firsts, int(firsts[-1])
        self.size = np.zeros(n_terms, dtype=np.int64)
        for t, positions in lists.items():
            self.size[t] = len(positions)
        self.begin = np.cumsum(self.size) - self.size
        numbers = sorted(lists)
        self.position = np.concatenate([lists[t] for t in numbers]) if numbers else np.empty(0, np.int64)
        self.key = np.repeat(np.array(numbers, np.int64), self.size[numbers]) * (self.words + 1) + self.position

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, side="right") - 1

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Has the list of each term a position from low to high?"""
        base = term.astype(np.int64) * (self.words + 1)
        at = np.minimum(np.searchsorted(self.key, base + low), len(self.key) - 1)
        return (self.key[at] >= base + low) & (self.key[at] <= base + high)

    def starts(self, phrases: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(occurrence of its rarest term, phrase) of the phrases whose terms all stand in the block, some at a time."""
        alive = np.flatnonzero((self.size[phrases] > 0).all(axis=1))
        rare = phrases[alive, order[alive, 0]]
        size = self.size[rare]
        part = np.cumsum(size) // self.STEP
        for k in np.split(np.arange(len(alive)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            if len(k):
                which = np.repeat(k, size[k])
                inner = np.arange(len(which)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
                yield self.position[self.begin[rare[which]] + inner], alive[which]

    def exact(self, phrases: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of each exact occurrence."""
        n = phrases.shape[1]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at, which in self.starts(phrases, order):
            at = at - order[which, 0]
            keep = (at >= 0) & (at + n <= self.words)
            at, which = at[keep], which[keep]
            keep = self.row(at) == self.row(at + n - 1)
            at, which = at[keep], which[keep]
            for r in range(1, n):
                offset = order[which, r]
                keep = self.holds(phrases[which, offset], at + offset, at + offset)
                at, which = at[keep], which[keep]
                if not len(at):
                    break
            found.append((at, which))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, phrases: np.ndarray, order: np.ndarray, within: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of spans of ``within`` words in one text that hold all terms, one at most for each occurrence of the rarest.

        known: row * len(phrases) + phrase of matches that need no second look.
        """
        found: list[tuple[int, int]] = []
        for at, which in self.starts(phrases, order):
            if known is not None and len(known):
                keep = ~np.isin(self.row(at) * len(phrases) + which, known)
                at, which = at[keep], which[keep]
            for r in range(1, phrases.shape[1]):
                row = self.row(at)
                low, high = np.maximum(at - within + 1, self.firsts[row]), np.minimum(at + within, self.firsts[row + 1]) - 1
                keep = self.holds(phrases[which, order[which, r]], low, high)
                at, which = at[keep], which[keep]
                if not len(at):
                    break
            for p, phrase in zip(at.tolist(), which.tolist(), strict=True):
                if (s := self._span(p, np.unique(phrases[phrase]), within)) is not None:
                    found.append((s, phrase))
        return np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=np.int64)

    def _span(self, p: int, terms: np.ndarray, within: int) -> int | None:
        """The latest start, up to p, of a span that holds p and all terms."""
        row = int(self.row(np.array([p]))[0])
        low, high = max(p - within + 1, self.firsts[row]), min(p + within, self.firsts[row + 1])
        lists = [self.position[self.begin[t] : self.begin[t] + self.size[t]] for t in terms.tolist()]
        inside = [q[np.searchsorted(q, low) : np.searchsorted(q, high)] for q in lists]
        for s in sorted({p, *(int(x) for q in inside for x in q if x <= p)}, reverse=True):
            if all(np.any((q >= s) & (q < s + within)) for q in inside):
                return s
        return None


def _search(stored_index: DataFrame, phrases: Phrases, run, schema: str) -> DataFrame:
    """``run`` over (block, lists) of all blocks, with the offsets by rarity; what it yields are rows of ``schema``."""
    number = {t.encode(): i for i, t in enumerate(phrases.terms)}  # goes to all tasks: bounded by a block of the test set
    buckets = sorted({T.word_hash(t) % BUCKETS for t in number})

    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, found, n, positions = [], [], [], []
            for i, block in enumerate(batch.column(0).to_pylist()):
                count, width = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=t).astype(np.int64) for k, t in ((2, np.int32), (3, np.uint8)))
                end = np.cumsum(count * width)
                data = batch.column(4)[i].as_buffer()
                hits = [(k, t) for k, w in enumerate(batch.column(1)[i].as_py().split(b" ")) if (t := number.get(w)) is not None]
                for k, t in hits:
                    blocks.append(block), found.append(t), n.append(count[k])
                    positions.append(data[int(end[k] - count[k] * width[k]) : int(end[k])].to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(found, pa.int32()), pa.array(n, pa.int32()), pa.array(positions, pa.binary())], names=["block", "t", "n", "positions"])

    rows = stored_index.where(F.col("bucket").isin(buckets)) if buckets else stored_index.limit(0)
    postings = rows.select("block", "terms", "n", "widths", "positions").mapInArrow(lists_of, "block long, t int, n int, positions binary")
    counts = {r["t"]: r["n"] for r in postings.groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a test term
    order = phrases.by_rarity(np.array([counts.get(t, 0) for t in range(len(phrases.terms))], dtype=np.int64))
    directory = stored_index.where("bucket is null").select("block", F.lit(-1).alias("t"), F.lit(0).alias("n"), F.col("firsts").alias("positions"))

    def block(group: pa.Table) -> Iterator[pa.RecordBatch]:
        terms, n = group["t"].to_pylist(), group["n"].to_pylist()
        if len(terms) < 2:
            return
        data = [x.as_buffer() for x in group["positions"]]
        lists = Lists({t: unpack_positions(d, k) for t, k, d in zip(terms[1:], n[1:], data[1:], strict=True)}, len(phrases.terms), np.frombuffer(data[0], dtype=np.int64))
        yield from run(group["block"][0].as_py(), lists, order)

    return arrow_groups(postings.unionByName(directory), ["block"], ["t"], block, schema)


def _documents(stored_index: DataFrame) -> DataFrame:
    """(block, row, doc_id, n_words) of each indexed document."""
    kind = stored_index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.int64)
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.arange(n, dtype=np.int32)), batch.column(1)[i].values, pa.array(np.diff(first))], names=["block", "row", "doc_id", "n_words"])

    return stored_index.where("bucket is null").select("block", "ids", "firsts").mapInArrow(run, f"block long, row int, doc_id {kind}, n_words long")


def search(stored_index: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = 13, near: int = NEAR, block_mb: float = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, n_near) for each row of the indexed table.

    A word inside any occurrence of a window of an item is hit; item_ids lists (sorted as strings) the
    items with an occurring window; n_near counts the items with a window whose words all stand within ``near`` * ``window``
    consecutive words, in any order.  Null or empty items have no windows; repeated item rows count once; an empty table on
    either side gives rows without hits, or no rows.  Other columns of the test set play no part.
    """
    queries = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // int(block_mb * (1 << 20))))
    within = near * window
    schema = "block long, row int, starts binary, ends binary, items array<string>, close array<string>"

    def part(number: int) -> DataFrame:
        phrases = Phrases.build([(r["i"], r["t"]) for r in queries.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == number).collect()], window)

        def run(block: int, lists: Lists, order: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            close: dict[int, set[str]] = defaultdict(set)
            for n, rows in phrases.by_length.items():
                at, which = lists.exact(rows, order[n])
                row = lists.row(at)
                for r, a in zip(row.tolist(), at.tolist(), strict=True):
                    spots[r].append((a, a + n))
                known = np.unique(row * len(rows) + which)
                for k in known.tolist():
                    items[k // len(rows)].update(phrases.items[n][k % len(rows)])
                at, which = lists.near(rows, order[n], within, known)
                for k in np.unique(lists.row(at) * len(rows) + which).tolist():
                    close[k // len(rows)].update(phrases.items[n][k % len(rows)])
            some = sorted({*spots, *close})
            ends = [np.array(sorted(set(spots[r])), dtype=np.int64).reshape(-1, 2) for r in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([x[:, 0].tobytes() for x in ends], pa.binary()), pa.array([x[:, 1].tobytes() for x in ends], pa.binary()),
                pa.array([sorted(items[r]) for r in some], pa.list_(pa.string())), pa.array([sorted(close[r] | items[r]) for r in some], pa.list_(pa.string())),
            ], names=["block", "row", "starts", "ends", "items", "close"])

        return _search(stored_index, phrases, run, schema)

    found = part(0)
    for number in range(1, parts):
        found = cut(found).unionByName(part(number))

    def unite(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """What the blocks of the test set hit in one document: the words covered by their intervals."""
        a, b = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in group[c]]) for c in ("starts", "ends"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
        before = np.concatenate([a[:1], b[:-1]])
        hit = int((b - np.maximum(a, before)).clip(0).sum())
        items, close = (sorted({x for v in group[c].to_pylist() for x in v}) for c in ("items", "close"))
        yield pa.RecordBatch.from_arrays(
            [group["block"].combine_chunks()[:1], group["row"].combine_chunks()[:1], pa.array([hit]), pa.array([items], pa.list_(pa.string())), pa.array([len(close)])], names=["block", "row", "n_hit", "item_ids", "n_near"]
        )

    united = arrow_groups(found, ["block", "row"], [], unite, "block long, row int, n_hit long, item_ids array<string>, n_near long")
    none = F.array().cast("array<string>")
    got = _documents(stored_index).join(united, ["block", "row"], "left")
    return got.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``search`` over a new index of ``docs``: a row for each of its rows.  The rows found are kept, and the index is deleted."""
    return _indexed(docs, doc_id, text, lambda made: search(made, benchmark, **options))


def _indexed(docs: DataFrame, doc_id: str, text: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = folder(docs.sparkSession, "index")
    try:
        return cut(f(index(docs, path, doc_id=doc_id, text=text)))
    finally:
        remove(docs.sparkSession, path)


def proximity(docs: DataFrame, queries: dict[str, str], *, within: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, query, word): where all words of a query stand within ``within`` consecutive words, in any order.

    ``word`` is the first word of the span, counted from 0 in the document; one row at most for each occurrence of the query's
    rarest word.  A query without words matches nothing.  Each row of ``docs`` is searched, repeated ones and those with a
    null id too; null texts and an empty table give no rows; other columns play no part.
    """
    phrases = Phrases.build(list(queries.items()), None)

    def run(block: int, lists: Lists, order: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = []
        for n, rows in phrases.by_length.items():
            at, which = lists.near(rows, order[n], within)
            row = lists.row(at)
            out += [(r, q, s) for r, s, w in zip(row.tolist(), (at - lists.firsts[row]).tolist(), which.tolist(), strict=True) for q in phrases.items[n][w]]
        cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), *cols], names=["block", "row", "query", "word"])

    def places(made: DataFrame) -> DataFrame:
        found = _search(made, phrases, run, "block long, row int, query string, word long")
        return _documents(made).drop("n_words").join(found, ["block", "row"]).select("doc_id", "query", "word")

    return _indexed(docs, doc_id, text, places)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Hit words are at least a twentieth of a document's words."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a test window, with the columns they have.

    However long a document is, a passage in it counts.  Decided by the text alone, so that rows with equal texts share
    their fate and ids may be null or repeated; rows without a text stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    own = docs.toDF(*names)
    of_text = F.md5(F.col(names[docs.columns.index(text)]))
    hits = scan(own.select(of_text.alias("doc_id"), F.col(names[docs.columns.index(text)]).alias("text")), benchmark, **options)
    gone = hits.where("n_hit > 0").select(F.col("doc_id").alias("gone")).distinct()
    return own.join(gone, of_text == F.col("gone"), "left_anti").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    hits = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"), "n_near",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), spot AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT a.rid, a.i, a.n, w.item FROM spot a JOIN win w ON a.s = w.s AND a.n = w.n
), word AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
), bag AS (SELECT s, list_distinct(string_split(s, ' ')) AS own FROM (SELECT DISTINCT s FROM win)
), both_have AS (
  SELECT rid, s FROM (SELECT s, own, unnest(own) AS t FROM bag) JOIN (SELECT rid, unnest(list_distinct(w)) AS t FROM d) USING (t) GROUP BY rid, s, own HAVING count(*) = len(own)
), close_by AS (
  SELECT DISTINCT rid, s FROM (SELECT d.rid, bag.s, own, w, unnest(range(1, len(w) + 1)) AS i FROM both_have JOIN d USING (rid) JOIN bag USING (s))
  WHERE list_contains(own, w[i]) AND list_has_all(w[i:i + 25], own)
), near_items AS (
  SELECT rid, count(DISTINCT item) AS n_near FROM close_by JOIN win USING (s) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN word USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near_items USING (rid)
"""
