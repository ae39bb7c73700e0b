"""N-gram Jaccard join over count vectors.

A document's set holds the hashes of its distinct word n-grams.  Two sets of sizes a and b reach the
threshold of p per cent only if their difference is at most (100 - p)(a + b) / (100 + p).

1. Equal sets are collapsed to their smallest id (pre-aggregated, so copies are no hot key).
2. Blocking.  Hash space is cut into more groups than the difference allows; two sets that reach the threshold
   hold the same n-grams in one group at least.  Sets that share a group's content meet.  Groups are
   so many that empty ones need not count: of a set with more empty groups than allowed for, they do.
3. Candidates.  N-grams are hashed into groups of a second kind, whose counts are points of an R-tree; the sum of
   coordinate minima bounds the overlap of two points, or of two boxes.  Points that meet and keep the bound
   are candidates, and connected candidates are the units of the search.  Nothing is lost so far.
4. Search.  In a unit each set stands once, with the number of its rows, and all pairs that keep the bound are verified
   on the sets.  Of meetings and units over ``tile_rows`` documents, pairs of tiles are tasks.
5. Links are counted; those that connect something and copies are joined to components.

N-grams are compared by 64-bit hashes of their words, sets recognised as equal by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as T
from .common import arrow_groups, components, cut, rows_of_groups, table

GROUPS = 64
_RATIO = 1.35
GRAMS_AT_ONCE = 4_000_000


def ngram_sets(raw: np.ndarray, off: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes); fewer words than n make one n-gram, no words none."""
    for i, j in T.chunks(off):
        w = T.Words(raw, off[i : j + 1], T.SPACE_WORDS)
        grams = T.ngram_hashes(w.hash, n)
        first = w.first
        for r in range(w.n_rows):
            a, b = first[r], first[r + 1]
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield i + r, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield i + r, T.ngram_hashes(w.hash[a:b], int(b - a))
            else:
                yield i + r, np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits that identify a set of sorted hashes."""
    return struct.unpack("<qq", hashlib.blake2b(s, digest_size=16).digest())


class Signatures:
    """Identities of the contents of the hash groups of a set, for each size class it can meet a partner in."""

    def __init__(self, percent: int):
        self.p = percent
        self.bounds = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def _class(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(int(self.bounds[-1] * _RATIO) + 1)
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def groups(self, c: int) -> tuple[int, int]:
        """(groups, empty groups allowed for) where the larger of two sets is in class c.

        More groups than the largest difference and the allowed empty ones together: so two sets have a
        common group that is not empty, or each of them has more empty ones.
        """
        most = 2 * (self.bounds[c + 1] - 1) * (100 - self.p) // (100 + self.p)
        least = max(1, self.bounds[c] * self.p // 100)
        groups, empty = most + 1, 0
        for _ in range(20 if most else 0):
            mean = groups * math.exp(-least / groups)
            empty = math.ceil(mean + 4 * math.sqrt(mean))
            groups = most + 1 + empty
        return groups, empty

    def of(self, s: np.ndarray) -> np.ndarray:
        size = len(s)
        out = []
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(s + np.uint64(77)))])
            top = self._class(max(size, size * 100 // self.p))
            for c in range(self._class(size), top + 1):
                g, empty = self.known.setdefault(c, self.groups(c)) if c not in self.known else self.known[c]
                if g == 1:  # only equal sets reach the threshold here
                    continue
                step = np.uint64(2**64 // g)
                at = np.concatenate([[0], np.searchsorted(s, np.arange(1, g, dtype=np.uint64) * step), [size]])
                content = total[at[1:]] - total[at[:-1]]
                own = T.mix(content + T.mix(np.arange(g, dtype=np.uint64) + np.uint64(c << 40)))
                some = at[1:] > at[:-1]
                out.append(own[some] if g - some.sum() <= empty else own)
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts of a set's n-grams in groups of hashes, a power of two of them: so many that unrelated sets of the size
    mostly fail the bound, and that every count fits a byte."""
    groups = max(GROUPS, 1 << (len(s) // 4).bit_length())
    while True:
        counts = np.bincount((s >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def common_groups(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors in as many groups as the shortest has, a row a set."""
    least = min(map(len, vectors))
    return np.stack([v.astype(np.int32).reshape(least, -1).sum(axis=1) for v in vectors])


class CountTree:
    """R-tree over the rows of ``counts``, loaded in bulk; boxes are kept as their largest counts and least size."""

    LEAF, FAN = 16, 16

    def __init__(self, counts: np.ndarray, percent: int):
        self.p = percent
        size = counts.sum(axis=1)
        self.order = self._tiles(counts, size)
        self.counts, self.size = counts[self.order], size[self.order]
        self.levels = []
        high, low = self.counts, self.size
        step = self.LEAF
        while True:
            cuts = np.arange(0, len(low), step)
            high, low = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))
            if len(low) == 1:
                break
            step = self.FAN

    def _tiles(self, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order that puts near points together: halves along the coordinate that spreads most, sizes first."""
        points = np.concatenate([size[:, None], counts], axis=1).astype(np.float32)
        out, todo = [], [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= self.LEAF:
                out.append(part)
                continue
            own = points[part]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            part = part[np.argsort(own[:, axis], kind="stable")]
            half = (len(part) // 2 + self.LEAF - 1) // self.LEAF * self.LEAF
            todo += [part[half:], part[:half]]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _may(self, high, low, highs, lows) -> np.ndarray:
        return (100 + self.p) * np.minimum(high, highs).sum(axis=-1, dtype=np.int64) >= self.p * (low + lows)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose summed minima allow the threshold, each once, a leaf at a time."""
        for leaf in range(len(self.levels[0][1])):
            high, low = self.levels[0][0][leaf], self.levels[0][1][leaf]
            nodes = np.arange(len(self.levels[-1][1]))
            for depth in range(len(self.levels) - 1, -1, -1):
                highs, lows = self.levels[depth]
                nodes = nodes[self._may(high, low, highs[nodes], lows[nodes])]
                if depth:
                    kids = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                    nodes = kids[kids < len(self.levels[depth - 1][1])]
            nodes = nodes[nodes >= leaf]
            rows = (nodes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
            rows = rows[rows < len(self.size)]
            own = np.arange(leaf * self.LEAF, min((leaf + 1) * self.LEAF, len(self.size)))
            for x in own:
                other = rows[rows > x]
                other = other[self._may(self.counts[x], self.size[x], self.counts[other], self.size[other])]
                if len(other):
                    yield np.full(len(other), self.order[x]), self.order[other]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def candidates_of(counts: np.ndarray, percent: int, tile: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of what pairs that keep the bound connect, each point with the first one; not every such pair keeps the bound itself."""
    parent = list(range(len(counts)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = ((int(xs[0]), y) for xs, ys in CountTree(counts, percent).pairs() for y in ys.tolist())
    for x, y in pairs:
        if tile is None or tile[x] != tile[y]:
            a, b = top(x), top(y)
            parent[max(a, b)] = min(a, b)
    return [(top(x), x) for x in range(len(counts)) if top(x) != x]


def verified(sets: list[np.ndarray], percent: int, weight: np.ndarray, tile: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of what links connect, each set with the first one; and of each set the summed weights of those it links with.

    tile: pairs within one tile are left out.
    """
    parent = list(range(len(sets)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    distinct, gram = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), dtype=bool)
    total = np.zeros(len(sets), dtype=np.int64)
    counts = common_groups([count_vector(s) for s in sets])
    for xs, ys in CountTree(counts, percent).pairs():
        x = int(xs[0])
        ys = ys[size[ys] > 0] if tile is None else ys[(size[ys] > 0) & (tile[ys] != tile[x])]
        if not size[x] or not len(ys):
            continue
        mark[gram[off[x] : off[x + 1]]] = True
        part = np.cumsum(size[ys]) // GRAMS_AT_ONCE
        for own in np.split(ys, np.flatnonzero(part[1:] != part[:-1]) + 1):
            end = np.cumsum(size[own])
            at = np.arange(end[-1]) + np.repeat(off[own] - (end - size[own]), size[own])
            common = np.add.reduceat(mark[gram[at]], end - size[own], dtype=np.int64)
            hit = own[(100 + percent) * common >= percent * (size[x] + size[own])]
            total[x] += weight[hit].sum()
            total[hit] += weight[x]
            for y in hit.tolist():
                a, b = top(x), top(y)
                parent[max(a, b)] = min(a, b)
        mark[gram[off[x] : off[x + 1]]] = False
    return [(top(x), x) for x in range(len(sets)) if top(x) != x], total


def links_of(sets: list[np.ndarray], percent: int, tile: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of what links connect, each set with the first one.  tile: pairs within one tile are left out."""
    return verified(sets, percent, np.ones(len(sets), np.int64), tile)[0]


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, tile_rows: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs``.

    Words are what stands between blanks, A-Z lower-cased.  component_id: the smallest doc_id that links
    reach, the own one included.  Texts that are null, empty or blank have an empty set and link with
    nothing.  Rows that share a doc_id are one node of the graph; a row with a null doc_id is returned
    with its size, no component and no links.  n_links counts the other rows with an id whose sets reach the
    threshold with the row's own, copies included.  An empty table gives no rows; other columns play no part.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key_type = dict(source.dtypes)["doc_id"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            got = [(len(s), *set_id(s), count_vector(s).tobytes()) for _, s in ngram_sets(raw, off, n)]
            cols = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_shingles", "f1", "f2", "counts"])

    each = cut(source.mapInArrow(sizes, f"doc_id {key_type}, n_shingles long, f1 long, f2 long, counts binary"))
    known = each.where("n_shingles > 0 and doc_id is not null")
    first = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last")
    copies = known.join(first, ["f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a set's copies in a partition give its signatures once
        make = Signatures(percent)
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            rows, sigs, fps = [], [], []

            def out(ids=batch.column(0), rows=rows, sigs=sigs, fps=fps):
                size = [len(x) for x in sigs]
                at = np.repeat(np.array(rows, np.int64), size)
                got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(fps, np.int64), size)), ids.take(pa.array(at))], names=["sig", "f1", "doc_id"])
                rows.clear(), sigs.clear(), fps.clear()
                return got

            for r, s in ngram_sets(raw, off, n):
                if not len(s) or not batch.column(0)[r].is_valid:
                    continue
                f = set_id(s)
                if f in seen:
                    continue
                if len(seen) < 2_000_000:  # beyond, a copy's signatures may be given again; nothing else changes
                    seen.add(f)
                own = make.of(s)
                if len(own):
                    rows.append(r), sigs.append(own), fps.append(f[0])
                if len(rows) >= 4000:
                    yield out()
            if rows:
                yield out()

    by_sig = Window.partitionBy("sig")
    met = source.mapInArrow(signatures, f"sig long, f1 long, doc_id {key_type}")
    same = [F.min("f1").over(by_sig).alias("lo"), F.max("f1").over(by_sig).alias("hi"), F.count("*").over(by_sig).alias("m"), F.bit_xor(F.xxhash64("doc_id")).over(by_sig).alias("who")]
    # Meetings of the same documents are one: what names a meeting is its size and the documents in it.
    met = met.select("doc_id", "f1", *same).where("lo <> hi").select("who", "doc_id", "f1", F.col("m"), F.ceil(F.col("m") / tile_rows).cast("int").alias("tiles"))
    met = cut(met.distinct().select(F.xxhash64("who", "m").alias("meeting"), "doc_id", "f1", "tiles"))
    given = met.select("doc_id", "f1").distinct()

    tiled = lambda df, *key: df.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        key[0], F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", *key[1:]
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Array] = [[], []]
        for group in rows_of_groups(batches, ["meeting", "i", "j"]):
            if group.num_rows < 2:
                continue
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            counts = common_groups([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in group["counts"]])
            ids = group["doc_id"].to_pylist()
            for x, y in candidates_of(counts, percent, np.asarray(group["tile"]) if i != j else None):
                found[0].append(ids[x]), found[1].append(ids[y])
            if len(found[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow_key) for x in found], names=["u", "v"])
                found = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, arrow_key) for x in found], names=["u", "v"])

    arrow_key = to_arrow_type(source.schema["doc_id"].dataType)
    order = ["meeting", "i", "j", "doc_id"]
    vectors = known.select("doc_id", "f1", "f2", "counts").join(given, ["doc_id", "f1"], "left_semi").distinct()
    spots = tiled(met.join(vectors.drop("f2"), ["doc_id", "f1"]), "meeting", "doc_id", "counts").repartition(*order[:3]).sortWithinPartitions(*order)
    families = cut(components(spots.mapInArrow(meet, f"u {key_type}, v {key_type}"), "u", "v"))
    sized = families.join(families.groupBy("component").agg(F.count("*").alias("m")), "component")
    weights = known.groupBy("f1", "f2").agg(F.count("*").alias("weight"))
    # All rows of a set that gave signatures are in one family, as they met wherever one of them did: each set once.
    members = sized.select(F.col("node").alias("doc_id"), F.col("component").alias("family"), F.ceil(F.col("m") / tile_rows).cast("int").alias("tiles"))
    members = members.join(vectors.drop("counts"), "doc_id").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "family", "tiles")).alias("x")).join(weights, ["f1", "f2"]).select("x.*", "f1", "f2", "weight")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            own = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            rows, data = [], []
            for r, s in ngram_sets(raw, off, n):
                if set_id(s) == own[r]:  # of rows that share an id, those with the set that is meant
                    rows.append(r), data.append(s.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 2, 3, 4, 5, 6)), pa.array(data, pa.binary())], names=["doc_id", "family", "tiles", "f1", "f2", "weight", "grams"])

    texts = source.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "family", "tiles", "f1", "f2", "weight")
    placed = tiled(texts.mapInArrow(sets, f"doc_id {key_type}, family {key_type}, tiles int, f1 long, f2 long, weight long, grams binary"), "family", "doc_id", "f1", "f2", "weight", "grams")

    def search(group: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        group = group.take(pa.array(np.sort(np.unique(np.stack([np.asarray(group["f1"]), np.asarray(group["f2"])]), axis=1, return_index=True)[1])))  # repeated rows
        grams = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["grams"]]
        found, total = verified(grams, percent, np.asarray(group["weight"]), np.asarray(group["tile"]) if i != j else None)
        ids, some = group["doc_id"].combine_chunks(), np.flatnonzero(total)
        names = ["u", "v", "f1", "f2", "n"]
        ends = [ids.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ends, *(pa.nulls(len(found), pa.int64()) for _ in range(3))], names=names)
        counted = *(group[c].combine_chunks().take(pa.array(some)) for c in ("f1", "f2")), pa.array(total[some])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), ids.type), pa.nulls(len(some), ids.type), *counted], names=names)

    found = cut(arrow_groups(placed, ["family", "i", "j"], ["doc_id"], search, f"u {key_type}, v {key_type}, f1 long, f2 long, n long"))
    nodes = components(copies.unionByName(found.where("n is null").select("u", "v")), "u", "v").withColumnRenamed("node", "doc_id")
    linked = weights.join(found.where("n is not null").groupBy("f1", "f2").agg(F.sum("n").alias("n")), ["f1", "f2"], "left").select("f1", "f2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    got = each.select("doc_id", "n_shingles", "f1", "f2").join(linked.where("n_links > 0"), ["f1", "f2"], "left").join(nodes, "doc_id", "left")
    n_links = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("n_links"))
    return got.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))


def _row_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A string for each row that differs with its id or text, in the order of the ids; rows without an id come last."""
    kind = dict(docs.dtypes)[doc_id]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        of_id = F.lpad(F.hex(F.col(doc_id).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        of_id = F.col(doc_id).cast("string")
    return F.concat(F.when(F.col(doc_id).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), of_id)), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for, with the columns they have.

    Decided by rows: of linked texts the one with the smallest doc_id stays, of equal ids the smallest MD5 of the text.
    Rows that share an id but have different texts are apart; rows equal in id and text are reduced to one; rows
    without an id are compared too and come after all others.  Empty and null texts link with nothing; of such rows with
    one id (or none) one stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    at = dict(zip(docs.columns, names, strict=True))
    own = docs.toDF(*names)
    own = own.withColumn("key", _row_key(own, at[doc_id], at[text])).withColumn("node", F.xxhash64("key"))
    found = join(own, doc_id="node", text=at[text], **options).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct()
    rows = own.select("key", "node").join(found, "node")  # numbers of 64 bits stand for the rows in the search
    first = rows.groupBy("component").agg(F.min("key").alias("key")).select("key")
    shared = rows.groupBy("node").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("node")
    kept = cut(first.unionByName(rows.join(shared, "node", "left_semi").select("key")).distinct())  # rows whose numbers clash stay
    return own.join(kept, "key", "left_semi").dropDuplicates(["key"]).drop("key", "node").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=3, percent=90)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), u AS (SELECT g, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g
), x AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM u
), p AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL
), e AS (
  SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)
  UNION SELECT rep, doc_id FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) JOIN u USING (g) WHERE doc_id <> rep
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), class AS (SELECT doc_id, rep, count(*) OVER (PARTITION BY rep) AS copies FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) JOIN u USING (g)
), met AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 90 * (na + nb - i)
), reps AS (SELECT rep, any_value(copies) AS copies FROM class GROUP BY rep
), other AS (SELECT met.a AS rep, sum(reps.copies) AS n FROM met JOIN reps ON reps.rep = met.b GROUP BY met.a
), walk(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT w.node, b FROM walk w JOIN both_ways ON a = w.seen)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(class.copies - 1 + coalesce(other.n, 0), 0) AS BIGINT) AS n_links
FROM s JOIN (SELECT node, min(seen) AS component_id FROM walk GROUP BY node) c ON c.node = s.doc_id LEFT JOIN class ON class.doc_id = s.doc_id LEFT JOIN other ON other.rep = class.rep
"""
