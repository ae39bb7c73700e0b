"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label and length are ordered by 62 concatenated signs of random projections (a pass
has its own planes, laid through the label's mean, so that a direction common to the label says nothing), and each is
compared with the ``window`` vectors that follow it.  Near vectors agree in most signs and stand close in some pass.
Pairs whose cosine reaches the threshold are united across passes.

Passes go in rounds, each with as many as all before it.  A label whose last round joined what was apart before gets
another one, so that easy labels are done after two rounds and crowded ones take as many as they need; a pair that one
pass brings together with probability q is missed by k passes with (1 - q) ** k, and a round that joins nothing says that
little is left.  Where the next passes of a label would compare as many pairs as there are, its tiles are compared with
each other instead, all pairs; labels no larger than the window are complete after one pass.

The links of the components are then counted exactly, tile against tile, so that a dense group of any size has all
its links, however narrow the window.  Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, components, cut, table

SIGNS = 62
TILE_BYTES = 16 << 20
ROWS, COLUMNS = 512, 8192


def _planes(number: int, dim: int) -> np.ndarray:
    """The projections of one pass."""
    return np.random.default_rng([dim, number]).standard_normal((dim, SIGNS))


def _spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indices of pairs of numbers under n that connect what those before them don't."""
    parent = np.arange(n).tolist()

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def window_links(unit: np.ndarray, window: int, threshold: float, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between rows at most ``window`` apart such as connect them; pairs of the first ``old`` rows are left out."""
    n = len(unit)
    chain = np.zeros(n, dtype=np.int64)  # rows linked with their neighbours share a number
    us, vs = [], []
    for o in range(1, min(window, n - 1) + 1):
        hit = np.flatnonzero(np.einsum("ij,ij->i", unit[:-o], unit[o:]) >= threshold)
        if o == 1:
            chain[1:] = 1
            chain[hit + 1] = 0
            chain = np.cumsum(chain)
        else:
            hit = hit[chain[hit] != chain[hit + o]]
        hit = hit[hit + o >= old]
        us.append(hit)
        vs.append(hit + o)
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    keep = _spanning(n, u, v)
    return u[keep], v[keep]


def _vectors(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of equal length, as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=kind).reshape(len(column), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Connected:
    """Of pairs given row by row, those that connect what the ones before don't."""

    def __init__(self, n: int):
        self.part = np.arange(n)
        self.u: list[int] = []
        self.v: list[int] = []

    def add(self, x: int, others: np.ndarray) -> None:
        others = others[self.part[others] != self.part[x]]
        if len(others):
            parts, first = np.unique(self.part[others], return_index=True)
            self.u += [x] * len(parts)
            self.v += others[first].tolist()
            self.part[np.isin(self.part, parts)] = self.part[x]


def compare(unit: np.ndarray, weight: np.ndarray, tile: np.ndarray, threshold: float, within: bool) -> tuple[np.ndarray, Connected]:
    """Summed weights of what each vector links with, and connecting links: of all pairs (``within``), or those of two tiles."""
    n, dim = unit.shape
    single = unit.astype(np.float32)
    least = np.float32(threshold - (dim + 8) * 2.0**-22)  # below what rounding can take from a product
    left, right = (np.arange(n), np.arange(n)) if within else (np.flatnonzero(tile == tile[0]), np.flatnonzero(tile != tile[0]))
    total, connected = np.zeros(n, dtype=np.int64), Connected(n)
    for a in range(0, len(left), ROWS):
        rows = left[a : a + ROWS]
        for b in range(a if within else 0, len(right), COLUMNS):  # within a tile the pairs behind the diagonal
            columns = right[b : b + COLUMNS]
            may = single[rows] @ single[columns].T >= least
            if within:
                may &= rows[:, None] < columns
            x, y = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(x):
                continue
            x, y = rows[x], columns[y]
            near = unit[x] @ unit[y].T >= threshold
            if within:
                near &= x[:, None] < y
            total[x] += near @ weight[y]
            total[y] += weight[x] @ near
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                connected.add(int(x[i]), y[near[i]])
    return total, connected


def links(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, passes: int = 8, window: int = 32, tile_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id) for each row.

    Only vectors with equal labels and lengths are compared, by cosine in double precision.  A row links with
    nothing (0 links, a component of its own) if its id, label or vector is null, or its vector is empty, zero
    or holds null or non-finite components.  Equal rows link with each other.  n_links counts the other rows
    linked directly.  An empty table gives no rows; other columns play no part.  passes: of the first round; window: vectors that
    each one is compared with in a pass.
    """
    kind = "f4" if "float" in dict(vectors.dtypes)[embedding] else "f8"
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            flat, off = col.values, np.asarray(col.offsets)
            null = np.asarray(flat.is_null()) if len(flat) else np.zeros(0, bool)
            data = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(data))])
            filled = np.concatenate([[0], np.cumsum(data != 0)])
            data = data + 0  # -0.0 is 0.0
            ok = (bad[off[1:]] == bad[off[:-1]]) & (filled[off[1:]] > filled[off[:-1]]) & np.asarray(col.is_valid())
            out = [data[a:b].tobytes() if k else None for a, b, k in zip(off[:-1].tolist(), off[1:].tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    each = source.mapInArrow(pack, "vec_id long, label string, v binary")
    each = each.withColumn("v", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("v"))).withColumn("key", F.md5("v"))
    valid = each.where("v is not null")
    classes = cut(valid.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("v").alias("v")))
    each_len = F.octet_length("v").alias("len")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums of the unit vectors of each label and length."""
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["label", "len", "m", "total"])

        for batch in batches:
            labels, length = np.array(batch.column(0).to_pylist(), dtype=object), np.asarray(batch.column(1))
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                unit = _vectors(batch.column(2).take(pa.array(at)), kind)
                names, inverse = np.unique(labels[at].astype(str), return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                first = np.searchsorted(inverse[order], np.arange(len(names)))
                for name, count, part in zip(names.tolist(), np.bincount(inverse).tolist(), np.add.reduceat(unit[order], first, axis=0), strict=True):
                    have = held.setdefault((name, n), [0, np.zeros(unit.shape[1])])
                    have[0] += count
                    have[1] += part
            if len(held) > 4096:
                yield out()
        yield out()

    def mean(group: pa.Table) -> Iterator[pa.RecordBatch]:
        m = sum(group["m"].to_pylist())
        total = np.sum([np.frombuffer(x.as_buffer()) for x in group["total"]], axis=0) / m
        yield pa.RecordBatch.from_arrays([group["label"].combine_chunks()[:1], group["len"].combine_chunks()[:1], pa.array([m]), pa.array([total.tobytes()], pa.binary())], names=["label", "len", "m", "mean"])

    partial = classes.select("label", each_len, "v").mapInArrow(sums, "label string, len int, m long, total binary")
    stats = cut(arrow_groups(partial, ["label", "len"], [], mean, "label string, len int, m long, mean binary").where("m > 1"))

    def one_round(todo: DataFrame, first: int, last: int) -> DataFrame:
        """Connecting links (u, v, label, len) of the passes from ``first`` to before ``last``, for the labels of ``todo``."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length = np.asarray(batch.column(1))
                for n in np.unique(length).tolist():
                    part = batch.take(pa.array(np.flatnonzero(length == n)))
                    unit = _vectors(part.column(3), kind) - np.frombuffer(b"".join(x.as_buffer() for x in part.column(4))).reshape(part.num_rows, -1)
                    for p in range(first, last):
                        code = ((unit @ _planes(p, unit.shape[1]) > 0).astype(np.int64) << np.arange(SIGNS)[::-1]).sum(axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(code), p, np.int32)), part.column(1), part.column(0), pa.array(code), part.column(2), part.column(3)], names=["pass", "len", "label", "code", "rep", "v"]
                        )

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail: pa.Table | None = None
            for batch in batches:
                now = pa.Table.from_batches([batch])
                old = tail.num_rows if tail is not None else 0
                now = pa.concat_tables([tail, now]).combine_chunks() if old else now
                group = list(zip(now["pass"].to_pylist(), now["len"].to_pylist(), now["label"].to_pylist(), strict=True))
                starts = [i for i in range(len(group)) if not i or group[i] != group[i - 1]] + [len(group)]
                reps = np.asarray(now["rep"])
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    u, v = window_links(_vectors(now["v"].slice(a, b - a), kind), window, threshold, max(0, old - a))
                    if len(u):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reps[a + u]), pa.array(reps[a + v]), pa.array([group[a][2]] * len(u), pa.string()), pa.array([group[a][1]] * len(u), pa.int32())], names=["u", "v", "label", "len"]
                        )
                tail = now.slice(max(0, now.num_rows - window))

        members = classes.select("label", each_len, "rep", "v").join(todo.select("label", "len", "mean"), ["label", "len"]).select("label", "len", "rep", "v", "mean")
        order = ["pass", "len", "label", "code", "rep"]
        placed = members.mapInArrow(hashed, "pass int, len int, label string, code long, rep long, v binary")
        return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, "u long, v long, label string, len int")

    def tiled(members: DataFrame, group: list[str]) -> DataFrame:
        """Each pair (i, j) of the tiles of a group, with the rows of both."""
        rows = members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return rows.select(*group, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "weight", "v")

    def count(group: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, i, j = np.asarray(group["tile"]), group["i"][0].as_py(), group["j"][0].as_py()
        if len(tile) < 2 or (i != j and (tile == tile[0]).all()):
            return
        rep = np.asarray(group["rep"])
        total, connected = compare(_vectors(group["v"], kind), np.asarray(group["weight"]), tile, threshold, i == j)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.nulls(len(some), pa.int64()), pa.array(total[some])], names=["u", "v", "n"])
        u, v = (rep[np.array(x, dtype=np.int64)] for x in (connected.u, connected.v))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "n"])

    tiles_of = lambda m, size: F.ceil(F.greatest(F.sqrt(m / tile_rows), m * size / TILE_BYTES)).cast("int")
    todo, done = stats, 0
    families: DataFrame | None = None
    while True:
        more = max(passes, done)
        met = cut(one_round(todo, done, done + more))
        done += more
        if families is None:
            fresh = met
        else:  # what was apart before this round
            part = families.select(F.col("node"), F.col("component"))
            fresh = met.join(part.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(part.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
            fresh = fresh.where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
        again = cut(stats.where(F.col("m") > window + 1).join(fresh.select("label", "len").distinct(), ["label", "len"], "left_semi"))
        edges = met.select("u", "v") if families is None else families.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(fresh.select("u", "v"))
        families = cut(components(edges, "u", "v"))
        whole = again.where(F.col("m") <= 4 * window * done)
        if not whole.isEmpty():
            members = classes.select("label", each_len, "rep", "weight", "v").join(whole.select("label", "len", tiles_of(F.col("m"), F.col("len")).alias("tiles")), ["label", "len"])
            rest = cut(arrow_groups(tiled(members, ["label", "len"]), ["label", "len", "i", "j"], ["rep"], count, "u long, v long, n long")).where("n is null").select("u", "v")
            families = cut(components(families.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest), "u", "v"))
        todo = again.where(F.col("m") > 4 * window * done)
        if todo.isEmpty():
            break

    sized = families.join(families.groupBy("component").agg(F.count("*").alias("size")), "component")
    members = classes.join(sized, classes["rep"] == sized["node"])
    members = members.select("component", tiles_of(F.col("size"), F.octet_length("v")).alias("tiles"), "rep", "weight", "v")
    found = arrow_groups(tiled(members, ["component"]), ["component", "i", "j"], ["rep"], count, "u long, v long, n long")
    counted = found.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.select("label", "key", "rep", "weight").join(counted, "rep", "left").join(families.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = each.select("vec_id", "label", "key").join(known, ["label", "key"], "left")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    got = links(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), walk(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.node, b FROM walk w JOIN p ON a = w.seen)
SELECT v.vec_id, CAST((SELECT count(*) FROM p WHERE p.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(seen) AS component_id FROM walk GROUP BY node) c ON c.node = v.vec_id
"""
