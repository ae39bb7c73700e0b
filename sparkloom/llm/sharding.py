"""Shards of near equal bytes by histogram sort.

Documents are ordered by a key: 60 bits of the text's MD5, then 60 bits of the id's.  For each boundary the
bytes below candidate keys are counted exactly, one pass over all partitions for all boundaries at once; the
bin that holds a boundary is split again until it holds one key.  Then every row knows its shard from the
splitters alone, and rows are exchanged once.

Equal texts have equal first keys, so they stand together.  A boundary that falls into a group of equal texts is
moved to the group's nearer end if the group is at most ``tolerance`` of a shard; a larger group is cut at the
second key.  Sizes so differ from equal ones by less than the tolerance and one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, table

BITS, COARSE, FINE = 60, 12, 8
ROWS_A_TASK = 4096


def _key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns that decide, without the texts: null texts count as empty, null ids as empty strings."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        _key(t).alias("k1"), _key(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("k2"),
    )


@dataclass(frozen=True)
class Place:
    """The key in whose bytes a target lies, the bytes below it and its own."""

    key: int
    below: int
    size: int

    def ends_nearer(self, target: int) -> bool:
        """Is the key's end nearer to the target than its beginning?"""
        return 2 * (target - self.below) >= self.size


def locate(rows: DataFrame, key: str, targets: list[int], below: int = 0) -> dict[int, Place]:
    """Where each target (a count of bytes) lies in the order of ``key``; ``below``: bytes before the first row.

    Each pass counts the bins of the intervals that still hold several keys: at most 2**COARSE or targets * 2**FINE sums.
    """
    out: dict[int, Place] = {}
    shift = BITS - COARSE
    todo = {None: (below, sorted(set(targets)))}  # interval (number at the shift before) -> bytes below it, targets in it
    before = BITS
    while todo:
        part = rows if None in todo else rows.where(F.shiftright(key, before).isin(list(todo)))
        sums = part.groupBy(F.shiftright(key, shift).alias("bin")).agg(F.sum("size").alias("size"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        again = {}
        for interval, (base, wanted) in todo.items():
            at = base
            for r in sorted((r for r in sums if interval is None or r["bin"] >> (before - shift) == interval), key=lambda r: r["bin"]):
                own = [t for t in wanted if at <= t < at + r["size"]]
                if own and r["low"] == r["high"]:
                    out |= dict.fromkeys(own, Place(r["low"], at, r["size"]))
                elif own:
                    again[r["bin"]] = at, own
                at += r["size"]
        todo, before, shift = again, shift, max(0, shift - FINE)
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """For each shard but the first the least (k1, k2) in it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [-(-j * total // shards) for j in range(1, shards)]
    first = locate(rows, "k1", [t for t in targets if t < total])
    large: dict[Place, list[int]] = {}
    out: dict[int, tuple[int, int]] = {}
    for t, p in first.items():
        if p.size * shards <= tolerance * total or p.below == t:
            out[t] = p.key + p.ends_nearer(t), 0
        else:
            large.setdefault(p, []).append(t)
    for p, own in large.items():
        for t, q in locate(rows.where(F.col("k1") == p.key), "k2", own, p.below).items():
            out[t] = p.key, q.key + q.ends_nearer(t)
    return [out.get(t, (1 << BITS, 0)) for t in targets]


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for a, b in bounds:
        out = out + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
    return out


def assign(docs: DataFrame, *, shards: int = 16, tolerance: float = 0.02, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row.

    size: UTF-8 bytes of the text and 1; slot: place in the shard, from 0 without gaps, in the order of the id's key.
    Null texts count as empty.  Rows equal in id and text are in one shard.  Other columns play no part; an
    empty table gives no rows.
    """
    rows = cut(keys(docs, doc_id, text))
    placed = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)))
    got = numbered(placed.withColumn("tie", F.shiftleft("k1", 3)), "shard", "k2", ["tie", "doc_id"], BITS, ROWS_A_TASK)
    return got.select("doc_id", "size", "text_crc32", "shard", F.col("i").cast("long").alias("slot"))


def write(docs: DataFrame, path: str, *, shards: int = 16, tolerance: float = 0.02, doc_id: str = "doc_id", text: str = "text", files: int = 8) -> None:
    """Writes ``docs`` as path/shard=N/, each shard in at most ``files`` files; texts are exchanged once.

    Null texts count as empty and null ids as empty strings; repeated rows are written as often as they are there.  A column of
    ``docs`` named shard would clash with the folders' and is an error; any other name is kept.  An empty table writes no rows.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column shard; rename it")
    rows = cut(keys(docs, doc_id, text))
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    at = dict(zip(docs.columns, names, strict=True))
    t = F.coalesce(F.col(at[text]), F.lit("")).cast("binary")
    full = docs.toDF(*names).withColumn("k1", _key(t)).withColumn("k2", _key(F.coalesce(F.col(at[doc_id]).cast("string"), F.lit("")).cast("binary")))
    full = full.withColumn("shard", shard_of(splitters(rows, shards, tolerance))).withColumn("part", F.pmod(F.xxhash64("k2", F.monotonically_increasing_id()), F.lit(files)))
    full = full.repartition(shards * files, "shard", "part").select(*names, "shard").toDF(*docs.columns, "shard")
    full.write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    got = assign(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The CRC-32 is folded over the bytes of the text, with its table made by the polynomial's rule.
SQL = r"""
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8
), crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM tab WHERE k = 8
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k1,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k2 FROM documents
), s AS (
  SELECT doc_id, k1, k2, CAST(octet_length(b) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(b), '..'), lambda p: CAST('0x' || p AS BIGINT))), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS text_crc32
  FROM d, crc
), u AS (
  SELECT *, sum(size) OVER (PARTITION BY k1) AS gb, sum(size) OVER (PARTITION BY k1, k2) AS unit, sum(size) OVER (ORDER BY k1, k2 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY k1, k2) AS p, sum(size) OVER () AS total FROM s
), v AS (SELECT *, gb * 16 <= 0.02 * total AS whole, min(p) OVER (PARTITION BY k1) AS gp FROM u
), x AS (
  SELECT *, CAST((SELECT count(*) FROM range(1, 16) r(j) WHERE 2 * ((j * total + 15) // 16) < 2 * (CASE WHEN whole THEN gp ELSE p END) + CASE WHEN whole THEN gb ELSE unit END) AS INTEGER) AS shard FROM v
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k2, k1, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM x
"""
