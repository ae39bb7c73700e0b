"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks.  With integer weights W of sum P, the j-th block of a source (from 0) is
released at floor(j P / W) and due at ceil((j + 1) P / W); earliest deadline first, one block a slot, then
meets all deadlines, and after any number of slots each source has its share to within less than one block.
The schedule repeats every P slots, so its one period is planned on the driver (P is a parameter's
size, whatever the data, and checked) and every block finds its slot by arithmetic.

No row is dropped or repeated: where a source has run out, its slots are closed up and the others keep
their proportions.  Rows are numbered by prefix sums over bounded buckets, never in one task for a source.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, table
from .sharding import BITS, _key

PERIOD = 1000
ROWS_A_TASK = 8192


def temper(counts: dict[str, int], alpha: float = 0.5, period: int = PERIOD) -> dict[str, int]:
    """Integer weights in proportion to count ** alpha, of a sum near ``period``; each is 1 at least."""
    share = {s: n**alpha for s, n in counts.items()}
    total = math.fsum(share.values())
    return {s: max(1, math.floor(period * x / total + 0.5)) for s, x in share.items()}


def schedule(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of each block of one period, earliest deadline first; ties go by source."""
    period = sum(weights.values())
    jobs = sorted((j * period // w, -(-(j + 1) * period // w), s, j) for s, w in weights.items() for j in range(w))
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, s, j = jobs[at]
            heapq.heappush(ready, (deadline, s, j, release))
            at += 1
        deadline, s, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        out.append((s, j, release, deadline, slot))
    return out


def mix(docs: DataFrame, *, weights: dict[str, int] | None = None, source: str = "source", doc_id: str = "doc_id", block_rows: int = 16, max_period: int = 100_000) -> DataFrame:
    """The rows of ``docs`` in mixed order, with mix_block, mix_release, mix_deadline and mix_slot.

    mix_block: number of the row's block in its source; release and deadline: in slots of the schedule; mix_slot: the row's
    place in the mixture, from 0 without gaps.  Rows lie in that order in the result's partitions.  Null sources are one
    source with the empty name.  ``weights`` must be positive integers and name every source; without them weights follow
    the square roots of the sources' counts.  They are divided by their common divisor; their sum, the slots of the schedule
    that goes to all tasks, is at most ``max_period``, so there are no more sources either.  Within a source rows go by the MD5
    of their id (null: empty), then by a hash of the row and its place in the input.  An empty table gives no rows.  Columns of ``docs`` named as those added are replaced.
    """
    added = ["mix_block", "mix_release", "mix_deadline", "mix_slot"]
    docs = docs.drop(*added)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    counts = {r["s"]: r["n"] for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).limit(max_period + 1).collect()}
    weights = weights or temper(counts)
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no weight for {missing[:5]}")
    weights = {s: weights[s] for s in sorted(counts)}
    if any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights must be positive integers")
    common = math.gcd(*weights.values()) or 1
    weights = {s: w // common for s, w in weights.items()}
    period = sum(weights.values())
    if period > max_period:
        raise ValueError(f"the weights' schedule has {period} slots, over max_period: take smaller weights or mix groups of sources")
    plan = [{"s": s, "w": weights[s], "j": j, "release": a, "deadline": b, "at": t} for s, j, a, b, t in schedule(weights)]
    plan_schema = "array<struct<s: string, w: int, j: int, release: long, deadline: long, at: long>>"
    slots = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), plan_schema)))
    width = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"s": s, "w": w} for s, w in weights.items()])), "array<struct<s: string, w: int>>")))

    own = F.struct(*docs.columns)
    rows = docs.select(own.alias("row"), name.alias("s"), F.col(doc_id).alias("id"), _key(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("k"))
    # Ties of the id's key go by a hash of the whole row and then of its place in the input, so that the order is total.
    hashable = [f"row.{f.name}" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("tie", F.xxhash64(*hashable, F.monotonically_increasing_id()))
    rows = numbered(rows, "s", "k", ["tie"], BITS, ROWS_A_TASK)
    block, inner = F.expr(f"i div {block_rows}"), F.col("i") % block_rows
    rows = rows.withColumn("block", block).withColumn("inner", inner).join(F.broadcast(width), "s")  # as many rows as sources
    rows = rows.withColumn("cycle", F.expr("block div w")).withColumn("j", (F.col("block") % F.col("w")).cast("int"))
    rows = rows.join(F.broadcast(slots.drop("w")), ["s", "j"])  # as many rows as the period

    # Of a source, min(count, rows of its blocks in a period * c) rows stand before cycle c; summed once a cycle.
    sizes = F.from_json(F.lit(json.dumps([{"n": counts[s], "a": weights[s] * block_rows} for s in weights])), "array<struct<n: long, a: long>>")
    rows = rows.repartitionByRange("cycle").withColumn("r", F.row_number().over(Window.partitionBy("cycle").orderBy("at", "inner")) - 1)
    first = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["n"], F.col("cycle") * x["a"]))
    rows = rows.withColumn("first", F.max(F.when(F.col("r") == 0, first)).over(Window.partitionBy("cycle")))
    got = rows.select(
        "row", "cycle", "at", "inner", F.col("block").alias("mix_block"), (F.col("cycle") * period + F.col("release")).alias("mix_release"),
        (F.col("cycle") * period + F.col("deadline")).alias("mix_deadline"), (F.col("first") + F.col("r")).alias("mix_slot"),
    )
    return got.sortWithinPartitions("cycle", "at", "inner").select("row.*", *added)


def ordered(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in mixed order with just the columns they have, whatever those are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    return mix(docs.toDF(*names), source=at[source], doc_id=at[doc_id], **options).select(names).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return got.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_release").alias("release"), F.col("mix_deadline").alias("deadline"), F.col("mix_slot").alias("slot"))


SQL = r"""
WITH RECURSIVE c AS (
  SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1
), q AS (
  SELECT s, n, CAST(greatest(1, floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) + 0.5)) AS BIGINT) AS w, row_number() OVER (ORDER BY s) AS i FROM c
), a AS (SELECT list(w ORDER BY i) AS w, CAST(sum(w) AS BIGINT) AS p FROM q
), edf(t, pick, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)) FROM a
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda x, k: x + CASE WHEN k = pick THEN 1 ELSE 0 END)
  FROM (
    SELECT t, done, list_min(list_transform(w, lambda x, k: CASE WHEN done[k] < x AND done[k] * p // x <= t + 1 THEN ((done[k] + 1) * p + x - 1) // x * 100000 + k ELSE 1000000000000 END)) % 100000 AS pick
    FROM edf, a WHERE t + 1 < p
  )
), slots AS (
  SELECT q.s, q.w, e.done[e.pick] - 1 AS j, e.t AS at_slot FROM edf e JOIN q ON q.i = e.pick WHERE e.t >= 0
), d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id) - 1 AS i FROM documents
), x AS (
  SELECT d.*, d.i // 16 AS block, d.i % 16 AS inside, q.w, (d.i // 16) // q.w AS cycle, (d.i // 16) % q.w AS j FROM d JOIN q USING (s)
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(cycle * p + x.j * p // x.w AS BIGINT) AS release, CAST(cycle * p + ((x.j + 1) * p + x.w - 1) // x.w AS BIGINT) AS deadline,
       CAST(row_number() OVER (ORDER BY cycle, at_slot, inside) - 1 AS BIGINT) AS slot
FROM x JOIN slots ON slots.s = x.s AND slots.j = x.j CROSS JOIN a
"""
