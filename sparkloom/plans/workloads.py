"""Whole jobs built from the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import byte_length, fields, strip_marks


def word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    words = O.filter_rows(O.flat_map(lines, F.split(text, r"\s+"), "word"), F.col("word") != "")  # both within generated code
    return O.count_by_key(words, "word")


def text_statistics(lines: DataFrame, text: str = "text", long_bytes: int = 8) -> DataFrame:
    """One row: words, long words (by bytes, without marks at their ends) and distinct lower-cased words."""
    words = O.flat_map(lines, fields(text), "w").select(F.lower(strip_marks(F.col("w"))).alias("w")).where("w <> ''")
    return words.agg(F.count("*").alias("words"), F.count_if(byte_length("w") >= long_bytes).alias("long_words"), F.count_distinct("w").alias("distinct_words"))


def sales(lineitem: DataFrame) -> DataFrame:
    """Revenue, quantity and rows by return flag and line status; money is summed as decimals."""
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)")) * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return O.reduce_by_key(lineitem, "l_returnflag", "l_linestatus", revenue=F.sum(revenue).cast("double"), quantity=F.sum(F.col("l_quantity").cast("bigint")), n=F.count("*"))


def grades(orders: DataFrame) -> DataFrame:
    """Orders graded by price, counted by grade and priority."""
    price = F.col("o_totalprice")
    grade = F.when(price >= 300000, "A").when(price >= 200000, "B").when(price >= 100000, "C").otherwise("D")
    return O.count_by_key(O.key_by(orders, grade, "grade"), "grade", "o_orderpriority")


def clean_sensor(events: DataFrame, low: float, high: float) -> DataFrame:
    """By event type: values within bounds, those outside, and the mean of those within, as exact decimals."""
    good = F.col("value").between(low, high)
    exact = F.sum(F.when(good, F.col("value").cast("decimal(18,6)"))).cast("double")
    return events.groupBy("event_type").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"), (exact / F.count_if(good)).alias("mean_value"))


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    return O.count_by_key(df.select(F.floor(F.col(column) / width).cast("bigint").alias("bin")), "bin")


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) over edges (src, dst); ranks begin at 1, a node without incoming edges keeps 1 - damping.

    A round is one join and one aggregate.  Links and, every fifth round, ranks are cut at the checkpoint folder
    (spark.checkpoint.dir, where the context has none), so that the plan stays small and lost executors cost little.
    """
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    links = _cut(links.join(out, "src"))
    ranks = _cut(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("rank", F.lit(1.0)))
    nodes = ranks.select("node")
    for i in range(rounds):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        ranks = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4 and i < rounds - 1:
            ranks = _cut(ranks)
    return ranks


def _cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, where there is a checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def sort_and_reduce(spark, records: int = 40_960, payload: int = 8192) -> DataFrame:
    """One row on a sort and a skewed reduction of records with large payloads, which spill where memory is short.

    The records come in descending order and are sorted; then a quarter of them share one key and the others have their own.
    n, ordered: records after the sort, and whether they rise over all partitions with whole payloads; keys, total, hot:
    keys after the reduction, their counts' sum and the largest one.
    """
    text = "x" * payload

    def look(batches):
        n, low, high, rises = 0, None, None, True
        for b in batches:
            if len(b):
                rises = rises and b["k"].is_monotonic_increasing and (high is None or b["k"].iloc[0] > high) and bool((b["payload"] == text).all())
                low, high, n = b["k"].iloc[0] if low is None else low, b["k"].iloc[-1], n + len(b)
        if n:
            yield pd.DataFrame([(n, low, high, rises)], columns=["n", "low", "high", "rises"])

    body = F.repeat(F.lit("x"), F.lit(payload)).alias("payload")
    rows = spark.range(records).select((F.lit(records - 1) - F.col("id")).alias("k"), body)
    parts = O.map_partitions(O.sort_by_key(rows, "k"), look, "n long, low long, high long, rises boolean")
    parts = parts.withColumn("before", F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    done = parts.agg(F.sum("n").alias("n"), F.bool_and(F.col("rises") & (F.coalesce("before", F.lit(-1)) < F.col("low"))).alias("ordered"))
    skewed = spark.range(records).select(F.when(F.col("id") >= records * 3 // 4, -1).otherwise(F.col("id")).alias("k"), body)
    reduced = O.reduce_by_key(skewed, "k", n=F.count("*"), payload=F.max("payload")).where(F.length("payload") == payload)
    return done.crossJoin(reduced.agg(F.count("*").alias("keys"), F.sum("n").alias("total"), F.max("n").alias("hot")))  # a row each


def monte_carlo_pi(spark, points: int, seed: int = 1) -> DataFrame:
    """One row: an estimate of pi from pseudo-random points."""
    xy = spark.range(points).select(F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))
    return xy.agg((4 * F.avg((F.col("x") ** 2 + F.col("y") ** 2 <= 1).cast("double"))).alias("pi"))
