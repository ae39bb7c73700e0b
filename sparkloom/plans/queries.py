"""A query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ml
from .. import operators as O
from .. import sources as S
from ..functions import byte_length, fields
from . import pipelines, workloads
from .kept import Kept
from .shared import Broadcasts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


t = S.table


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares one; else where the context's checkpoints are, or a temporary one (one machine)."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (at.get() if at.isDefined() else tempfile.mkdtemp(prefix="sparkloom-"))
    return f"{root.rstrip('/')}/out-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row as its partitions hold it, from 0: written once, with each row's partition and place in it."""
    kept = S.write_checkpoint(df.withColumn("id", F.monotonically_increasing_id()), _folder(df.sparkSession))
    kept = kept.withColumn("__part", F.shiftright("id", 33))
    before = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    if not before:
        return kept.withColumn(name, F.col("id")).drop("id", "__part")
    parts = sorted(before)
    starts = F.create_map(*(F.lit(x) for k, p in enumerate(parts) for x in (p, sum(before[q] for q in parts[:k]))))
    return kept.withColumn(name, F.col("id") - F.shiftleft("__part", 33) + starts[F.col("__part")]).drop("id", "__part")


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def wordcount(spark, d):
    return workloads.word_count(t(spark, d, "documents"))


@query("SELECT l_orderkey, l_quantity * 2 AS double_quantity FROM lineitem")
def map_project(spark, d):
    return O.map_rows(t(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), double_quantity=F.col("l_quantity") * 2)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def filter_pred(spark, d):
    return O.filter_rows(t(spark, d, "orders"), F.col("o_totalprice") > 1000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part_word FROM part")
def flat_map(spark, d):
    return O.flat_map(t(spark, d, "part"), F.split("p_name", " "), "part_word", "p_partkey")


@query("SELECT o_orderkey, o_custkey * 3 AS tripled FROM orders")
def map_partitions(spark, d):
    return O.map_partitions(t(spark, d, "orders").select("o_orderkey", "o_custkey"), lambda it: (b.assign(tripled=b.o_custkey * 3)[["o_orderkey", "tripled"]] for b in it), "o_orderkey long, tripled long")


@query("SELECT o_custkey, CAST(o_custkey % 5 AS INTEGER) AS part FROM orders")
def map_partitions_with_index(spark, d):
    dealt = O.partition_by(t(spark, d, "orders").select("o_custkey"), 5, "o_custkey")
    return O.map_partitions_with_index(dealt, lambda i, it: (b.assign(part=i) for b in it), "o_custkey long, part int")


@query("SELECT o_custkey, o_totalprice + 1 AS price FROM orders")
def map_values(spark, d):
    return O.map_values(t(spark, d, "orders"), "o_custkey", price=F.col("o_totalprice") + 1)


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part")
def flat_map_values(spark, d):
    return O.flat_map_values(t(spark, d, "part"), "p_partkey", F.split("p_type", " "))


@query("SELECT o_custkey FROM orders")
def keys(spark, d):
    return O.keys(t(spark, d, "orders"), "o_custkey")


@query("SELECT o_totalprice, o_orderstatus FROM orders")
def values(spark, d):
    return O.values(t(spark, d, "orders"), "o_totalprice", "o_orderstatus")


@query("SELECT c_custkey, c_custkey % 10 AS key FROM customer")
def key_by(spark, d):
    return O.key_by(t(spark, d, "customer").select("c_custkey"), F.col("c_custkey") % 10)


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct(spark, d):
    return O.distinct(t(spark, d, "orders").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def union_bag(spark, d):
    o = t(spark, d, "orders")
    return O.union(o.where("o_totalprice > 1000").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersection(spark, d):
    return O.intersection(t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT DISTINCT FROM o_custkey)")
def subtract_dups(spark, d):
    return O.subtract(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def reduce_by_key(spark, d):
    return O.reduce_by_key(t(spark, d, "orders"), "o_custkey", total=F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), largest=F.max("o_totalprice"))


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1")
def group_by_key(spark, d):
    return O.group_by_key(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", name="lines", max_group=100_000)


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY 1")
def combine_by_key(spark, d):
    pair = lambda c: F.struct(c["s"].alias("s"), c["n"].alias("n"))
    return O.combine_by_key(
        t(spark, d, "orders"), "o_custkey", lambda v: F.struct(v.cast("decimal(18,2)").alias("s"), F.lit(1).alias("n")),
        lambda c: pair({"s": F.sum(c["s"]), "n": F.sum(c["n"])}), value="o_totalprice", name="mean", finish=lambda c: c["s"].cast("double") / c["n"],
    )


@query("SELECT l_returnflag, CAST(sum(10 + l_linenumber) AS BIGINT) AS aggregate FROM lineitem GROUP BY 1")
def aggregate_by_key(spark, d):
    return O.aggregate_by_key(t(spark, d, "lineitem"), "l_returnflag", F.lit(10), lambda z, v: z + v, F.sum, value="l_linenumber")


@query("SELECT l_linestatus, CAST(sum(10 + l_linenumber) AS BIGINT) AS folded FROM lineitem GROUP BY 1")
def fold_by_key(spark, d):
    return O.fold_by_key(t(spark, d, "lineitem"), "l_linestatus", F.lit(10), lambda z, v: z + v, F.sum, value="l_linenumber")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(spark, d):
    return O.count_by_key(t(spark, d, "events"), "event_type")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def count_by_value(spark, d):
    return O.count_by_value(t(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem")
def reduce(spark, d):
    return O.reduce(t(spark, d, "lineitem"), F.sum("l_linenumber"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem")
def fold(spark, d):
    return O.fold(t(spark, d, "lineitem"), F.lit(0), F.sum("l_linenumber"), lambda z, v: z + v)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem")
def tree_aggregate(spark, d):
    return O.tree_aggregate(t(spark, d, "lineitem"), total=F.sum("l_linenumber"), n=F.count("*"))


@query("SELECT max(o_totalprice) AS value FROM orders")
def tree_reduce(spark, d):
    return O.reduce(t(spark, d, "orders"), F.max("o_totalprice"))


@query("SELECT count(*) AS n FROM lineitem")
def count(spark, d):
    return _one(spark, "n long", O.count(t(spark, d, "lineitem")))


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def min_max(spark, d):
    o = t(spark, d, "orders")
    return _one(spark, "low double, high double", O.min_of(o, "o_totalprice")["o_totalprice"], O.max_of(o, "o_totalprice")["o_totalprice"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 AS none, (SELECT count(*) FROM orders) = 0 AS some")
def is_empty(spark, d):
    o = t(spark, d, "orders")
    return _one(spark, "none boolean, some boolean", O.is_empty(O.filter_rows(o, F.col("o_totalprice") < 0)), O.is_empty(o))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def first(spark, d):
    got = O.first(O.sort_by_key(t(spark, d, "orders"), "o_totalprice", "o_orderkey", ascending=False))
    return _one(spark, "o_orderkey long, o_totalprice double", got["o_orderkey"], got["o_totalprice"])


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem")
def for_each(spark, d):
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    lines = t(spark, d, "lineitem").select("l_linenumber")
    O.for_each(lines, lambda r: total.add(r[0]))
    O.for_each_partition(lines, lambda rows: n.add(sum(1 for _ in rows)))
    return _one(spark, "total long, n long", total.value, n.value)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return O.join(t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), t(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_orderkey IS NOT NULL AS has_right FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark, d):
    return O.left_join(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_left FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def join_right(spark, d):
    return O.right_join(t(spark, d, "labels").select("doc_id", "quality"), t(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT coalesce(p.page_id, l.doc_id) AS id, p.page_id IS NOT NULL AS has_left, l.doc_id IS NOT NULL AS has_right FROM pages p FULL JOIN labels l ON p.page_id = l.doc_id")
def join_full(spark, d):
    return O.full_join(t(spark, d, "pages").select(F.col("page_id").alias("id")), t(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def subtract_by_key(spark, d):
    return O.subtract_by_key(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, []) AS left_values, coalesce(b.v, []) AS right_values FROM (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1) a
FULL JOIN (SELECT c_custkey AS k, list(c_nationkey ORDER BY c_nationkey) AS v FROM customer GROUP BY 1) b ON a.k = b.k""")
def cogroup(spark, d):
    return O.cogroup(t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k", "o_orderkey", "c_nationkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cartesian(spark, d):
    return O.cartesian(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def broadcast_lookup(spark, d):
    return O.broadcast_lookup(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id", "quality"), "doc_id", {"quality": F.lit(-1)})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def lookup(spark, d):
    return O.lookup(t(spark, d, "orders"), "o_custkey", 7, "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def sort_by_key(spark, d):
    return _in_order(O.sort_by_key(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS pos FROM orders")
def sort_by_key_descending(spark, d):
    return _in_order(O.sort_by_key(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", ascending=False, partitions=5))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def take_first(spark, d):
    return O.take(t(spark, d, "orders").select("o_orderkey"), 10, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) - 1 AS index FROM orders")
def zip_with_index(spark, d):
    return O.zip_with_index(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "o_orderkey")


@query("""SELECT c_custkey, c_name, c_acctbal, s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer)
JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)""")
def zip_frames(spark, d):
    return O.zip_frames(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), t(spark, d, "supplier").select("s_suppkey", "s_name"), ["c_acctbal", "c_custkey"], ["s_suppkey"])


@query("SELECT CAST(o_custkey AS BIGINT) AS v, CAST(3 * o_custkey AS BIGINT) AS w FROM orders")
def zip_partitions(spark, d):
    dealt = O.partition_by(t(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("v")), 5, "v")
    twice = dealt.select((F.col("v") * 2).alias("v"))
    return O.zip_partitions([dealt, twice], lambda fs: fs[0].assign(w=fs[0]["v"] + fs[1]["v"]), "v long, w long", order=["v"])


@query("SELECT k AS part, count(o_custkey) AS n, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS total FROM range(0, 5) r(k) LEFT JOIN orders ON o_custkey % 5 = k AND o_custkey % 5 <> 3 GROUP BY k")
def glom(spark, d):
    dealt = O.partition_by(t(spark, d, "orders").where(F.col("o_custkey") % 5 != 3).select("o_custkey"), 5, "o_custkey")
    g = _in_order(O.glom(dealt, "o_custkey"), "part")
    return g.select("part", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) AS part FROM orders")
def partition_by(spark, d):
    return O.partition_by(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 5, "o_custkey").select("o_orderkey", F.spark_partition_id().alias("part"))


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, count(DISTINCT o_custkey) AS places FROM orders")
def repartition(spark, d):
    """places: pairs of a key and a partition that holds it; by hash a key has one."""
    placed = O.repartition(t(spark, d, "orders").select("o_custkey"), 7, "o_custkey").withColumn("part", F.spark_partition_id())
    return placed.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"), F.count_distinct("o_custkey", "part").alias("places"))


@query("SELECT CAST(4 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS overlaps, (SELECT count(*) FROM orders) AS n")
def range_partition(spark, d):
    """overlaps: partitions whose least key isn't over the largest one before them."""
    placed = O.repartition_by_range(t(spark, d, "orders").select("o_orderkey"), 4, "o_orderkey").withColumn("part", F.spark_partition_id())
    each = placed.groupBy("part").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))
    each = each.withColumn("before", F.max("high").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    return each.agg(F.count("*").alias("parts"), F.count_if(F.col("low") <= F.col("before")).alias("overlaps"), F.sum("n").alias("n"))


@query("SELECT CAST(2 AS BIGINT) AS parts, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def coalesce(spark, d):
    placed = O.coalesce(O.repartition(t(spark, d, "orders").select("o_custkey"), 7), 2).withColumn("part", F.spark_partition_id())
    return placed.agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, CAST(0 AS BIGINT) AS in_zero_weight FROM orders")
def random_split_complete(spark, d):
    parts = O.random_split(t(spark, d, "orders").select("o_orderkey"), [1, 2, 0, 3], 42)
    tagged = O.union(*(p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    return tagged.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count_if(F.col("part") == 2).alias("in_zero_weight"))


@query("SELECT true AS near")
def sample_bounds(spark, d):
    o = t(spark, d, "lineitem").select("l_orderkey")
    n = O.sample(o, 0.5, seed=3).agg(F.count("*").alias("n"))
    return n.crossJoin(o.agg(F.count("*").alias("all"))).select(F.col("n").between(0.4 * F.col("all"), 0.6 * F.col("all")).alias("near"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def pipe_cat(spark, d):
    return O.count_by_key(O.pipe(t(spark, d, "part"), "cat", "p_name"), "value")


@query("SELECT concat('{', o_orderkey, ' ', o_orderstatus, '}') AS value FROM orders")
def text_roundtrip(spark, d):
    path = _folder(spark)
    S.save_text(t(spark, d, "orders"), path, "o_orderkey", "o_orderstatus")
    return S.text_file(spark, path)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def checkpoint_roundtrip(spark, d):
    return S.write_checkpoint(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), _folder(spark))


@query("SELECT concat('{', n_name, ' ', n_regionkey, '}') AS value FROM nation")
def manifest_commit(spark, d):
    path = _folder(spark)
    S.commit(t(spark, d, "nation").select(S.text.line("n_name", "n_regionkey").alias("value")), path)
    return S.read_committed(spark, path, check=True)


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) FROM lineitem) AS share FROM lineitem GROUP BY 1")
def pipeline_normalize(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return rows.groupBy("l_returnflag").agg(F.sum("q").cast("double").alias("s")).select("l_returnflag", (F.col("s") / pipelines.reduction(rows, F.sum("q").cast("double"))).alias("share"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def metrics_observe(spark, d):
    df, seen = O.observed(t(spark, d, "lineitem"), n=F.count("*"), total=F.sum("l_linenumber"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["total"])], "n long, total long")


@query("SELECT i * 3 AS id FROM range(0, 334) x(i)")
def make_range(spark, d):
    return S.make_range(spark, 0, 1000, 3)


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents".replace("\\\\", "\\"))
def text_functions(spark, d):
    return t(spark, d, "documents").select("doc_id", byte_length("text").alias("bytes"), F.size(fields("text")).cast("long").alias("words"))


@query("SELECT CAST(1000000 AS BIGINT) AS intercept, CAST(2000000 AS BIGINT) AS w0, CAST(-3000000 AS BIGINT) AS w1")
def linear_regression(spark, d):
    x, z = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    m = ml.train_linear(t(spark, d, "part").select((1 + 2 * x - 3 * z).alias("label"), F.array(x, z).alias("features")))
    return _one(spark, "intercept long, w0 long, w1 long", *(round(x * 1e6) for x in (m.intercept, *m.weights)))  # in millionths


@query("SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS INTEGER) AS class FROM part")
def logistic_classes(spark, d):
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).cast("double").alias("label"), F.array(F.col("p_size").cast("double")).alias("features"))
    m = ml.train_logistic(rows, l2=1e-4)
    return rows.select("p_partkey", (m.column() >= 0).cast("int").alias("class"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sales(spark, d):
    return workloads.sales(t(spark, d, "lineitem"))


@query("SELECT CASE WHEN o_totalprice >= 300000 THEN 'A' WHEN o_totalprice >= 200000 THEN 'B' WHEN o_totalprice >= 100000 THEN 'C' ELSE 'D' END AS grade, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def grades(spark, d):
    return workloads.grades(t(spark, d, "orders"))


@query("""SELECT event_type, count(*) FILTER (value BETWEEN 10 AND 90) AS kept, count(*) FILTER (NOT value BETWEEN 10 AND 90) AS dropped,
CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (value BETWEEN 10 AND 90) AS DOUBLE) / count(*) FILTER (value BETWEEN 10 AND 90) AS mean_value FROM events GROUP BY 1""")
def sensor(spark, d):
    return workloads.clean_sensor(t(spark, d, "events"), 10, 90)


@query("SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, d):
    return workloads.histogram(t(spark, d, "orders"), "o_totalprice", 50000)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE FROM n UNION ALL
  SELECT i, node, 0.15 + 0.85 * coalesce(sum(got), 0) FROM (SELECT r2.i + 1 AS i, n.node AS node, NULL::DOUBLE AS got FROM (SELECT DISTINCT i FROM r WHERE i < 10) r2, n UNION ALL SELECT r.i + 1, e.dst, r.rank / o.n FROM r JOIN e ON r.node = e.src JOIN o ON o.src = e.src WHERE r.i < 10) GROUP BY i, node)
SELECT node, CAST(round(rank * 1000000) AS BIGINT) AS millionths FROM r WHERE i = 10""")
def pagerank(spark, d):
    o, c, li, s = (t(spark, d, x) for x in ("orders", "customer", "lineitem", "supplier"))
    source = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("src"))
    target = li.select("l_orderkey", "l_suppkey").join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    ranks = workloads.page_rank(source.join(target, source.o_orderkey == target.l_orderkey).select("src", "dst"))
    return ranks.select("node", F.round(F.col("rank") * 1000000).cast("bigint").alias("millionths"))


@query("SELECT true AS near")
def pi(spark, d):
    return workloads.monte_carlo_pi(spark, 200_000).select(F.col("pi").between(3.1, 3.18).alias("near"))


@query("SELECT CAST(40960 AS BIGINT) AS n, true AS ordered, CAST(30721 AS BIGINT) AS keys, CAST(40960 AS BIGINT) AS total, CAST(10240 AS BIGINT) AS hot")
def sort_and_reduce(spark, d):
    """320 MiB that the query makes itself."""
    return workloads.sort_and_reduce(spark)


@query("SELECT CAST(i AS BIGINT) AS v, CAST(i * i AS BIGINT) AS square FROM range(1, 501) r(i)")
def parallelize(spark, d):
    return O.map_rows(S.from_rows(spark, [(i,) for i in range(1, 501)], "v long", 4), v=F.col("v"), square=F.col("v") * F.col("v"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def empty(spark, d):
    return O.union(S.empty(spark, "o_orderkey long, o_orderstatus string"), t(spark, d, "orders").select("o_orderkey", "o_orderstatus").limit(0))


@query("SELECT CAST(p AS INTEGER) AS part, CAST(p * 100 + i AS BIGINT) AS v FROM range(0, 5) a(p), range(0, 20) b(i) WHERE i < 4 * p")
def function_source(spark, d):
    return S.function_source(spark, "sparkloom-steps", "part int, v long", 5, lambda p: ((p, 100 * p + i) for i in range(4 * p)))


@query("SELECT concat('{', o_orderkey, ' ', o_custkey % 4, '}') AS value FROM orders WHERE o_custkey % 4 <> 2")
def save_partitions(spark, d):
    """Each partition but one is saved by itself."""
    dealt = O.partition_by(t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("part")), 4, "part")
    lines, path = dealt.select(S.text.line("o_orderkey", "part").alias("value")), _folder(spark)
    for part in (0, 1, 3):
        S.save_partition(lines, part, f"{path}/{part}")
    return S.text_file(spark, path)


@query("SELECT CAST(5 AS BIGINT) AS numbers, CAST(30 AS BIGINT) AS total, CAST(0 AS BIGINT) AS none, true AS same, false AS other")
def run_jobs(spark, d):
    """Registered pipelines with registered actions, and plans that are verified before they run."""
    from . import bundled

    J = pipelines.JobSpec
    if "total-of-ids" not in pipelines.actions():
        pipelines.register_reduction("total-of-ids", F.sum("id"), zero=0)
    spec = J(bundled.NUMBERS, "total-of-ids")
    planned = pipelines.plan_job(spark, spec)
    pipelines.verify_plan(spark, planned, spec)
    again, other = (pipelines.plan_job(spark, s).fingerprint == planned.fingerprint for s in (spec, J(bundled.NUMBERS, "total-of-ids", partitions=3)))
    got = pipelines.run_job(spark, J(bundled.NUMBERS, "count")), pipelines.run_job(spark, spec), pipelines.run_job(spark, J(bundled.NUMBERS, "total-of-ids", {"above": "99"}))
    return _one(spark, "numbers long, total long, none long, same boolean, other boolean", *got, again, other)


@query("SELECT concat('{', w, ' ', count(*), '}') AS value FROM (SELECT unnest(['hello', 'world', 'hello', 'spark', 'world', 'spark', 'hello']) AS w) GROUP BY w")
def run_and_save(spark, d):
    from . import bundled  # noqa: F401  registers its pipelines

    path = _folder(spark)
    pipelines.run(spark, "wordcount-lines", "save", path=path)
    return S.read_committed(spark, path, check=True)


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS number FROM part")
def broadcast_values(spark, d):
    shared = Broadcasts(spark)
    shared.add("brands", {"Brand#11": 1, "Brand#12": 2})
    brands = shared.values["brands"]
    rows = t(spark, d, "part").select("p_partkey", "p_brand")
    return O.map_partitions(rows, lambda it: (b.assign(number=b["p_brand"].map(brands.value).fillna(0).astype("int32"))[["p_partkey", "number"]] for b in it), "p_partkey long, number int")


@query("SELECT count(*) AS n, count(*) AS again, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def keep_frames(spark, d):
    kept = Kept()
    for level in ("disk", "memory"):
        o = kept.persist("orders", t(spark, d, "orders").select("o_custkey"), level)
        n, again = o.count(), kept.persist("orders", t(spark, d, "orders").select("o_custkey"), level).count()
    total = o.agg(F.sum("o_custkey")).first()[0]
    kept.stop()
    return _one(spark, "n long, again long, total long", n, again, total)


@query("SELECT CAST(p_size AS DOUBLE) AS label, [CAST(p_partkey AS DOUBLE), CAST(p_partkey % 7 AS DOUBLE)] AS features FROM part")
def parse_labeled(spark, d):
    lines = t(spark, d, "part").select(F.concat_ws(" ", "p_size", "p_partkey", F.col("p_partkey") % 7).alias("value"))
    return ml.parse_labeled(O.union(lines, S.from_rows(spark, [("",), ("  ",)], "value string")))


@query("SELECT p_partkey, CAST(round((1 + 2 * p_size - 3 * (p_partkey % 7)) * 1000) AS BIGINT) AS thousandths FROM part")
def predict(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")).alias("features"))
    m = ml.train_linear(rows.select((1 + 2 * F.col("features")[0] - 3 * F.col("features")[1]).alias("label"), "features"))
    assert abs(m.predict([4.0, 1.0]) - 6) < 1e-5
    return rows.select("p_partkey", F.round(m.column() * 1000).cast("bigint").alias("thousandths"))


@query("SELECT true AS low, true AS high, CAST(0 AS BIGINT) AS class_low, CAST(1 AS BIGINT) AS class_high")
def predict_probability(spark, d):
    rows = t(spark, d, "part").select((F.col("p_size") > 25).cast("double").alias("label"), F.array(F.col("p_size").cast("double")).alias("features"))
    m = ml.train_logistic(rows, l2=1e-4)
    return _one(spark, "low boolean, high boolean, class_low long, class_high long", 0 <= m.probability([1.0]) < 0.5, 0.5 < m.probability([50.0]) <= 1, int(m.predict([1.0])), int(m.predict([50.0])))
