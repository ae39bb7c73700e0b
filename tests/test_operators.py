import pytest
from pyspark.sql import functions as F

from sparkloom import operators as O


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sets(spark):
    a, b = frame(spark, [(1,), (1,), (2,), (3,), (3,), (None,)], "v long"), frame(spark, [(1,), (3,), (7,), (None,)], "v long")
    assert got(O.subtract(a, b)) == [(2,)]
    assert got(O.subtract(a, frame(spark, [(2,)], "v long"))) == [(1,), (1,), (3,), (3,), (None,)]
    assert got(O.intersection(a, b)) == [(1,), (3,), (None,)]
    assert O.union(a, b).count() == 10
    with pytest.raises(ValueError):
        O.union()


def test_outer_joins_tell_absent_from_null(spark):
    a = frame(spark, [(1, "a"), (2, "left"), (1, "b"), (2, "left"), (4, "")], "k long, l string")
    b = frame(spark, [(1, 10), (3, 30), (1, 11), (3, 31), (4, 0)], "k long, r long")
    full = got(O.full_join(a, b, "k"))
    assert len(full) == 9 and (4, "", True, 0, True) in [(r["k"], r["l"], r["has_left"], r["r"], r["has_right"]) for r in O.full_join(a, b, "k").collect()]
    assert got(O.subtract_by_key(a, b, "k")) == [(2, "left"), (2, "left")]
    assert O.left_join(a, b, "k").where("not has_right").count() == 2
    assert O.right_join(a, b, "k").where("not has_left").count() == 2
    assert O.join(a, b, "k").count() == 5


def test_keyed(spark):
    p = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    assert got(O.fold_by_key(p, "k", F.lit(10), lambda z, v: z + v, F.sum, value="v")) == [("a", 23), ("b", 13)]
    assert got(O.group_by_key(p, "k", "v")) == [("a", [1, 2]), ("b", [3])]
    with pytest.raises(Exception, match="over the limit"):
        O.group_by_key(p, "k", "v", max_group=1).collect()
    from sparkloom.operators.keyed import reduce_values

    assert got(reduce_values(p, "k", "v", lambda x, y: x * 10 + y, "long")) in ([("a", 12), ("b", 3)], [("a", 21), ("b", 3)])


def test_cogroup_and_lookup(spark):
    a, b = frame(spark, [(1, 2), (1, 3)], "k long, v long"), frame(spark, [(1, 4), (2, 5)], "k long, w long")
    assert got(O.cogroup(a, b, "k", "v", "w")) == [(1, [2, 3], [4]), (2, [], [5])]
    assert got(O.lookup(a, "k", 9, "v")) == []
    assert O.cogroup(a, b, "k", "v", "w", max_group=2).count() == 2
    with pytest.raises(Exception, match="over the limit"):
        O.cogroup(a, b, "k", "v", "w", max_group=1).collect()
    hot = spark.range(2000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    assert O.group_by_key(hot, "k", "v", max_group=2000).select(F.size("values")).first()[0] == 2000
    with pytest.raises(Exception, match="over the limit"):
        O.group_by_key(hot, "k", "v", max_group=1999).collect()


def test_extremes(spark):
    v = frame(spark, [(5,), (3,), (8,), (None,), (1,), (9,), (2,)], "v long")
    assert (O.min_of(v, "v")["v"], O.max_of(v, "v")["v"], O.count(v), O.first(v, "v")["v"]) == (1, 9, 7, None)
    assert [r.v for r in O.take(v.where("v > 2"), 2, "v").collect()] == [3, 5] and O.take(v, 0).count() == 0
    with pytest.raises(ValueError):
        O.take(v, -1)


def test_empty_inputs(spark):
    none = frame(spark, [], "v long")
    assert O.reduce(none, F.sum("v")).collect() == []
    assert O.fold(none, F.lit(0), F.sum("v"), lambda z, v: z + v).collect()[0][0] == 0
    assert O.is_empty(none) and O.first(none) is None and O.min_of(none, "v") is None
    assert O.zip_with_index(none, "v").collect() == []
    assert O.count(none) == 0


def test_positions(spark):
    v = frame(spark, [(c,) for c in "edcba"], "v string").repartition(3)
    assert got(O.zip_with_index(v, "v")) == [(c, i) for i, c in enumerate("abcde")]
    with pytest.raises(ValueError):
        O.zip_frames(v, v.limit(2).withColumnRenamed("v", "w"), ["v"], ["w"], strict=True)
    with pytest.raises(ValueError):
        O.zip_partitions([v, v.repartition(2)], lambda fs: fs[0], "v string")


def test_positions_of_many_rows_with_a_payload(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n, numPartitions=6).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.col("id"), F.concat(F.lit("payload "), "id").alias("payload"), F.lit(None).cast("map<string,int>").alias("m"))
    O.zip_with_index(rows, "k", partitions=9).write.parquet(str(tmp_path / "one"))
    got = spark.read.parquet(str(tmp_path / "one"))
    s = got.agg(F.count("*"), F.count_distinct("index"), F.min("index"), F.max("index")).first()
    assert tuple(s) == (n, n, 0, n - 1)
    from pyspark.sql import Window

    wrong = got.withColumn("before", F.lag("k").over(Window.orderBy("index"))).where("before >= k or payload <> concat('payload ', id)")
    assert wrong.count() == 0
    a, b = rows.where("id < 300000"), rows.where("id < 250000").select(F.col("k").alias("k2"), F.col("payload").alias("payload2"))
    O.zip_frames(a.withColumn("k", F.col("id")), b.withColumn("k2", F.substring("payload2", 9, 9).cast("long")), ["k"], ["k2"]).write.parquet(str(tmp_path / "two"))
    both = spark.read.parquet(str(tmp_path / "two"))
    assert both.count() == 250_000 and both.where("payload <> payload2").count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_positions_with_ties_and_nulls(spark, partitions):
    rows = [(i % 3 if i % 4 else None, float("nan") if i % 5 == 0 else i / 7, f"x{i % 11}") for i in range(200)]
    v = frame(spark, rows, "k long, d double, s string").repartition(5)
    got = O.zip_with_index(v, "k", "d", partitions=partitions).collect()
    assert sorted(r["index"] for r in got) == list(range(200))
    place = lambda r: ((r.k is not None, r.k or 0), (r.d != r.d, 0 if r.d != r.d else r.d))
    in_order = [place(r) for r in sorted(got, key=lambda r: r["index"])]
    assert in_order == sorted(in_order)
    same = frame(spark, [(1,)] * 50, "k long").repartition(4)
    assert sorted(r["index"] for r in O.zip_with_index(same, "k", partitions=partitions).collect()) == list(range(50))


def test_partitions_side_by_side(spark):
    def dealt(rows):
        return O.partition_by(frame(spark, rows, "v long, p int"), 3, "p")

    a, b, c = (dealt([(k * (i + 1), i // 2) for i in range(4)]) for k in (1, 10, 100))
    got = O.zip_partitions([a, b, c], lambda fs: fs[0].assign(v=fs[0]["v"] + fs[1]["v"] + fs[2]["v"])[["v"]], "v long")
    assert sorted(r[0] for r in got.collect()) == [111, 222, 333, 444]


def test_partitions_side_by_side_in_a_named_order(spark):
    def dealt(rows):
        return O.partition_by(frame(spark, rows, "v long, s string"), 2, "v")

    keys = [4, 2, 0, 3, 1, 2, None, 4, 5]
    a, b = dealt([(k, f"a{k}") for k in keys]), dealt([(k, f"b{k}") for k in reversed(keys)])
    got = O.zip_partitions([a, b], lambda fs: fs[0][["s"]].assign(t=fs[1]["s"]), "s string, t string", order=["v"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"a{k}", f"b{k}") for k in keys)


def test_partition_by_large_keys(spark):
    v = O.partition_by(frame(spark, [(5_000_000_003,), (-5_000_000_001,), (7,), (None,)], "v long"), 5, "v")
    assert got(v.select("v", F.spark_partition_id().alias("p")).na.fill(-1)) == [(-1, 0), (-5_000_000_001, 4), (5_000_000_003, 3), (7, 2)]


def test_glom_and_each_partition_see_empty_ones(spark):
    v = O.partition_by(frame(spark, [(0,), (0,), (2,)], "v int"), 4, "v")
    assert [r[0] for r in O.glom(v, "v").collect()] == [[0, 0], [], [2], []]
    seen, rows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def each(part):
        seen.add(1)
        rows.add(sum(1 for _ in part))

    O.for_each_partition(v, each)
    assert (seen.value, rows.value) == (4, 3)
    total = spark.sparkContext.accumulator(0)
    O.for_each(v, lambda r: total.add(r[0]))
    assert total.value == 2


def test_jobs_can_be_cancelled(spark):
    import time

    slow = spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id long")
    began = time.time()
    with pytest.raises(Exception), O.cancellable(spark, "slow", seconds=2):
        slow.count()
    assert time.time() - began < 40
    O.cancel(spark, "slow")
    assert spark.range(3).count() == 3 and O.task_info() == {}
    got = spark.range(2, numPartitions=2).mapInPandas(lambda it: (b.assign(part=O.task_info()["partition"]) for b in it), "id long, part int")
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 1)]


def test_split_and_sample(spark):
    v = spark.range(300).repartition(7)
    parts = O.random_split(v, [1, 2, 0, 3], 42)
    assert sum(p.count() for p in parts) == 300 and parts[2].count() == 0
    for bad in ([], [-1.0, 2.0], [0.0], [float("nan")]):
        with pytest.raises(ValueError):
            O.random_split(v, bad, 1)


def test_pipe(spark):
    v = frame(spark, [("a",), ("b",), ("c",), ("d",)], "value string").coalesce(1)
    assert got(O.pipe(v, "cat")) == [("a",), ("b",), ("c",), ("d",)]
    assert [r[0].strip() for r in O.pipe(v, "wc -l").collect()] == ["4"]
    with pytest.raises(Exception, match="exit 7"):
        O.pipe(v, "echo why >&2; exit 7").collect()
    odd = frame(spark, [(None,), ("",), ("é",), ("x" * 100_000,)], "value string").coalesce(1)
    assert [r[0] for r in O.pipe(odd, "cat").collect()] == ["", "", "é", "x" * 100_000]
    assert [r[0] for r in O.pipe(spark.range(200_000, numPartitions=1).select(F.col("id").cast("string").alias("value")), "head -n 2").collect()] == ["0", "1"]
    assert O.pipe(odd.limit(0), "cat").collect() == []


def test_sort(spark):
    v = frame(spark, [(i % 50, i) for i in range(135)], "k long, v long").repartition(5)
    for up in (True, False):
        rows = O.sort_by_key(v, "k", "v", ascending=up, partitions=4).collect()
        assert rows == sorted(rows, reverse=not up) and len(rows) == 135


def test_tree_aggregate_python_copies_its_zero(spark):
    from sparkloom.operators.actions import tree_aggregate_python

    zero = {"sum": 0}

    def seq(a, r):
        a["sum"] += r[0]
        return a

    assert tree_aggregate_python(frame(spark, [(1,), (2,), (3,), (4,)], "v long").repartition(3), zero, seq, lambda a, b: {"sum": a["sum"] + b["sum"]}) == {"sum": 10}
    assert zero == {"sum": 0}
