import pytest

from sparkloom import sources as S
from sparkloom.functions import nan_free
from sparkloom.plans import kept, pipelines, shared


def test_text_rules(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\n")
    (tmp_path / "sub" / "b.txt").write_bytes(b"last")
    (tmp_path / "_SUCCESS").write_text("no")
    (tmp_path / ".hidden").write_text("no")
    assert sorted(r[0] for r in S.text_file(spark, str(tmp_path)).collect()) == ["last", "x", "y\rz"]
    with pytest.raises(Exception, match="over the limit"):
        S.text_file(spark, str(tmp_path), max_line_bytes=2).collect()
    assert S.text_file(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.text_file(spark, str(tmp_path / "none")).count()


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    path = str(tmp_path / "out")
    manifest = S.commit(df, path)
    assert sorted(r[0] for r in S.read_committed(spark, path, check=True).collect()) == ["a", "b"]
    with pytest.raises(S.AlreadyCommitted):
        S.commit(df, path)
    S.manifest.publish(spark, path, manifest)
    with pytest.raises(S.AlreadyCommitted):
        S.manifest.publish(spark, path, manifest | {"job": "other"})
    with pytest.raises(S.AlreadyCommitted):
        S.commit(df.limit(1), path)
    (tmp_path / "out" / "_attempts" / "lost").mkdir()
    (tmp_path / "out" / "_attempts" / "lost" / "part").write_text("z\n")
    assert S.clean_attempts(spark, path) == ["lost"] and S.clean_attempts(spark, path) == []
    assert sorted(r[0] for r in S.read_committed(spark, path, check=True).collect()) == ["a", "b"]
    part = next(f for f in manifest["partitions"] if f["bytes"])
    (tmp_path / "out" / part["key"]).write_text("changed")
    (tmp_path / "out" / part["key"]).with_name("." + part["key"].rsplit("/", 1)[1] + ".crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        S.verify(spark, path)
    with pytest.raises(FileNotFoundError):
        S.read_manifest(spark, str(tmp_path / "none"))


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "out"
    with pytest.raises(Exception, match="broken"):
        S.commit(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("x").alias("value")), str(path))
    assert not list((path / "_attempts").glob("*")) and not (path / "_MANIFEST.json").exists()
    S.commit(spark.createDataFrame([("", )] * 3, "value string"), str(path))
    assert S.read_committed(spark, str(path), check=True).count() == 3
    none = str(tmp_path / "none")
    S.commit(spark.createDataFrame([], "value string"), none)
    assert S.read_committed(spark, none, check=True).count() == 0


def test_changed_lines_are_told(spark, tmp_path):
    path = str(tmp_path / "out")
    manifest = S.commit(spark.createDataFrame([("ab",), ("cd",)], "value string").coalesce(1), path)
    file = tmp_path / "out" / manifest["partitions"][0]["key"]
    for text, fine in (("cd\nab\n", True), ("ab\nab\n", False), ("ab\ncX\n", False)):
        file.write_text(text)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        if fine:
            S.verify(spark, path)
        else:
            with pytest.raises(ValueError):
                S.verify(spark, path)


def test_text_in_many_splits(spark, tmp_path):
    texts = {"aligned": "aaa\nbbb\nccc\n", "open": "\n".join(f"line-{i:02}" for i in range(50)), "long": "x" * 200 + "\ny\r\n", "empty": "", "ends": "\n\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted(x.removesuffix("\r") for t in texts.values() for x in (t.split("\n")[:-1] if t.endswith("\n") else t.split("\n")) if t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (3, 4, 7, 50, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            lines = S.text_file(spark, str(tmp_path))
            assert sorted(r[0] for r in lines.collect()) == want
            assert lines.rdd.getNumPartitions() > 60 or size > 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "c")
    S.write_checkpoint(spark.range(4), path)
    assert S.read_checkpoint(spark, path).count() == 4
    again = S.write_checkpoint(spark.range(9), path)  # there is one already
    assert again.count() == 4 and len(list((tmp_path / "c").glob("data-*"))) == 1
    for f in (tmp_path / "c").glob("data-*/*.parquet"):
        f.unlink()
        break
    with pytest.raises(FileNotFoundError):
        S.read_checkpoint(spark, path)


def test_range(spark):
    assert [r[0] for r in S.make_range(spark, 10, 0, -4).collect()] == [10, 6, 2]
    assert S.make_range(spark, 0, 5, -1).count() == 0
    with pytest.raises(ValueError):
        S.make_range(spark, 0, 5, 0)


def test_pipelines(spark, tmp_path):
    from pyspark.sql import functions as F

    @pipelines.register("test-share")
    def share(spark, params):
        v = spark.createDataFrame([(2.0,), (3.0,), (5.0,)], "x double").where(F.lit(params.get("empty") != "yes"))
        return v.select((F.col("x") / pipelines.reduction(v, F.sum("x"))).alias("share"))

    assert sorted(r[0] for r in pipelines.run(spark, "test-share")) == [0.2, 0.3, 0.5]
    assert pipelines.run(spark, "test-share", "count") == 3
    with pytest.raises(ValueError):
        pipelines.register("test-share", share)
    with pytest.raises(KeyError):
        pipelines.run(spark, "absent")


def test_jobs_and_plans(spark, tmp_path):
    from pyspark.sql import functions as F

    pipelines.register("test-numbers", lambda spark, params: spark.range(int(params.get("n", "5"))).where("id <> 2"))
    pipelines.register_reduction("test-sum", F.sum("id"), zero=0)
    spec = pipelines.JobSpec("test-numbers", "test-sum", {"n": "5"}, 3)
    planned = pipelines.plan_job(spark, spec)
    pipelines.verify_plan(spark, planned, spec)
    for other in (pipelines.JobSpec("test-numbers", "count", {"n": "5"}, 3), pipelines.JobSpec("test-numbers", "test-sum", {"n": "6"}, 3), pipelines.JobSpec("test-numbers", "test-sum", {"n": "5"}, 4)):
        with pytest.raises(ValueError, match="fingerprint"):
            pipelines.verify_plan(spark, planned, other)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert pipelines.run_job(spark, spec) == 8 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert pipelines.run(spark, "test-numbers", "test-sum", n="0") == 0
    with pytest.raises(ValueError):
        pipelines.run(spark, "test-numbers", "absent")
    with pytest.raises(ValueError):
        pipelines.run(spark, "test-numbers", "save")
    with pytest.raises(ValueError):
        pipelines.register_reduction("test-sum", F.sum("id"))
    a = spark.range(3).where("id > 1")
    assert pipelines.fingerprint(a) == pipelines.fingerprint(spark.range(3).where("id > 1")) != pipelines.fingerprint(spark.range(3).where("id > 0"))
    assert pipelines.same_plan(a, spark.range(3).where("id > 1"))


def test_object_store_layers():
    from sparkloom.session import ObjectStore

    env = ObjectStore.of_environment({"AWS_DEFAULT_REGION": "r1", "AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "AWS_S3_PATH_STYLE": "true"})
    both = ObjectStore(endpoint="http://store:9000", session_token="t").over(ObjectStore(region="r2", endpoint="http://other").over(env))
    assert both == ObjectStore("r2", "http://store:9000", "k", "s", "t", True)
    got = both.settings()
    assert got["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000" and got["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert got["spark.hadoop.fs.s3a.aws.credentials.provider"].endswith("TemporaryAWSCredentialsProvider")
    assert ObjectStore().settings() == {} == ObjectStore.of_environment({}).settings()


def test_command_line(monkeypatch, capsys, spark, tmp_path):
    from sparkloom import __main__ as cli

    class Kept:  # the tests' session, which must not stop
        def __getattr__(self, name):
            return (lambda: None) if name == "stop" else getattr(spark, name)

    monkeypatch.setattr(cli, "session", lambda app: Kept())
    assert cli.main(["list"]) == 0 and "numbers" in capsys.readouterr().out
    assert cli.main(["count", "numbers"]) == 0 and capsys.readouterr().out.strip() == "5"
    assert cli.main(["run", "sort", "order=down"]) == 0 and capsys.readouterr().out.startswith("Row(k=127")
    path = str(tmp_path / "out")
    assert cli.main(["save", "wordcount-lines", f"path={path}"]) == 0 and cli.main(["verify", path]) == 0
    assert "verified" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2 and cli.main([]) == 2


def test_shared_and_kept(spark):
    b = shared.Broadcasts(spark, limit=1000)
    b.add("m", {"a": 3})
    assert b.read("m") == {"a": 3}
    for name, value in (("m", 1), ("", 1), ("x" * 129, 1), ("big", "y" * 2000)):
        with pytest.raises(ValueError):
            b.add(name, value)
    k = kept.Kept()
    df = spark.range(5)
    assert k.persist("r", df) is k.persist("r", spark.range(5))
    k.stop()
    assert not k.frames


def test_nan_keys(spark):
    df = spark.createDataFrame([(float("nan"),)], "k double")
    with pytest.raises(Exception, match="NaN"):
        df.select(nan_free("k")).collect()


def test_function_source_and_sinks(spark, tmp_path):
    df = S.function_source(spark, "numbers-of-partition", "part int, v int", 3, lambda i: iter([(i, 10 * i + k) for k in range(i)]))
    assert sorted(map(tuple, df.collect())) == [(1, 10), (2, 20), (2, 21)]
    lines = spark.createDataFrame([("a",), ("b",), ("c",)], "value string").coalesce(1)

    def write(base, part, rows):
        with open(f"{base}/{part}", "w") as f:
            f.writelines(f"{x}\n" for x in rows)

    S.save_with(lines, str(tmp_path), write)
    assert (tmp_path / "0").read_text() == "a\nb\nc\n"
    S.save_partition(lines, 0, str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one")).count() == 3
    with pytest.raises(IndexError):
        S.save_partition(lines, 5, str(tmp_path / "none"))


def test_bundled_pipelines(spark, tmp_path):
    from sparkloom.plans import bundled

    assert bundled and pipelines.run(spark, "numbers", "count") == 5
    assert {tuple(r) for r in pipelines.run(spark, "wordcount")} == {("hello", 3), ("world", 2), ("spark", 2)}
    assert {tuple(r) for r in pipelines.run(spark, "join")} == {(1, "one", 10), (1, "one", 11), (2, "two", 20)}
    assert {tuple(r) for r in pipelines.run(spark, "broadcast")} == {("a", 3), ("b", 5), ("missing", 0)}
    assert [r.k for r in pipelines.run(spark, "sort", order="down")] == list(range(127, -1, -1))
    path = str(tmp_path / "saved")
    pipelines.run(spark, "wordcount-lines", "save", path=path)
    assert sorted(r[0] for r in S.read_committed(spark, path, check=True).collect()) == ["{hello 3}", "{spark 2}", "{world 2}"]


def test_stream_of_lines(spark, tmp_path):
    from sparkloom.streaming import text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x\r\ny\n")
    q = text_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("stream_lines").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("stream_lines").collect()) == ["x", "y"]
