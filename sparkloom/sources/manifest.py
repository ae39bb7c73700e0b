"""Output that becomes visible at once, by a manifest with sizes and checksums.

Tasks write to a folder of the attempt.  The files are then read back where Spark reads them, line by line, and one
manifest file is created exclusively: of several writers one wins, the same content again is no error.  A writer that
fails or loses removes its attempt.  Readers follow the manifest, so files of lost attempts are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
NAME = "_MANIFEST.json"


class AlreadyCommitted(RuntimeError):
    """Another output has been committed at the path."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; one that is missing is no error."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def sizes(spark: SparkSession, folder: str, suffix: str = "") -> dict[str, int]:
    """Bytes of each file of a folder by name; hidden files are left out."""
    fs, p = _fs(spark, folder)
    found = {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.isFile()}
    return {k: v for k, v in sorted(found.items()) if k[0] not in "._" and k.endswith(suffix)}


def _parts(spark: SparkSession, folder: str) -> list[dict]:
    """Name, bytes, lines and checksum of each text file, from its lines as the executors read them, so files may be of any size.

    The checksum adds up 120 bits of each line's MD5: it tells a changed, missing or repeated line, in whatever order.
    """
    have = sizes(spark, folder)
    if not have:
        return []
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("_metadata.file_name").alias("key"), F.md5(F.col("value").cast("binary")).alias("m"))
    halves = [F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"h{at}") for at in (1, 16)]
    found = {r["key"]: r for r in lines.groupBy("key").agg(F.count("*").alias("lines"), *halves).collect()}  # a row a file
    none = {"lines": 0, "h1": "0", "h16": "0"}
    return [{"key": k, "bytes": n, "lines": (r := found.get(k, none))["lines"], "sum": f"{r['h1']}-{r['h16']}"} for k, n in have.items()]


def commit(df: DataFrame, path: str, *, job: str = "job") -> dict:
    """Writes the text lines of ``df`` and publishes them at ``path``; returns the manifest.  A failed or lost attempt is removed."""
    spark = df.sparkSession
    if _read(spark, f"{path}/{NAME}") is not None:
        raise AlreadyCommitted(path)
    attempt = f"_attempts/{uuid.uuid4().hex}"
    try:
        df.write.text(f"{path}/{attempt}")
        files = [f | {"key": f"{attempt}/{f['key']}"} for f in _parts(spark, f"{path}/{attempt}")]
        manifest = {"version": VERSION, "job": job, "partitions": files}
        publish(spark, path, manifest)
    except BaseException:
        remove(spark, f"{path}/{attempt}")
        raise
    return manifest


def clean_attempts(spark: SparkSession, path: str) -> list[str]:
    """Removes the attempts that the manifest doesn't name, as a driver that was lost leaves them; run it when no writer is at work.  Their names."""
    named = {f["key"].split("/")[1] for f in read_manifest(spark, path)["partitions"]}
    fs, p = _fs(spark, f"{path}/_attempts")
    gone = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName() not in named]
    for name in gone:
        remove(spark, f"{path}/_attempts/{name}")
    return sorted(gone)


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Creates the manifest if there is none; one with the same content is left as it is."""
    fs, p = _fs(spark, f"{path}/{NAME}")
    text = json.dumps(manifest, sort_keys=True)
    if (have := _read(spark, f"{path}/{NAME}")) is not None:
        if have == text:
            return
        raise AlreadyCommitted(path)
    try:
        # Only if there is none: file systems check when it is created, object stores that can when it is closed.
        stream = fs.createFile(p).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
    except Exception as e:
        if not any(x in str(e) for x in ("FileAlreadyExists", "already exists", "Precondition", "412")):
            raise
        if _read(spark, f"{path}/{NAME}") != text:
            raise AlreadyCommitted(path) from e


def read_manifest(spark: SparkSession, path: str) -> dict:
    text = _read(spark, f"{path}/{NAME}")
    if text is None:
        raise FileNotFoundError(f"no committed output at {path}")
    manifest = json.loads(text)
    if manifest.get("version") != VERSION:
        raise ValueError(f"manifest version {manifest.get('version')}")
    keys = [f["key"] for f in manifest["partitions"]]
    if len(set(keys)) < len(keys):
        raise ValueError("a partition stands in the manifest twice")
    return manifest


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest, once every file has its size, lines and checksum."""
    manifest = read_manifest(spark, path)
    have: dict[str, dict] = {}
    for folder in sorted({f["key"].rsplit("/", 1)[0] for f in manifest["partitions"]}):
        fs, p = _fs(spark, f"{path}/{folder}")
        if fs.exists(p):
            have |= {f"{folder}/{f['key']}": f for f in _parts(spark, f"{path}/{folder}")}
    for f in manifest["partitions"]:
        if have.get(f["key"], {}) | {"key": f["key"]} != f:
            raise ValueError(f"{f['key']} differs from the manifest")
    return manifest


def read_committed(spark: SparkSession, path: str, *, check: bool = False) -> DataFrame:
    manifest = verify(spark, path) if check else read_manifest(spark, path)
    keys = [f"{path}/{f['key']}" for f in manifest["partitions"]]
    return spark.read.option("lineSep", "\n").text(keys) if keys else spark.createDataFrame([], "value string")
