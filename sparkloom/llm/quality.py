"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, gbt
from . import textkit as T
from .common import table

#: At most so many labelled rows are learnt from, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000


def remainder(column: str, mod: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def training_ids(labels: DataFrame, label: str, allowed, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents.  Nulls and values but 0 and 1 are no labels; of contradictory rows of one id none counts."""
    each = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed)
    one = each.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).where("y = y2").drop("y2")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out(column: str, mod: int, rest: int):
    """Whether the id's remainder is ``rest``; a null id isn't held out (it has no label)."""
    return F.coalesce(remainder(column, mod) == rest, F.lit(False))


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y), one row an id: of rows that share it the smallest text, null as empty.

    The ids are at most as many as training_ids gives, so they go to all tasks, and what comes back is no more.
    """
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return some.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def _matrix(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray]]:
    raw, off = T.text_buffers(batch.column(text))
    for i, j in T.chunks(off):
        part = off[i : j + 1]
        yield i, j, features.statistics(raw, part, T.Words(raw, part, T.SPACE_WORDS))


def train(docs: DataFrame, labels: DataFrame, allowed, *, label: str = "quality", rows: int = TRAIN_ROWS, **options) -> gbt.Trees:
    """The model learnt from labelled rows for which the column ``allowed`` holds.

    ``docs`` has columns doc_id and text, ``labels`` doc_id and ``label``; others play no part.  Each labelled id counts once,
    however often its document or its label is repeated; no labels, or one kind only, give a constant score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _matrix(batch, 1):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = labelled(docs, training_ids(labels, label, allowed, rows))
    got = got.mapInArrow(run, f"doc_id {dict(got.dtypes)['doc_id']}, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.array([np.frombuffer(v) for v in got["x"]]).reshape(len(got), len(features.NAMES))
    return gbt.fit(x, got["y"].to_numpy(dtype=float), **options)


def score(docs: DataFrame, model: gbt.Trees, *, text: str = "text", keep: list[str], name: str = "__score") -> DataFrame:
    """``keep`` columns and the score of every row, as column ``name``; null counts as empty text."""
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    at = source.columns.index(text)
    kept = [i for i, c in enumerate(source.columns) if c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _matrix(batch, at):
                cols = [batch.column(c).slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(model.probability(x))], names=[*(batch.schema.names[c] for c in kept), name])

    return source.mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def accept(docs: DataFrame, model: gbt.Trees, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with the columns they have."""
    name = "__quality"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text=text, keep=docs.columns, name=name).where(F.col(name) >= least).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    got = score(docs, model, keep=["doc_id"], name="score")
    return got.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
