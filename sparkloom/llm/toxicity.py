"""Toxicity: boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon of insults (plain and written with digits or signs for letters), of a
lexicon learnt from the labelled sample, of second-person words, of insults near a second-person word,
capitals, punctuation and obfuscation rates.  The learnt lexicon holds words and word beginnings (so that
inflected forms of one stem count together) that stand in toxic documents far more often than in others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, gbt
from . import textkit as T
from .common import cut, table
from .quality import TRAIN_ROWS, held_out, labelled, remainder, training_ids

INSULTS = (
    "idiot idiots idiotic stupid moron morons moronic loser losers trash scum worthless pathetic clown clowns disgusting dumb dumbass fool fools "
    "garbage ugly jerk creep freak imbecile vermin filth filthy liar coward pig bastard bitch asshole crap shit bullshit fuck fucking damn "
    "hate kill die idioten dumm dummkopf arschloch abschaum idiota idiotas imbecil estupido estupida basura asqueroso basurero connard imbecile ordure"
).split()
SECOND_PERSON = "you your yours yourself youre ur u du dich dir dein deine ihr euch euer tu te ti toi ton ta tes vous votre vos usted ustedes vosotros".split()

_LOOKS = dict(zip(b"013457@$", b"oieastas", strict=True))
_LETTER = T.LOWER.copy()
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[0x61:0x7B] = True
_IS_LETTER[0x80:] = True
_LEET = _LETTER.copy()
for _a, _b in _LOOKS.items():
    _LEET[_a] = _b
_LEET_LETTER = _IS_LETTER.copy()
_PLAIN = T._table([(0x00, 0x60), (0x7B, 0x7F)])
#: Bytes of a word's beginning that may enter the learnt lexicon; 0: the whole word.
BEGINNINGS = (0, 4, 5, 6, 7)
NEAR = 5


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([T.word_hash(w.encode()) for w in words], dtype=np.uint64))


_INSULTS, _SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)


def _within(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon) or not len(h):
        return np.zeros(len(h), dtype=bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h


class Letters:
    """Words of letters only, with the hashes of their beginnings."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.words = T.Words(raw, off, _PLAIN)
        self.eight = T.eight_bytes(self.words.raw)

    def beginning(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of every word (of those longer than k; else 0); k = 0: of the word."""
        w = self.words
        if not k:
            return w.hash
        out = np.zeros(len(w.start), dtype=np.uint64)
        at = np.flatnonzero(w.end - w.start > k)
        out[at] = T.span_hashes(w.raw, w.start[at], w.start[at] + k, self.eight) ^ T.U64(1)  # not that of the word of k bytes
        return out


def _disguised(raw: np.ndarray, off: np.ndarray, words: T.Words) -> np.ndarray:
    """For each blank-separated word: is it an insult once signs are dropped and look-alikes are letters?"""
    buf = _LEET[words.raw]
    kept = _LEET_LETTER[buf]
    place = np.concatenate([[0], np.cumsum(kept)])
    small = buf[kept]
    a, b = place[words.start], place[words.end]
    h = T.span_hashes(small, a, b)
    return _within(h, _INSULTS) & (b > a)


@dataclass
class Lexicon:
    """Learnt hashes for each of BEGINNINGS."""

    parts: tuple[np.ndarray, ...]

    @classmethod
    def empty(cls) -> Lexicon:
        return cls(tuple(np.empty(0, np.uint64) for _ in BEGINNINGS))


NAMES = (*features.NAMES, *"insult disguised second near obfuscated learnt_word learnt_start insults_log learnt_log".split())


def matrix(raw: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES for each text."""
    blank = T.Words(raw, off, T.SPACE_WORDS)
    base = features.statistics(raw, off, blank)
    letters = Letters(raw, off)
    w = letters.words
    n = len(off) - 1
    some = np.maximum(np.diff(w.first), 1).astype(float)
    total = lambda hit, of=w: np.bincount(of.row[hit], minlength=n).astype(float)
    insult, second = _within(w.hash, _INSULTS), _within(w.hash, _SECOND)
    learnt = _within(letters.beginning(0), lexicon.parts[0])
    start = np.zeros(len(w.hash), dtype=bool)
    for k, part in list(zip(BEGINNINGS, lexicon.parts, strict=True))[1:]:
        if len(part):
            start |= _within(letters.beginning(k), part)
    near = np.zeros(len(w.hash), dtype=bool)
    you = np.flatnonzero(second)
    bad = np.flatnonzero(insult | learnt | start)
    if len(you) and len(bad):
        for side in ("left", "right"):
            at = np.clip(np.searchsorted(you, bad, side=side) - (side == "left"), 0, len(you) - 1)
            near[bad[(np.abs(you[at] - bad) <= NEAR) & (w.row[you[at]] == w.row[bad])]] = True
    disguised = total(_disguised(raw, off, blank), blank)
    sign = np.concatenate([[0], np.cumsum(features._SYMBOL[blank.raw] | features._DIGIT[blank.raw])])
    letter = np.concatenate([[0], np.cumsum(_IS_LETTER[blank.raw])])
    a, b = blank.start, blank.end
    mixed = (sign[np.maximum(b - 1, a)] - sign[np.minimum(a + 1, b)] > 0) & (letter[b] > letter[a])
    words = np.maximum(np.diff(blank.first), 1).astype(float)
    hits, own = total(insult), total(learnt | start)
    return np.column_stack([
        base, hits / some, np.maximum(disguised - hits, 0) / words, total(second) / some, total(near) / some, total(mixed, blank) / words,
        total(learnt) / some, total(start & ~learnt) / some, np.log1p(hits + disguised), np.log1p(own),
    ])


def learn_lexicon(sample: DataFrame, n_pos: int, n_neg: int, evidence: float = 25.0) -> Lexicon:
    """Words and beginnings whose document counts speak for the label with a likelihood ratio over ``evidence``.

    ``sample``: (doc_id, text, y).  Counts are summed on the executors; what comes back is at most as much
    as the bounded sample of documents can support.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            y = np.asarray(batch.column(2))
            for i, j in T.chunks(off):
                letters = Letters(raw, off[i : j + 1])
                label = y[i:j][letters.words.row]
                for k in BEGINNINGS:
                    h = letters.beginning(k)
                    keep = h != 0
                    order = np.lexsort((letters.words.row[keep], h[keep]))
                    h, row, lab = h[keep][order], letters.words.row[keep][order], label[keep][order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    h, lab = h[new], lab[new]
                    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                    pos = np.add.reduceat(lab, at).astype(np.int64) if len(at) else np.empty(0, np.int64)
                    all_ = np.diff(np.concatenate([at, [len(h)]])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(h[at].view(np.int64)), pa.array(pos), pa.array(all_ - pos)], names=["k", "h", "pos", "neg"])

    counts = sample.mapInArrow(run, "k int, h long, pos long, neg long").groupBy("k", "h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos"), F.col("neg")
    rate = n_pos / max(1, n_pos + n_neg)
    expected = (p + q) * F.lit(rate)
    ratio = 2 * (p * F.log(p / expected) + F.when(q > 0, q * F.log(q / (p + q - expected))).otherwise(0.0))
    strong = counts.where((p >= 5) & (p > 4 * expected) & (ratio >= evidence)).select("k", "h").toPandas()
    return Lexicon(tuple(np.sort(strong.loc[strong["k"] == k, "h"].to_numpy(dtype=np.int64).view(np.uint64)) for k in BEGINNINGS))


#: Part of the raw score in a score: a slope that parts what one step of the calibration holds.
SLOPE = 0.02


@dataclass
class Model:
    """A score is 0.98 of the isotonic calibration of the trees' probability and 0.02 (``SLOPE``) of that probability."""

    lexicon: Lexicon
    trees: gbt.Trees
    at: np.ndarray
    to: np.ndarray

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        p = self.trees.probability(matrix(raw, off, self.lexicon))
        return np.clip((1 - SLOPE) * np.interp(p, self.at, self.to) + SLOPE * p, 0, 1)


def train(docs: DataFrame, labels: DataFrame, allowed, *, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows for which ``allowed`` holds: lexicon and trees on four fifths, calibration on the other fifth.

    ``docs`` has columns doc_id and text, ``labels`` doc_id and ``label``; others play no part.  Each labelled id counts once,
    however often its document or its label is repeated; no labels, or one kind only, give a constant score.
    """
    ids = training_ids(labels, label, allowed, rows)
    sample = cut(labelled(docs, ids).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0))
    learns = sample.where(~F.col("calibrates"))
    size = {r["y"]: r["n"] for r in learns.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(learns.select("doc_id", "text", "y"), size.get(1, 0), size.get(0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            for i, j in T.chunks(off):
                x = matrix(raw, off[i : j + 1], lexicon)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "calibrates", "x"])

    got = sample.mapInArrow(run, f"doc_id {dict(sample.dtypes)['doc_id']}, y int, calibrates boolean, x binary").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(v) for v in got["x"]]).reshape(len(got), len(NAMES))
    y, fold = got["y"].to_numpy(dtype=float), got["calibrates"].to_numpy(dtype=bool)
    trees = gbt.fit(x[~fold], y[~fold], trees=60)
    return Model(lexicon, trees, *gbt.isotonic(trees.probability(x[fold]), y[fold]))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str], name: str = "__score") -> DataFrame:
    """``keep`` columns and the score of every row, as column ``name`` (none of ``keep``); null counts as empty text, an empty table gives no rows."""
    names = [f"c{i}" for i in range(len(keep))]  # so that no column clashes
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = T.text_buffers(batch.column(batch.num_columns - 1))
            for i, j in T.chunks(off):
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(raw, off[i : j + 1]))], names=[*names, "score"])

    return source.mapInArrow(run, source.drop("text").schema.add("score", "double")).toDF(*keep, name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    got = score(docs, model, keep=["doc_id"], name="score")
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
