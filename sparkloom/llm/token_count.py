"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a run without white space, with the word mark before it.  The distinct pre-tokens of a block of
texts form a trie; those over ``LONG`` bytes are segmented one by one instead, by a plain dynamic program.  Level by level, the best
score of each trie node (the forward score of its prefix) is found once for all pre-tokens that share it;
a pre-token's count is stored at its terminal node.  Counts of a text are sums over its pre-tokens.

The best segmentation has the largest sum of piece scores, then the fewest pieces.  Bytes that no piece
covers are pieces of their own, at a score below every piece's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG, AT_ONCE = 256, 1 << 16


@dataclass
class Vocabulary:
    """Pieces and their log scores, by length and hash; ``byte_score``: of a byte without a piece."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_score: float

    def __post_init__(self) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        length = np.array([len(p) for p in self.pieces])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            h = np.array([T.word_hash(self.pieces[i]) for i in at], dtype=np.uint64)
            order = np.argsort(h)
            content = np.frombuffer(b"".join(self.pieces[i] for i in at[order]), dtype=np.uint8).reshape(-1, n)
            self.by_length[n] = h[order], self.scores[at][order], content
        self.longest = max(self.by_length, default=1)

    def gains(self, k: int, buf: np.ndarray, end: np.ndarray, eight: np.ndarray) -> np.ndarray:
        """Score of the piece of k bytes that ends at each place, minus infinity where there is none."""
        out = np.full(len(end), self.byte_score if k == 1 else -np.inf)
        if k in self.by_length and len(end):
            h, score, content = self.by_length[k]
            got = T.span_hashes(buf, end - k, end, eight)
            at = np.minimum(np.searchsorted(h, got), len(h) - 1)
            hit = np.flatnonzero(h[at] == got)
            if k > 8 and len(hit):  # up to eight bytes a hash has one content
                hit = hit[(buf[end[hit, None] - k + np.arange(k)] == content[at[hit]]).all(axis=1)]
            out[hit] = score[at[hit]]
        return out

    @classmethod
    def from_ranks(cls, pieces: list[str]) -> Vocabulary:
        """Pieces in order of rank, with the log probabilities of Zipf's law."""
        rank = np.arange(1, len(pieces) + 1)
        scores = -np.log(rank) - np.log((1 / rank).sum())
        return cls([p.encode() for p in pieces], scores, float(scores.min()) - 10)


def load(path: str = TOKENIZER) -> Vocabulary:
    """The ordinary pieces of a sentencepiece file, read on the driver; tasks get them with the operator.

    A unigram file has log probabilities, which are taken as they are.  A file of merges has none, only ranks (its scores
    are 0, -1, -2, ...); as tokenizers aren't trained here, its log probabilities follow from the ranks by Zipf's law.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return of_scores([sp.id_to_piece(i) for i in some], np.array([sp.get_score(i) for i in some]))


def of_scores(pieces: list[str], scores: np.ndarray) -> Vocabulary:
    """Pieces with the scores of their file, which are log probabilities or negative ranks in order."""
    if np.array_equal(scores, -np.arange(len(scores))):
        return Vocabulary.from_ranks(pieces)
    return Vocabulary([p.encode() for p in pieces], np.asarray(scores, dtype=float), float(np.min(scores, initial=0.0)) - 10)


def terminal_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Pieces of the best segmentation of each span of ``buf``."""
    n = len(start)
    out = np.zeros(n, dtype=np.int64)
    eight = T.eight_bytes(buf)
    length = end - start
    alive = np.flatnonzero(length > 0)
    node = np.zeros(n, dtype=np.int64)  # trie node of each span at the present depth
    nodes: dict[int, np.ndarray] = {0: node.copy()}
    best: dict[int, np.ndarray] = {0: np.zeros(1)}
    count: dict[int, np.ndarray] = {0: np.zeros(1, np.int64)}
    depth = 0
    while len(alive):
        depth += 1
        key = node[alive] * 256 + buf[start[alive] + depth - 1]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        node[alive] = inverse
        who = alive[first]  # a span that passes through each node
        score = np.full(len(who), -np.inf)
        pieces = np.zeros(len(who), dtype=np.int64)
        for k in range(1, min(depth, v.longest) + 1):
            if k not in v.by_length and k > 1:
                continue
            before = nodes[depth - k][who]
            gain = v.gains(k, buf, start[who] + depth, eight)
            total, n_pieces = best[depth - k][before] + gain, count[depth - k][before] + 1
            better = (total > score) | ((total == score) & (n_pieces < pieces) & np.isfinite(total))
            score[better], pieces[better] = total[better], n_pieces[better]
        best[depth], count[depth], nodes[depth] = score, pieces, node.copy()
        for old in (best, count, nodes):
            old.pop(depth - v.longest, None)
        done = alive[length[alive] == depth]
        out[done] = pieces[node[done]]
        alive = alive[length[alive] > depth]
    return out


def plain_counts(buf: np.ndarray, length: np.ndarray, v: Vocabulary) -> list[int]:
    """The same as terminal_counts for spans that fill ``buf`` one after the other, in time in proportion to its bytes."""
    eight = T.eight_bytes(buf)
    depth = np.arange(len(buf)) - np.repeat(np.cumsum(length) - length, length) + 1  # bytes of a span up to each
    out: list[int] = []
    keep = v.longest
    best, count = [0.0], [0]  # of the last positions
    for a in range(1, len(buf) + 1, AT_ONCE):
        ends = np.arange(a, min(a + AT_ONCE, len(buf) + 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted({1, *v.by_length}):
            own = ends[depth[ends - 1] >= k]
            gain = v.gains(k, buf, own, eight)
            some = np.isfinite(gain)
            found.append((own[some], np.full(int(some.sum()), k), gain[some]))
        end, size, gain = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        last = a - 1
        for e, k, g in zip(end[order].tolist(), size[order].tolist(), gain[order].tolist(), strict=True):
            if e != last:
                if depth[e - 1] == 1 and e > 1:
                    out.append(count[-1])
                    best, count = [0.0], [0]
                best.append(-np.inf), count.append(0)
                last = e
            at = k + 1  # from the end, where the entry of e itself stands
            total, pieces = best[-at] + g, count[-at] + 1
            if total > best[-1] or (total == best[-1] and pieces < count[-1]):
                best[-1], count[-1] = total, pieces
        best, count = best[-keep:], count[-keep:]
    return [*out, count[-1]]


class Counter:
    """Counts of texts; what distinct pre-tokens cost is kept for the later blocks of a task."""

    KEPT = 500_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[bytes, int] = {}

    def counts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        w = T.Words(raw, off, T.SPACE_WORDS, lower=False)
        where, inverse = T.distinct_spans(w.raw, w.start, w.end)
        content = [w.raw[a:b].tobytes() for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)]
        if len(self.known) > self.KEPT:
            self.known = {}
        new = [c for c in content if c not in self.known]
        if new:
            buf = np.frombuffer(b"".join(MARK + c for c in new), dtype=np.uint8)
            size = np.array([len(MARK) + len(c) for c in new])
            end = np.cumsum(size)
            long = size > LONG
            cost = np.empty(len(new), dtype=np.int64)
            cost[~long] = terminal_counts(buf, (end - size)[~long], end[~long], self.v)
            if long.any():
                cost[long] = plain_counts(buf[np.repeat(long, size)], size[long], self.v)
            self.known |= zip(new, cost.tolist(), strict=True)
        cost = np.array([self.known[c] for c in content], dtype=np.int64)
        return np.diff(w.first).astype(np.int64), np.bincount(w.row, cost[inverse], w.n_rows).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row; null, empty and blank texts have none.

    Runs of any length are segmented whole.  Ids may be null or repeated; an empty table gives no rows; other columns play no part.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            raw, off = T.text_buffers(batch.column(1))
            for i, j in T.chunks(off):
                words, tokens = counter.counts(raw, off[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return source.mapInArrow(run, source.select("doc_id").schema.add("n_pretokens", "long").add("n_tokens", "long"))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load())
