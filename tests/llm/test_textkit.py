import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import packing, token_count
from sparkloom.llm import textkit as T


def folded(n, a="a", b="b"):
    """A Thue-Morse word of n letters and its complement: they collide under any polynomial hash modulo 2 ** 64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


@pytest.mark.parametrize("n", [64, 200, 1024, 2048, 4096])
def test_arranged_words_have_their_own_hashes_ids_and_counts(n):
    for a, b in ("ab", ("q", "z"), ("abcdefgh", "hgfedcba")):
        texts = list(folded(n, a, b))
        raw, off = T.text_buffers(pa.array(texts))
        w = T.Words(raw, off, T.SPACE_WORDS)
        assert w.hash[0] != w.hash[1]
    encoder = packing.Encoder(packing.read_ranks())
    ids, size = encoder.encode(raw, off)
    assert [encoder.bpe.decode(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1])] == texts
    v = token_count.Vocabulary.from_ranks(["a", "ab", "bba"])
    raw, off = T.text_buffers(pa.array(list(folded(n))))
    both = token_count.Counter(v).counts(raw, off)[1].tolist()
    alone = [token_count.Counter(v).counts(*T.text_buffers(pa.array([t])))[1][0] for t in folded(n)]
    assert both == alone


def test_spans_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(T, "span_hashes", lambda buf, start, end, eight=None: (end - start).astype(np.uint64) % T.U64(2))
    words = ["aa", "bb", "aa", "c" * 300, "d", "c" * 299 + "x", "c" * 300, "", "bb", "d"]
    raw, off = T.text_buffers(pa.array(words))
    where, number = T.distinct_spans(raw, off[:-1], off[1:])
    assert [words[i] for i in where[number]] == words and len(where) == len(set(words))
    encoder = packing.Encoder(packing.read_ranks())
    ids, _ = encoder.encode(*T.text_buffers(pa.array(["one two one six ten two"])))
    assert encoder.bpe.decode(ids.tolist()) == "one two one six ten two"


def test_hash_of_a_span_does_not_depend_on_its_place():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 16, 17, 255, 256, 257, 3000):
        span = r.integers(0, 256, n, dtype=np.uint8)
        got = set()
        for before, after in ((0, 0), (1, 9), (13, 2)):
            buf = np.concatenate([r.integers(0, 256, before, dtype=np.uint8), span, r.integers(0, 256, after, dtype=np.uint8)])
            got.add(int(T.span_hashes(buf, np.array([before]), np.array([before + n]))[0]))
        assert len(got) == 1 and T.word_hash(span.tobytes()) in got
