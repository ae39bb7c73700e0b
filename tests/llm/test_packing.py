import numpy as np
import pytest

from sparkloom.llm import packing as P
from sparkloom.llm import textkit as T


@pytest.fixture(scope="module")
def ranks():
    return P.read_ranks()


def texts_of(packs, ranks):
    encoder = P.Encoder(ranks)
    got = {}
    for r in P.unpack(packs).collect():
        got.setdefault((r.part, r.doc_id), []).append((r.offset, np.frombuffer(r.ids, "<u2")))
    return encoder, got


def test_round_trip(spark, data, ranks):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packs = P.pack(docs, ranks=ranks, length=256).cache()
    encoder, got = texts_of(packs, ranks)
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {k[1] for k in got} == set(want)
    for (_, doc), pieces in got.items():
        pieces.sort(key=lambda x: x[0])
        assert [p[0] for p in pieces] == [256 * i for i in range(len(pieces))]
        ids = np.concatenate([p[1] for p in pieces])
        assert ids[-1] == encoder.end_id and encoder.bpe.decode(ids[:-1].tolist()) == want[doc]
    row = packs.first()
    assert len(row.ids) == 512 and row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens and row.position_resets == row.cu_seqlens[:-1]


def test_edges(edge_docs, no_docs, ranks):
    packs = P.pack(edge_docs, ranks=ranks, length=128)
    docs = [d for r in packs.collect() for d, p in zip(r.doc_ids, r.pieces) if p == 0]
    assert sorted(map(str, docs)) == sorted(str(r.doc_id) for r in edge_docs.collect())
    assert P.pack(no_docs, ranks=ranks).count() == 0


@pytest.mark.parametrize("limit", [40, 700, 1 << 21])
def test_ids_are_the_tokenizers(ranks, limit):
    import pyarrow as pa

    texts = ["", "a  b", "\n\nx \n y z  　 w", "  lead", "trail  \n", "tab\t\tx", "\r\n\r\nq", "'s it's", "日本 語　テスト", "\x1c x\x1d  y", "1234 ab12 !!?"] * 3
    encoder = P.Encoder(ranks)
    raw, off = T.text_buffers(pa.array(texts))
    got = []
    for i, j in T.chunks(off, limit):
        ids, size = encoder.encode(raw, off[i : j + 1])
        got += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    assert got == [encoder.bpe.encode_ordinary(x) for x in texts]


def test_bytes_that_are_no_text(ranks):
    encoder = P.Encoder(ranks)
    raw = np.frombuffer(b"ab \xff\xfe cd", np.uint8)
    ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
    assert encoder.bpe.decode_bytes(ids.tolist()) == bytes(raw)


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for length in (1, 7, 64, 100):
        sizes = rng.integers(1, length + 1, 500)
        rows = P.best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(500))
        free, want = [], []  # the same rule by search in a list
        for i in np.argsort(-sizes, kind="stable"):
            fits = [(f, k) for k, f in enumerate(free) if f >= sizes[i]]
            if fits:
                least = min(fits)[0]
                k = next(k for f, k in fits if f == least)
            else:
                k = len(free)
                free.append(length)
                want.append(0)
            free[k] -= sizes[i]
            want[k] += sizes[i]
        assert sorted(int(sizes[r].sum()) for r in rows) == sorted(int(x) for x in want)


def test_written_rows_are_read_again(edge_docs, ranks, tmp_path):
    packs = P.pack(edge_docs, ranks=ranks, length=64)
    P.write(packs, str(tmp_path / "packs"))
    back = edge_docs.sparkSession.read.parquet(str(tmp_path / "packs"))
    assert back.columns == packs.columns and sorted(map(repr, back.collect())) == sorted(map(repr, packs.collect()))
    assert all(len(r.ids) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 64 for r in back.collect())
