import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import WORDS, prose

from sparkloom.llm import common, decontam, embed_dedup, ngram_join
from sparkloom.llm import textkit as T


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, n)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return closure(ids, links), {i: len(s) for i, s in sets.items()}


def near_copies(seed, groups=12):
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = prose(100 * seed + g, r.choice([2, 9, 12, 40, 150, 700])).split()
        for _ in range(r.choice([1, 3, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, max(1, len(w) // 40)])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((i, " ".join(w) + r.choice(["", " \n"])))
            i += 1
    return rows


@pytest.mark.parametrize("n, percent, tile", [(3, 90, 2048), (5, 80, 2048), (3, 90, 3), (5, 80, 3)])
def test_join_equals_brute_force(spark, n, percent, tile):
    rows = near_copies(n + tile)
    want, size = brute(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=n, percent=percent, tile_rows=tile).collect()}
    assert got == {i: (size[i], want[i]) for i in want}


@pytest.mark.parametrize("percent, tile", [(80, 2048), (80, 3)])
def test_join_counts_all_links(spark, percent, tile):
    rows = near_copies(7 + tile) + [(5000 + i, " ".join(WORDS[:25]) + (f" x{i // 2}" if i % 4 else "")) for i in range(30)]
    rows += [(5000, prose(5, 40)), (6000, prose(5, 40)), (6000, prose(5, 40)), (None, prose(5, 40)), (6001, prose(5, 39) + " other"), (6002, ""), (6003, None)]
    sets = [shingles(t, 5) if i is not None else set() for i, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    want = sorted(((i, len(a) if i is not None else 36, sum(linked(a, b) for k, b in enumerate(sets) if k != j)) for j, ((i, _), a) in enumerate(zip(rows, sets))), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in ngram_join.join(docs, n=5, percent=percent, tile_rows=tile).collect()), key=repr) == want
    assert max(w[2] for w in want) > 20


def spark_of(df):
    return df.sparkSession


def test_join_edges(edge_docs, no_docs):
    got = ngram_join.join(edge_docs, n=3, percent=90).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1), (8, 8), (None, None)], key=repr)
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.keep_first(edge_docs)
    again = [(1, prose(1, 60)), (1, prose(2, 60)), (3, prose(2, 60)), (-4, prose(3, 60)), (1, prose(3, 60)), (None, prose(1, 60)), (None, prose(9, 60)), (None, prose(9, 60)), (9, ""), (10, None)]
    left = ngram_join.keep_first(spark_of(edge_docs).createDataFrame(again, "doc_id long, text string").withColumn("key", F.lit(1)))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([again[0], again[1], again[3], again[6], again[8], again[9]], key=repr)
    assert kept.columns == edge_docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, None]))


def test_no_pair_escapes_blocking_and_bound():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        make = ngram_join.Signatures(percent)
        for size in (9, 10, 11, 19, 37, 80, 300, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
                drop = int(size * (100 - percent) / 100)
                b = np.sort(np.concatenate([np.delete(a, rng.choice(len(a), drop, replace=False)), np.unique(rng.integers(0, 2**63, rng.integers(0, 3), dtype=np.uint64))]))
                i = len(np.intersect1d(a, b))
                if 100 * i < percent * (len(a) + len(b) - i) or len(a) == len(b) == i:
                    continue
                assert set(make.of(a).tolist()) & set(make.of(b).tolist()), (percent, size)
                assert ngram_join.links_of([a, b], percent) == [(0, 1)]


def test_count_tree_keeps_all_pairs_under_the_bound():
    counts = np.random.default_rng(0).integers(0, 4, (150, 8))
    size = counts.sum(axis=1)
    want = {(i, j) for i in range(150) for j in range(i) if 180 * np.minimum(counts[i], counts[j]).sum() >= 80 * (size[i] + size[j])}
    got = {(max(x, y), min(x, y)) for xs, ys in ngram_join.CountTree(counts, 80).pairs() for x, y in zip(xs.tolist(), ys.tolist())}
    assert got == want


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (None, 3)] + [(500, 600 + i) for i in range(40)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100, 500: 500} | {600 + i: 500 for i in range(40)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def unit(rng, n, dim=16):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine_links(rows):
    ok = [(i, label, np.array(v, float)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = defaultdict(int)
    links = []
    for k, (a, la, x) in enumerate(ok):
        for b, lb, y in ok[:k]:
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a] += 1
                n[b] += 1
                links.append((a, b))
    return n, closure([r[0] for r in rows if r[0] is not None], links)


@pytest.mark.parametrize("tile", [4096, 7])
def test_embeddings_equal_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    base = unit(rng, 12)
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * (0.0 if i % 5 == 0 else 0.03) if i < 150 else unit(rng, 1)[0]
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, rows[0][1], None), (906, [], 1), (907, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    n, top = cosine_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.links(df, tile_rows=tile, window=4).collect()}
    assert got == {i: (n[i], top[i]) for i in top}
    assert embed_dedup.links(df.limit(0)).count() == 0
    assert embed_dedup.links(spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()[0].n_links == 0


def test_sorted_passes_reach_the_recall(spark):
    rng = np.random.default_rng(9)
    a = unit(rng, 1500, 64)
    noise = unit(rng, 1500, 64)
    b = a + 0.36 * noise  # cosines near the threshold
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([a, b]))]
    n, _ = cosine_links(rows)
    got = sum(r.n_links for r in embed_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got >= 0.97 * sum(n.values())


def test_hot_label_with_a_common_direction(spark):
    rng = np.random.default_rng(4)
    common_, own = unit(rng, 1, 64), unit(rng, 4000, 64)
    a = np.sqrt(0.8) * common_ + np.sqrt(0.2) * own  # mutual cosines near 0.8
    v = np.concatenate([a, a + 0.36 * unit(rng, 4000, 64)]).astype(np.float32)  # and pairs near the threshold
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    near = w @ w.T >= 0.93
    np.fill_diagonal(near, False)
    top = closure(range(len(v)), np.argwhere(near).tolist())
    rows = pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(v), pa.int32())})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.links(spark.createDataFrame(rows)).collect()}
    assert near.sum() > 1000 and got == {i: (int(n), top[i]) for i, n in enumerate(near.sum(axis=1))}


def scan_brute(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])] |= {str(i)} if i is not None else set()
    out = []
    for i, t in docs:
        w = words(t)
        hit, found, near = set(), set(), set()
        for p, owners in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= owners
            if set(p) <= set(w) and any(set(p) <= set(w[k : k + 2 * window]) for k in range(len(w))):
                near |= owners
        out.append((i, len(w), len(hit), sorted(found), len(near)))
    return out


def test_phrases_equal_brute_force(spark, edge_docs, no_docs):
    items = [(i, prose(500 + i, 13 + 4 * i)) for i in range(6)] + [(50, "Short one"), (51, ""), (52, None), (None, prose(777, 20)), (0, prose(500, 13)), (53, "short ONE")]
    docs = []
    for i in range(40):
        a = prose(i, 30)
        b = items[i % 6][1]
        docs.append((i, f"{a} {b.upper() if i % 3 else b} {a}" if i % 2 else f"{a}. SHORT, one! {' '.join(b.split()[:12])}"))
    scattered = items[2][1].split()
    docs += [(70, " ".join(x for w in reversed(scattered[:13]) for x in (w, "zz"))), (71, " ".join(x for w in scattered[:13] for x in (w, "zz", "zz"))), (72, prose(9, 3) + " one x short " + prose(9, 3))]
    docs += [(r.doc_id, r.text) for r in edge_docs.collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted(scan_brute(docs, items), key=repr)
    for block_mb in (2, 0.0002):  # one block of items, and several whose hits are united
        got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.n_near) for r in decontam.scan(df, bench, block_mb=block_mb).collect()]
        assert sorted(got, key=repr) == want
    assert decontam.scan(no_docs, bench).count() == 0
    assert decontam.scan(edge_docs, bench.limit(0)).where("n_hit > 0 or n_items > 0 or n_near > 0").count() == 0
    clash = df.withColumn("n_hit", F.lit("kept")).withColumn("gone", F.lit(1))
    kept = decontam.clean(clash, bench)
    assert kept.columns == clash.columns
    assert sorted((repr((r.doc_id, r.text)) for r in kept.collect())) == sorted(repr(d) for d, x in zip(docs, scan_brute(docs, items), strict=True) if not x[2])


def test_positions_are_packed_without_loss():
    rng = np.random.default_rng(2)
    count = rng.integers(1, 9, 300)
    position = np.concatenate([np.sort(rng.choice(10 ** int(rng.integers(1, 8)) + 9, n, replace=False)) for n in count])
    packed, width = decontam.pack_positions(position, count)
    assert [len(d) for d in packed] == (count * width).tolist()
    assert np.concatenate([decontam.unpack_positions(d, int(n)) for d, n in zip(packed, count)]).tolist() == position.tolist()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b c"), (2, "c b x a"), (3, "a x x x x b c"), (4, None), (2, "c b x a"), (None, "a b c")], "doc_id long, text string").withColumn("word", F.lit("x"))
    got = {(r.doc_id, r["query"]) for r in decontam.proximity(docs, {"q": "b a c", "r": "zz", "s": ""}, within=5).collect()}
    assert got == {(1, "q"), (2, "q"), (None, "q")}
    assert decontam.proximity(docs, {"q": "b a c"}, within=5).count() == 4 and decontam.proximity(docs.limit(0), {"q": "a"}, within=5).count() == 0


def test_words_by_regex():
    texts = ["", "a", " a  b", "A-b_c9 é日 x\x00y\x0b z", "end "] * 3
    raw, off = T.text_buffers(pa.array(texts))
    for table, pattern in ((T.SPACE_WORDS, rb"[^\x20\x09-\x0D]+"), (T.ALNUM_WORDS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = T.Words(raw, off, table)
        want = [re.findall(pattern, bytes(T.LOWER[np.frombuffer(t.encode(), np.uint8)])) for t in texts]
        assert [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:])] == want
        assert [T.word_hash(x) for r in want for x in r] == w.hash.tolist()
