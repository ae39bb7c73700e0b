import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import gbt, quality, toxicity
from sparkloom.llm import textkit as T


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = gbt.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value):
        n = 0
        while n < len(f):
            n = 2 * n + 1 + (x[5, f[n]] > t[n])
        one += v[n - len(f)]
    assert abs(one - model.margin(x[5:6])[0]) < 1e-12


def test_degenerate_training():
    for y in (np.zeros(0), np.zeros(5), np.ones(5)):
        model = gbt.fit(np.zeros((len(y), 3)), y)
        assert model.probability(np.zeros((2, 3))).shape == (2,)


def test_isotonic_is_monotone_and_exact_on_sorted():
    at, to = gbt.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert np.interp([0.1, 0.2, 0.3, 0.4], at, to).tolist() == [0, 0.5, 0.5, 1]


@pytest.mark.parametrize("query, label, mod, rest", [(quality.query, "quality", 3, 1), (toxicity.query, "toxic", 5, 0)])
def test_held_out_accuracy(spark, query, label, mod, rest):
    folder = "/root/testdata/sf0.1"
    got = query(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert gbt.auc(rows["score"].to_numpy(), rows[label].to_numpy()) > 0.97
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 0, 1), (5, 1, 1), (6, None, 3), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(edge_docs, labels, F.lit(True))
    assert quality.score(edge_docs, model, keep=["doc_id"]).count() == edge_docs.count()
    assert quality.accept(edge_docs, model).columns == edge_docs.columns
    assert quality.accept(no_docs, model).count() == 0
    toxic = toxicity.train(edge_docs, labels, F.lit(True))
    assert toxicity.score(edge_docs, toxic, keep=["doc_id"]).count() == edge_docs.count()
    assert toxicity.score(no_docs, toxic, keep=["doc_id"]).count() == 0
    none = quality.train(no_docs, labels, F.lit(True))
    assert quality.score(edge_docs, none, keep=["doc_id"]).count() == edge_docs.count()


def test_contradictory_labels_do_not_count(spark):
    labels = spark.createDataFrame([(5, 0), (5, 1), (6, 1), (7, 9)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.training_ids(labels, "quality", F.lit(True)).collect()] == [(6, 1)]


def test_disguised_insults_are_seen():
    import pyarrow as pa

    from sparkloom.llm import textkit as T

    raw, off = T.text_buffers(pa.array(["you 1d10t", "you idiot", "a fine day"]))
    x = toxicity.matrix(raw, off, toxicity.Lexicon.empty())
    at = toxicity.NAMES.index
    assert x[0, at("disguised")] > 0 and x[1, at("insult")] > 0 and x[1, at("near")] > 0 and not x[2, at("insult") :].any()


def plain_statistics(text):
    """The statistics of one text, by plain loops."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    low = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, some, size = len(words), max(1, len(words)), max(1, len(b))
    upper, digit = sum(65 <= c <= 90 for c in b), sum(48 <= c <= 57 for c in b)
    letters, high = sum(chr(c).isalpha() and c < 128 for c in b), sum(c >= 128 for c in b)
    blank, stop = sum(c in b" \t\n\v\f\r" for c in b), sum(c in b".,;:!?" for c in b)
    symbol = lambda c: not (chr(c).isalnum() and c < 128) and c < 128 and c not in b" \t\n\v\f\r.,;:!?"
    length = [len(w) for w in words]
    mean = sum(length) / some
    big = [sum(65 <= c <= 90 for c in w) for w in words]
    lines = [x for x in b.split(b"\n") if x]
    grams = [tuple(low[i : i + 3]) for i in range(n - 2)] if n > 3 else []
    return [
        math.log1p(len(b)), math.log1p(n), mean, math.sqrt(max(0, sum(x * x for x in length) / some - mean**2)), math.log1p(max(length, default=0)), upper / max(1, letters), digit / size,
        blank / size, stop / size, sum(map(symbol, b)) / size, high / size, len(set(low)) / some, max(Counter(low).values(), default=0) / some, sum(x == y for x, y in zip(low, low[1:])) / some,
        sum(k >= 2 and 2 * k > x for k, x in zip(big, length)) / some, sum(symbol(w[-1]) for w in words) / some, b.count(b"!") / some, b.count(b"|") / some, len(lines) / some,
        1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0, (len(grams) - len(set(grams))) / len(grams) if grams else 0, sum(x <= 3 for x in length) / some,
        sum(w[-1] in b".!?" for w in words) / some, sum(65 <= w[0] <= 90 and k == 1 for w, k in zip(words, big)) / some, b.count(b"@") / some, b.count(b"?") / some, math.log1p(len(b) / max(1, len(lines))),
    ]


def plain_toxic(text, lexicon):
    """The features of one text beyond its statistics, by plain loops."""
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words, spaced = re.findall(rb"[a-z\x80-\xff]+", b), re.findall(rb"[^\x20\x09-\x0D]+", b)
    insults, seconds = {w.encode() for w in toxicity.INSULTS}, {w.encode() for w in toxicity.SECOND_PERSON}
    parts = [set(p.tolist()) for p in lexicon.parts]
    learnt = [T.word_hash(w) in parts[0] for w in words]
    start = [any(len(w) > k and T.word_hash(w[:k]) ^ 1 in p for k, p in list(zip(toxicity.BEGINNINGS, parts))[1:]) for w in words]
    bad = [w in insults or x or y for w, x, y in zip(words, learnt, start)]
    near = sum(x and any(words[j] in seconds for j in range(max(0, i - toxicity.NEAR), min(len(words), i + toxicity.NEAR + 1))) for i, x in enumerate(bad))
    looks = dict(zip(b"013457@$", b"oieastas"))
    letter = lambda c: 97 <= c <= 122 or c >= 128
    hidden = sum(bytes(x for c in w if letter(x := looks.get(c, c))) in insults for w in spaced)
    mixed = sum(any(48 <= c <= 57 or (c < 128 and not chr(c).isalnum() and c not in b" \t\n\v\f\r.,;:!?") for c in w[1:-1]) and any(map(letter, w)) for w in spaced)
    hits, own, some, k = sum(w in insults for w in words), sum(x or y for x, y in zip(learnt, start)), max(1, len(words)), max(1, len(spaced))
    return [
        hits / some, max(0, hidden - hits) / k, sum(w in seconds for w in words) / some, near / some, mixed / k, sum(learnt) / some, sum(y and not x for x, y in zip(learnt, start)) / some,
        math.log1p(hits + hidden), math.log1p(own),
    ]


def plain_probability(trees, x):
    margin = trees.base
    for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist()):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (x[feature[node]] > threshold[node])
        margin += value[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def test_scores_equal_brute_force(spark, data, edge_docs):
    """Whole tables scored by plain loops over each text, with the model that the queries learn."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, quality.remainder("doc_id", 3) != 1)
    toxic = toxicity.train(docs, labels, quality.remainder("doc_id", 5) != 0)

    def of_toxic(text):
        p = plain_probability(toxic.trees, plain_statistics(text) + plain_toxic(text, toxic.lexicon))
        return 0.98 * float(np.interp(p, toxic.at, toxic.to)) + 0.02 * p

    texts = {r.doc_id: r.text for r in docs.collect()}
    for query, of, mod, rest in ((quality.query, lambda t: plain_probability(model, plain_statistics(t)), 3, 1), (toxicity.query, of_toxic, 5, 0)):
        got = {r.doc_id: r for r in query(spark, data).collect()}
        assert set(got) == set(texts)
        for i, t in texts.items():
            assert abs(got[i].score - of(t)) < 1e-6 and got[i].held_out == (zlib.crc32(str(i).encode()) % mod == rest), i
    clash = toxicity.score(edge_docs, toxic, keep=["doc_id", "text", "score"], name="own")
    assert clash.columns == ["doc_id", "text", "score", "own"] and all(abs(r.own - of_toxic(r.text)) < 1e-6 for r in clash.collect())


def plain_stump(x, y, bins):
    """Feature, threshold and leaves of the best split on the log loss from a constant score, by trying each one."""
    base = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    p = 1 / (1 + math.exp(-base))
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")):
            left = x[:, f] <= edge
            parts = [(float((p - y[m]).sum()), float(m.sum()) * p * (1 - p)) for m in (left, ~left)]
            if min(h for _, h in parts) >= 1.25:
                whole = (sum(g for g, _ in parts), sum(h for _, h in parts))
                gain = sum(g * g / (h + 1) for g, h in parts) - whole[0] ** 2 / (whole[1] + 1)
                if gain > best[0] + 1e-9:
                    best = gain, (f, edge, [-0.15 * g / (h + 1) for g, h in parts])
    return best[1]


def test_splits_equal_brute_force():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=(300, 4)), 1 + seed % 2)
        y = (x[:, seed % 4] + rng.normal(size=300) * 0.5 > 0.2).astype(float)
        model = gbt.fit(x, y, trees=1, depth=1)
        f, edge, leaves = plain_stump(x, y, 48)
        assert model.feature[0, 0] == f and model.threshold[0, 0] == edge and np.allclose(model.value[0], leaves)


def test_an_id_counts_once_and_null_ids_are_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text of {i % 7} words " + "good words. " * (i % 5) + "x|| " * (i % 2)) for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(200)], "doc_id long, quality int, toxic int")
    again = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.limit(1)).withColumn("quality", F.lit("x")).withColumn("y", F.lit(1))
    for train in (quality.train, toxicity.train):
        a, b = (train(d, labels, F.lit(True)) for d in (docs, again))
        a, b = (m.trees if hasattr(m, "trees") else m for m in (a, b))
        assert np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)
    assert quality.labelled(again, labels.select("doc_id", F.col("quality").alias("y"))).count() == 200
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (quality.query, toxicity.query):
        assert [r.held_out for r in query(spark, str(tmp_path)).where("doc_id is null").collect()] == [False]
