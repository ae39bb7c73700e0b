import hashlib
import math
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from sparkloom.llm import license_scan, mixing, sharding, token_count


def shard_brute(rows, shards=16, tolerance=0.02):
    key = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    items = sorted((key((t or "").encode()), key(str(i).encode() if i is not None else b""), len((t or "").encode()) + 1) for i, t in rows)
    total, at, units = sum(x[2] for x in items), 0, []
    groups = Counter()
    for k1, _, s in items:
        groups[k1] += s
    start = {}
    for k1, k2, s in items:
        start.setdefault(k1, at)
        units.append((k1, k2, at, s))
        at += s
    targets = [-(-j * total // shards) for j in range(1, shards)]
    ranges = {}
    for k1, k2, p, s in units:
        if groups[k1] * shards <= tolerance * total:
            p, s = start[k1], groups[k1]
        elif (k1, k2) in ranges:
            continue
        else:
            s = sum(u[3] for u in units if u[:2] == (k1, k2))
        ranges[k1, k2] = sum(2 * t < 2 * p + s for t in targets)
    return lambda i, t: ranges[key((t or "").encode()), key(str(i).encode() if i is not None else b"")]


@pytest.mark.parametrize("hot", [0, 200])
def test_shards_equal_brute_force(spark, edge_docs, no_docs, hot):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(500)] + [(1000 + i, "the same text") for i in range(hot)] + ([(r.doc_id, r.text) for r in edge_docs.collect() if r.doc_id not in (6, 8)] if hot else [])
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    place = shard_brute(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert sharding.assign(no_docs).count() == 0 and sharding.assign(edge_docs).count() == edge_docs.count()


def test_shard_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(200)], "doc_id long, text string")
    sharding.write(docs, str(tmp_path / "out"), shards=4, files=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in sharding.assign(docs, shards=4).collect()}
    assert {(r.doc_id, r.shard) for r in got.collect()} == want


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 1}, {"a": 500, "b": 300, "c": 199, "d": 1}, {c: i + 1 for i, c in enumerate("abcdefghij")}])
def test_schedule_keeps_shares_within_a_block(weights):
    plan = mixing.schedule(weights)
    period = sum(weights.values())
    have = Counter()
    assert [p[4] for p in plan] == list(range(period))
    for s, j, release, deadline, slot in plan:
        assert j == have[s] and release <= slot < deadline
        have[s] += 1
        assert all(abs(have[x] - (slot + 1) * w / period) < 1 for x, w in weights.items())


def test_mix_equals_brute_force(spark, edge_docs, no_docs):
    rows = [(i, "abc"[min(2, i % 7)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_slot", F.lit(-1))
    weights = {"a": 2, "b": 1, "c": 4}
    got = mixing.mix(docs, weights=weights, block_rows=4)
    queues = {s: [d for d, x in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[:15]) if x == s] for s in "abc"}
    want, cycle = [], 0
    while any(queues.values()):
        for s, *_ in mixing.schedule(weights):
            want += queues[s][:4]
            del queues[s][:4]
        cycle += 1
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r.mix_slot)] == want
    assert [r.mix_slot for r in got.collect()] == list(range(900))  # rows lie in that order
    clash = edge_docs.withColumn("mix_slot", F.lit("kept")).withColumn("row", F.lit(1))
    assert mixing.ordered(clash).columns == clash.columns and {r.mix_slot for r in mixing.ordered(clash).collect()} == {"kept"}
    edge = mixing.mix(edge_docs)
    assert sorted(r.mix_slot for r in edge.collect()) == list(range(edge_docs.count())) and mixing.mix(no_docs).count() == 0
    for bad in ({"a": 1}, {"a": 0, "b": 1, "c": 1}):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights=bad)


def test_a_hot_id_is_cut_and_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_TASK", 8)
    monkeypatch.setattr(sharding, "ROWS_A_TASK", 8)
    rows = [(7, prose(i, 3), "a") for i in range(300)] + [(None, prose(i, 3), "ab"[i % 2]) for i in range(300)] + [(i, prose(i, 9), "abc"[i % 3]) for i in range(300)] + [(5, "same", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()
    got = mixing.mix(docs, weights={"a": 2, "b": 4, "c": 2}, block_rows=4)
    assert sorted(r.mix_slot for r in got.collect()) == list(range(len(rows)))
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(rows)
    parts = sharding.assign(docs, shards=3).collect()
    slots = {}
    for r in parts:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = shard_brute([r[:2] for r in rows], 3)
    key = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    by_place = {}
    for i, t, _ in rows:
        by_place.setdefault(place(i, t), []).append((key(str(i).encode() if i is not None else b""), key(t.encode()), i, t))
    want = Counter((i, zlib.crc32(t.encode()), s, k) for s, own in by_place.items() for k, (_, _, i, t) in enumerate(sorted(own, key=lambda x: x[:2])))
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in parts) == want


def test_long_schedules_are_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    assert mixing.mix(docs, weights={"a": 10**9, "b": 10**9}).count() == 2  # as one to one
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"a": 10**8, "b": 1})


def test_shard_files_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 9 else None, prose(i % 50, 20) if i % 7 else None, i, i, i) for i in range(200)], "doc_id long, text string, k1 int, k2 int, part int")
    sharding.write(docs, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError):
        sharding.write(back, str(tmp_path / "again"))


def test_licenses(spark, edge_docs, no_docs):
    texts = [
        "Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", "mit mit und der Mit.",
        "CC BY-NC cc by nc, under the mit license; Apache License Version 2.0", prose(1, 70) + " licensed under the apache license, version 2.0 " + prose(2, 70),
        "this work is licensed under the gnu general public license version 2", "licensed under cc by 4.0", None, "", "...", "under the mit licensee",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].labels for i in range(11)] == ["mit", "gpl-3", "", "apache-2,cc-by-nc,mit", "apache-2", "gpl-2", "cc-by", "", "", "", ""]
    assert [got[i].base_labels for i in (0, 1, 3)] == ["mit", "", "apache-2,cc-by-nc,mit"]
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].n_words) == (4, 0, 10, 15)
    assert (got[0].n_words, got[0].first_word, got[7].n_words, got[7].first_word, got[7].score) == (5, 1, 0, None, 0.0)
    assert license_scan.scan(edge_docs).count() == edge_docs.count() and license_scan.scan(no_docs).count() == 0


def test_licenses_across_lines(spark):
    notices = dict(license_scan.TEMPLATES)
    wrap = lambda text, k: "\n".join(" ".join(text.split()[i : i + k]) for i in range(0, len(text.split()), k))
    mit = license_scan.TEMPLATES[8][1].split()
    texts = [wrap(license_scan.TEMPLATES[8][1], 13), wrap(notices["bsd"], 10), "x\n" + wrap(notices["mpl-2"], 12), f"{prose(1, 200)} " + " one ".join([" ".join(mit[:5]), " ".join(mit[5:11]), " ".join(mit[11:])])]
    texts += [prose(k, k) + " " + wrap(notices["gpl-3"], 5) + "\n" + prose(k, 50) for k in range(16, 60, 3)]  # wherever the notice lies in a block
    texts += ["\n".join(mit[0:8]) + " " + prose(4, 40) + " " + " ".join(mit[8:])]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["mit", "bsd", "mpl-2", "mit"] + ["gpl-3"] * 15 + [""]
    assert [got[i].score for i in (0, 3, len(texts) - 1)] == [1.0, 1.0, 0.0]


def license_brute(text, templates, threshold=0.9):
    """Labels and score of the matches of one text, by looking at every run of every template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    own = [set(n.split()) for _, n in templates]
    fits = set()
    for t, (_, notice) in enumerate(templates):
        for i in range(len(w)):
            run = w[i : i + license_scan.run_words(notice)]
            held = own[t] & set(run)
            if w[i] in own[t] and len(held) >= math.ceil(threshold * len(own[t]) - 1e-9):
                last = max(run.index(x) for x in held)
                if w[i] not in run[1 : last + 1]:
                    fits.add((len(held) / len(own[t]), len(own[t]), -t, frozenset(held), i, i + last + 1))
    inside = lambda f, g: 2 * (min(f[5], g[5]) - max(f[4], g[4])) > f[5] - f[4]
    kept = [f for f in fits if not any(g[2] != f[2] and g[:3] > f[:3] and f[3] <= own[-g[2]] and inside(f, g) for g in fits)]
    return ",".join(sorted({templates[-f[2]][0] for f in kept})), max((f[0] for f in kept), default=0.0)


def test_licenses_equal_brute_force(spark):
    long = (("forty", " ".join(f"w{i}" for i in range(40))), ("lines", "one two three four five six"), ("near", "one two three four five seven"))
    none = (("no such phrase", "none"),)
    texts = [long[0][1], f"{prose(1, 30)} {long[0][1]} {prose(2, 30)}", "one two three\nfour five six", "x" + long[0][1], " ".join(f"w{i}" for i in range(36)), " ".join(f"w{i}" for i in range(35))]
    texts += [" zz ".join(long[0][1].split()), " zz yy ".join(long[0][1].split()), " ".join(reversed(long[0][1].split())), f"{long[1][1]} {long[2][1]}", long[2][1], None, ""]
    notices = [n for _, n in license_scan.TEMPLATES]
    for i, n in enumerate(notices):
        w = n.split()
        texts += [n, "\n".join([prose(i, 9), *(" ".join(w[k : k + 5]) for k in range(0, len(w), 5))]), f"{n} {notices[i - 1]}", " ".join(w[:-1]), " ".join(w[1:] + w[:1]), " ".join(w[: len(w) // 2] + [prose(i, 4)] + w[len(w) // 2 :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for templates in (long, license_scan.TEMPLATES):
        got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs, phrases=none, templates=templates).collect()}
        assert got == {i: license_brute(t, templates) for i, t in enumerate(texts)}
    assert [license_brute(texts[i], long)[0] for i in (0, 1, 2, 4, 5, 6, 7, 9)] == ["forty", "forty", "lines", "forty", "", "forty", "", "lines,near"]


def test_all_notices_of_a_place(spark):
    gpl = "this work is licensed under the gnu general public license version"
    texts = [
        f"licensed under cc by 4.0 or, {gpl} 3", f"{gpl} 2\n{gpl} 3", "licensed under cc by 4.0, licensed under cc by nc 4.0", "Licensed under CC BY-NC 4.0",
        f"{gpl} 3 and version 3 of {gpl} 3", f"released under the mit license {gpl.replace('general', 'lesser general')} 3", f"the version {prose(1, 2)} {gpl} 3",
    ]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=(("no such phrase", "none"),)).collect()}
    assert [got[i] for i in range(len(texts))] == ["cc-by,gpl-3", "gpl-2,gpl-3", "cc-by,cc-by-nc", "cc-by-nc", "gpl-3", "lgpl-3,mit", "gpl-3"]


def test_token_counts_equal_brute_force(edge_docs, no_docs):
    v = token_count.Vocabulary.from_ranks(["▁", "a", "b", "ab", "▁a", "ba", "aba", "é", "▁ab"])
    score = dict(zip(v.pieces, v.scores.tolist()))

    def best(word):
        b = token_count.MARK + word
        way = [(0.0, 0)]
        for i in range(1, len(b) + 1):
            way.append(max((way[i - k][0] + score.get(b[i - k : i], v.byte_score), way[i - k][1] - 1) for k in range(1, min(i, v.longest) + 1) if k == 1 or b[i - k : i] in score))
        return -way[-1][1]

    from sparkloom.llm import textkit as T

    texts = ["", "a", "ab aba", "bababab abaab é xé", "zz a  a\n日本", "ab" * 90]
    raw, off = T.text_buffers(pa.array(texts))
    words, tokens = token_count.Counter(v).counts(raw, off)
    assert words.tolist() == [len(t.split()) for t in texts]
    assert tokens.tolist() == [sum(best(w.encode()) for w in t.split()) for t in texts]
    got = token_count.count_tokens(edge_docs, v)
    assert got.count() == edge_docs.count() and token_count.count_tokens(no_docs, v).count() == 0
    assert {r.n_tokens for r in got.where("doc_id in (2, 3, 4)").collect()} == {0}


def test_scores_of_a_unigram_file_are_taken_as_they_are():
    v = token_count.of_scores(["▁", "a", "ab"], np.array([-1.5, -2.25, -0.5]))
    assert v.scores.tolist() == [-1.5, -2.25, -0.5] and v.byte_score < -2.25
    ranks = token_count.of_scores(["▁", "a", "ab"], np.array([0.0, -1.0, -2.0]))
    assert ranks.scores.tolist() == token_count.Vocabulary.from_ranks(["▁", "a", "ab"]).scores.tolist()


def test_long_runs_are_not_cut(spark):
    import random

    v = token_count.load()
    score = dict(zip(v.pieces, v.scores.tolist()))
    r = random.Random(1)
    joined = ["".join(p.decode(errors="ignore").replace("▁", "") for p in r.sample(v.pieces, 200)) for _ in range(12)] + ["日本語" * 300, "é" * 129, "a" * 253, "a" * 254]

    def best(word):
        b, way = token_count.MARK + word.encode(), [(0.0, 0)]
        for i in range(1, len(b) + 1):
            way.append(max((way[i - k][0] + score.get(b[i - k : i], v.byte_score), way[i - k][1] - 1) for k in range(1, min(i, v.longest) + 1) if k == 1 or b[i - k : i] in score))
        return -way[-1][1]

    texts = [x for x in joined if len(x.split()) == 1]
    texts += [" ".join([texts[0], "short", texts[1]])]
    got = token_count.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v).collect()
    assert sorted(tuple(r) for r in got) == [(i, len(t.split()), sum(map(best, t.split()))) for i, t in enumerate(texts)]
    assert len(texts) > 8


SQL_NAMES = ["op3_embedding_dedup", "op5_ngram_join", "op7_license_scan", "op8_mixing", "op9_sharding", "op10_decontamination"]


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_equals_sql(spark, data, name):
    from oracle import database, rows

    from sparkloom.llm import queries

    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(database(data).sql(queries.ORACLES[name]).df())


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as C

    from sparkloom.llm import decontam, ngram_join, packing, quality

    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r.text for r in docs.collect()}
        if k < len(C.STAGES) - 1:
            assert out.columns == first.columns
            after = {r.doc_id: r.text for r in out.collect()}
            assert after.items() <= before.items()
        if k == 0:
            bad = {r.doc_id for r in quality.query(spark, data).where("predicted = 0").collect()}
            assert set(after) == set(before) - bad and bad
        elif k == 1:
            from test_similarity import brute

            top, _ = brute(list(before.items()), 5, 80)
            assert set(after) == {i for i in before if top[i] == i}
        elif k == 2:
            gone = {r.doc_id for r in decontam.scan(docs, bench).where("n_hit > 0").collect()}
            assert set(after) == set(before) - gone
        elif k == 3:
            assert after == before
        else:
            assert {d for r in out.collect() for d in r.doc_ids} == set(before)
        docs = out
    assert C.run(spark, data).count() == docs.count()


@pytest.mark.parametrize("kind", ["odd", "empty", "unlabelled"])
def test_pipeline_on_odd_tables(spark, data, edge_docs, no_docs, tmp_path, kind):
    """Nulls, repeated rows, clashing columns, empty texts and empty tables in every stage."""
    import corpus_pipeline as C

    docs = {"odd": edge_docs, "empty": no_docs, "unlabelled": edge_docs}[kind].withColumnRenamed("score", "mix_slot").withColumn("n_hit", F.lit("own")).withColumn("key", F.lit(1))
    folder = str(tmp_path / "in")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    (labels.limit(0) if kind == "unlabelled" else labels).write.parquet(f"{folder}/labels.parquet")
    (bench.limit(0) if kind == "unlabelled" else bench).write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
            assert out.where("mix_slot is not null").count() == 0 or {r.mix_slot for r in out.collect()} <= {"x", None}
        docs = out
    assert C.run(spark, folder).count() == docs.count() and (kind == "empty") == (docs.count() == 0)


def test_nothing_else_imports_the_subpackage():
    code = "import sys, sparkloom.plans.queries; sys.exit(any(n.startswith('sparkloom.llm') for n in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0
