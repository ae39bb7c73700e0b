"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A run of a text matches a template if it holds at least ``threshold`` of the template's distinct words.  A template's
runs are of twice as many consecutive words as its notice has (a multiple of ``ROUND``), across lines, and start at any
word of the template, so that all blocks that reach the threshold are found, however a notice is wrapped.

One pass over the texts counts words, finds phrases, and keeps the words of those texts only that hold enough words of some
template at all.  Template words are then ordered by their document counts over all texts, the rarest first.  An
equi-join gives the places of template words.  A run is a candidate if it holds one of the first words of the
template, of which any match must hold one (prefix filter), has enough template words (length filter) and
enough of the template is left from its rarest word on (positional filter); the rest is verified on the sets.  All of it
is DataFrame expressions; templates are parameters, so what goes to all tasks is as large as they are.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Phrase, label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Label, notice: short forms first, then what the licenses ask to be put into files.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
ROUND = 8
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z only; lower() agrees but for the two signs whose lower case has an ASCII letter."""
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _normal(text: Column) -> Column:
    """The words, each between single blanks: ' a b '; of no words a single blank."""
    words = F.regexp_replace(text, _NOT_WORD, " ")
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), "^ +| +$", " ")


def _blanks(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def run_words(notice: str) -> int:
    """Words of the runs that are compared with a notice."""
    return -(-2 * len(notice.split()) // ROUND) * ROUND


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    n_base: places of a phrase; first_word, last_word: smallest and largest start of one, in words from 0; base_labels:
    labels of phrases; labels: those and the labels of matches, sorted and comma-joined.  A match reaches from the first to the
    last of its words, and is none if its first word stands in it again.  It is explained, and gives no label, if another
    template holds all its words and has a better match over most of its stretch: with a larger part of that template, of
    equal parts the larger template, then the first.  score: 1 with a phrase, else the largest part of a match that isn't
    explained, else 0.  Null, empty and wordless texts have zeros, nulls and empty labels.  A row's result depends on its text alone; ids may be null or repeated; other columns play no part; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    need = [math.ceil(threshold * len(set(notice.split())) - 1e-9) for _, notice in templates]
    span = math.lcm(*map(run_words, (t for _, t in templates))) if templates else 1
    if span > 1 << 31:
        raise ValueError("the templates' lengths have too large a common multiple")

    low = docs.select(F.col(doc_id).alias("doc_id"), _lowered(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    base = low.select("doc_id", F.md5(F.col("low").cast("binary")).alias("key"), _normal(F.col("low")).alias("s"))
    places, starts, ends, labels = F.lit(0), [], [], []
    for phrase, label in phrases:
        k = len(phrase.split())
        has = F.col("s").contains(f" {phrase} ")
        parts = F.split(F.col("s"), f"(?<= ){phrase}(?= )", -1)
        places = places + F.when(has, F.size(parts) - 1).otherwise(0)
        starts.append(F.when(has, _blanks(F.get(parts, F.lit(0))) - 1))
        ends.append(F.when(has, _blanks(F.col("s")) - 1 - k - (_blanks(F.element_at(parts, -1)) - 1)))
        labels.append(F.when(has, F.lit(label)))
    present = F.array_intersect(F.split(F.trim("s"), " "), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    base = base.select(
        "doc_id", "key", "s", (_blanks(F.col("s")) - 1).cast("long").alias("n_words"), places.cast("long").alias("n_base"),
        F.least(*starts, F.lit(None), F.lit(None)).cast("long").alias("first_word"), F.greatest(*ends, F.lit(None), F.lit(None)).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*labels).cast("array<string>"))).alias("base"), present.alias("present"),
    )
    enough = F.lit(False)
    for (_, notice), least in zip(templates, need, strict=True):
        enough = enough | (F.size(F.array_intersect("present", F.array(*map(F.lit, sorted(set(notice.split())))))) >= least)
    base = cut(base.withColumn("s", F.when(enough, F.col("s"))))

    counts = {r["w"]: r["n"] for r in base.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row a template word
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets, words = [], []
    for number, ((label, notice), least) in enumerate(zip(templates, need, strict=True)):
        own = sorted({rank[w] for w in notice.split()})
        sets.append({"t": number, "own": own})
        by_rank = {rank[w]: w for w in notice.split()}
        words += [{"w": by_rank[r], "t": number, "label": label, "r": r, "p": p, "n": len(own), "need": least, "step": span // run_words(notice)} for p, r in enumerate(own)]
    word_table = _table(spark, words, "w: string, t: int, label: string, r: int, p: int, n: int, need: int, step: long")

    # Rows with one text share their places, so each text stands once.
    places = base.where("s is not null").select("key", "s").dropDuplicates(["key"]).select("key", F.posexplode(F.split(F.trim("s"), " ")).alias("pos", "w"))
    places = places.join(F.broadcast(word_table), "w").withColumn("at", F.col("pos") * F.col("step"))  # a run of any template spans as much of this scale
    of_text = Window.partitionBy("key", "t").orderBy("at")
    run, back = of_text.rangeBetween(0, span - 1), of_text.rangeBetween(1 - span, 0)
    rarest, found = F.min("p").over(run), F.count("*").over(run)
    places = places.withColumn("may", (rarest <= F.col("n") - F.col("need")) & (1 + F.least(F.col("n") - rarest - 1, found - 1) >= F.col("need")))
    places = places.withColumn("used", F.max("may").over(back)).where("used")
    # The words of a run, the first of each only; a match ends with the last of them.
    all_words = F.collect_list(F.struct("pos", "r")).over(run)
    places = places.withColumn("words", F.when(F.col("may"), all_words)).where("may").withColumn("held", F.array_sort(F.array_distinct(F.col("words.r"))))
    last = F.array_max(F.transform("held", lambda r: F.array_min(F.transform(F.filter("words", lambda x: x["r"] == r), lambda x: x["pos"]))))
    matches = places.where(F.size("held") >= F.col("need")).withColumn("last", last)
    matches = matches.where(~F.exists("words", lambda x: (x["r"] == F.col("r")) & (x["pos"] > F.col("pos")) & (x["pos"] <= F.col("last"))))

    all_sets = F.from_json(F.lit(json.dumps(sets)), "array<struct<t: int, own: array<int>>>")
    holders = F.transform(F.filter(all_sets, lambda y: (y["t"] != F.col("t")) & (F.size(F.array_except("held", y["own"])) == 0)), lambda y: y["t"])
    rank_of = F.struct((F.size("held") / F.col("n")).alias("part"), F.col("n").alias("n"), (-F.col("t")).alias("t"))
    matches = matches.select("key", "label", rank_of.alias("rank"), holders.alias("holders"), F.col("pos").cast("long").alias("a"), (F.col("last") + 1).cast("long").alias("b"))
    widest = max((run_words(t) for _, t in templates), default=0)
    around = F.collect_set(F.struct("rank", "a", "b")).over(Window.partitionBy("key").orderBy("a").rangeBetween(-widest, widest))

    def explains(y: Column) -> Column:
        inside = F.least(F.col("b"), y["b"]) - F.greatest(F.col("a"), y["a"])
        return F.array_contains("holders", -y["rank"]["t"]) & (y["rank"] > F.col("rank")) & (2 * inside > F.col("b") - F.col("a"))

    kept = matches.withColumn("near", around).where(~F.exists("near", explains))
    more = kept.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("rank.part").alias("part"))  # at most as many labels as there are
    none = F.array().cast("array<string>")
    plain = base.where("s is null").drop("s", "present").withColumn("more", none).withColumn("part", F.lit(None).cast("double"))
    got = plain.unionByName(base.where("s is not null").drop("s", "present").join(more, "key", "left"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return got.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({i}, '{label}', string_split('{notice}', ' '), {run_words(notice)})" for i, (label, notice) in enumerate(TEMPLATES))
_PHRASE_VALUES = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES)
SQL = rf"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS s FROM documents
), d AS (
  SELECT rid, doc_id, s, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
), phrase(p, label, k) AS (VALUES {_PHRASE_VALUES}
), place AS (
  SELECT rid, label, i - 1 AS at_word FROM (SELECT rid, w, p, label, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, phrase WHERE len(w) >= k AND contains(s, split_part(p, ' ', 1)))
  WHERE array_to_string(w[i:i + k - 1], ' ') = p
), base AS (
  SELECT rid, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY rid
), template(t, label, own, run) AS (SELECT t, label, list_distinct(own), run FROM (VALUES {_VALUES}) AS v(t, label, own, run)
), may AS (
  SELECT rid, t FROM d, template WHERE len(list_intersect(own, list_distinct(w))) >= ceil(0.9 * len(own) - 1e-9)
), start AS (
  SELECT rid, t, label, own, i, w[i:i + run - 1] AS b FROM (SELECT rid, t, label, own, run, w, unnest(range(1, len(w) + 1)) AS i FROM may JOIN d USING (rid) JOIN template USING (t)) WHERE list_contains(own, w[i])
), part AS (
  SELECT rid, t, label, len(own) AS size, list_intersect(own, b) AS held, i, b, list_max(list_transform(list_intersect(own, b), lambda x: list_position(b, x))) AS k FROM start
), fit AS (
  SELECT rid, t, label, held, [len(held) / size, size, -t] AS rank, i AS lo, i + k AS hi FROM part WHERE len(held) >= ceil(0.9 * size - 1e-9) AND NOT list_contains(b[2:k], b[1])
), kept AS (
  SELECT * FROM fit x WHERE NOT EXISTS (
    SELECT 1 FROM fit y JOIN template z ON z.t = y.t WHERE y.rid = x.rid AND y.t <> x.t AND y.rank > x.rank AND list_has_all(z.own, x.held) AND 2 * (least(x.hi, y.hi) - greatest(x.lo, y.lo)) > x.hi - x.lo)
), more AS (SELECT rid, list(DISTINCT label) AS labels, max(rank[1]) AS part FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""
