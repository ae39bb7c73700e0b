"""Pipelines that come with the library; also acceptance checks of an installation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as O
from .. import sources as S
from .pipelines import register
from .workloads import word_count

LINES = ("hello world", "hello spark", "world spark hello")


NUMBERS = "numbers"


@register(NUMBERS)
def numbers(spark, params):
    """Even numbers up to ten, those over params["above"] only."""
    return O.filter_rows(S.make_range(spark, 1, 11), (F.col("id") % 2 == 0) & (F.col("id") > int(params.get("above", "0"))))


@register("join")
def join(spark, params):
    names = S.from_rows(spark, [(1, "one"), (2, "two"), (3, "three")], "k long, name string")
    amounts = S.from_rows(spark, [(1, 10), (1, 11), (2, 20), (4, 40)], "k long, amount long")
    return O.join(names, amounts, "k")


@register("wordcount")
def wordcount(spark, params):
    lines = S.text_file(spark, params["input"]) if "input" in params else S.from_rows(spark, [(x,) for x in LINES], "value string")
    return word_count(lines, "value")


@register("wordcount-lines")
def wordcount_lines(spark, params):
    return wordcount(spark, params).select(S.text.line("word", "n").alias("value"))


@register("broadcast")
def broadcast(spark, params):
    weights = S.from_rows(spark, [("a", 3), ("b", 5)], "w string, weight long")
    return O.broadcast_lookup(S.from_rows(spark, [("a",), ("b",), ("missing",)], "w string"), weights, "w", {"weight": F.lit(0)})


@register("sort")
def sort(spark, params):
    rows = S.from_rows(spark, [(127 - i, 10 * (127 - i)) for i in range(128)], "k long, v long", 4)
    return O.sort_by_key(rows, "k", ascending=params.get("order", "up") == "up")
