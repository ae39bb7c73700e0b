"""Registered pipelines: a name and a function from (spark, params) to a frame, run with a registered action.

A pipeline may use reductions of its inputs in later expressions: reduction() is a scalar subquery of the same
lazy plan, so it is computed once, on the cluster, and is an error over no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cancellable
from ..sources import commit

Build = Callable[[SparkSession, dict[str, str]], DataFrame]
_REGISTRY: dict[str, Build] = {}


def register(name: str, build: Build | None = None):
    """Adds a pipeline; usable as a decorator.  A name can't be taken twice."""

    def add(f: Build) -> Build:
        if name in _REGISTRY:
            raise ValueError(f"pipeline {name} is registered already")
        _REGISTRY[name] = f
        return f

    return add(build) if build else add


def names() -> list[str]:
    return sorted(_REGISTRY)


def plan(spark: SparkSession, name: str, **params: str) -> DataFrame:
    if name not in _REGISTRY:
        raise KeyError(f"no pipeline {name}; there are {', '.join(names())}")
    return _REGISTRY[name](spark, params)


Action = Callable[[DataFrame, "JobSpec"], object]
_ACTIONS: dict[str, Action] = {}


@dataclass(frozen=True)
class JobSpec:
    """What is to be run: a pipeline, an action, their parameters; ``partitions``: of shuffles, 0 for the session's."""

    name: str
    action: str = "collect"
    params: dict[str, str] = field(default_factory=dict)
    partitions: int = 0


def register_action(name: str, action: Action | None = None):
    """Adds an action: a function from (frame, spec) to its result; usable as a decorator.  A name can't be taken twice."""

    def add(f: Action) -> Action:
        if name in _ACTIONS:
            raise ValueError(f"action {name} is registered already")
        _ACTIONS[name] = f
        return f

    return add(action) if action else add


def get_action(name: str) -> Action:
    if name not in _ACTIONS:
        raise ValueError(f"no action {name}; there are {', '.join(actions())}")
    return _ACTIONS[name]


def actions() -> list[str]:
    return sorted(_ACTIONS)


def register_reduction(name: str, agg: Column, *, zero: object = None) -> None:
    """Adds an action that gives an aggregate of all rows, with partial sums on the executors; ``zero`` over no rows."""

    def result(df: DataFrame, spec: JobSpec) -> object:
        row = df.agg(F.count("*").alias("n"), agg.alias("value")).first()
        return row["value"] if row["n"] else zero

    register_action(name, result)


@register_action("collect")
def _collect(df: DataFrame, spec: JobSpec) -> object:
    return df.collect()


@register_action("count")
def _count(df: DataFrame, spec: JobSpec) -> object:
    return df.count()


@register_action("save")
def _save(df: DataFrame, spec: JobSpec) -> object:
    if "path" not in spec.params:
        raise ValueError("save needs a path")
    return commit(df, spec.params["path"], job=spec.name)


@dataclass(frozen=True)
class JobPlan:
    spec: JobSpec
    schema: str
    fingerprint: str


def fingerprint(df: DataFrame, spec: JobSpec | None = None) -> str:
    """SHA-256 of the analysed plan, with expression numbers taken out, and of the spec: the same on every driver that builds the same job."""
    text = df._jdf.queryExecution().analyzed().canonicalized().toString()
    for pattern, to in ((r"#\d+L?", "#"), (r"plan_id=\d+", ""), (r"\[id=#?\d*\]", ""), (r"@[0-9a-f]{5,}", "@")):
        text = re.sub(pattern, to, text)
    head = json.dumps([spec.name, spec.action, sorted(spec.params.items()), spec.partitions]) if spec else ""
    return hashlib.sha256(f"{head}\n{df.schema.simpleString()}\n{text}".encode()).hexdigest()


def plan_job(spark: SparkSession, spec: JobSpec) -> JobPlan:
    """The job's plan, without running it."""
    get_action(spec.action)
    df = plan(spark, spec.name, **spec.params)
    return JobPlan(spec, df.schema.simpleString(), fingerprint(df, spec))


def verify_plan(spark: SparkSession, expected: JobPlan, spec: JobSpec) -> None:
    """An error if the spec gives another plan than the expected one."""
    got = plan_job(spark, spec)
    if got.fingerprint != expected.fingerprint:
        raise ValueError(f"plan fingerprint {got.fingerprint} differs from {expected.fingerprint}")


def run_job(spark: SparkSession, spec: JobSpec, *, seconds: float | None = None) -> object:
    """The action's result; jobs that take longer than ``seconds`` are cancelled and raise."""
    action = get_action(spec.action)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if spec.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(spec.partitions))
    try:
        with cancellable(spark, f"job-{uuid.uuid4().hex}", seconds=seconds):
            return action(plan(spark, spec.name, **spec.params), spec)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark: SparkSession, name: str, action: str = "collect", **params: str):
    """collect: rows; count: their number; save: the manifest of the output at params["path"]; or a registered action."""
    return run_job(spark, JobSpec(name, action, params))


def reduction(df: DataFrame, agg: Column) -> Column:
    """The aggregate of all rows, for use in expressions over any frame; no rows fail the job."""
    checked = F.when(F.count("*") == 0, F.raise_error(F.lit("reduction of no rows"))).otherwise(agg)
    return df.agg(checked.alias("value")).scalar()


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    return a.sameSemantics(b)
