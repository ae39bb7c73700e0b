"""Linear and logistic regression on (label double, features array<double>).

Training is Spark's; what it accepts silently and shouldn't (no rows, ragged or constant features, labels
but 0 and 1) is checked first, in two passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FEATURES = 4096


def parse_labeled(lines: DataFrame, column: str = "value") -> DataFrame:
    """label and features of lines 'label f1 f2 ...'; blank lines are skipped, a line without a feature fails the job."""
    parts = F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda x: x != "")
    rows = lines.select(parts.alias("p")).where(F.size("p") > 0)
    rows = rows.withColumn("p", F.when(F.size("p") < 2, F.raise_error(F.lit("a line needs a label and a feature"))).otherwise(F.col("p")))
    return rows.select(F.get("p", F.lit(0)).cast("double").alias("label"), F.slice("p", 2, MAX_FEATURES + 1).cast("array<double>").alias("features"))


def _checked(df: DataFrame, binary: bool) -> DataFrame:
    s = df.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.count_if(~F.col("label").isin(0.0, 1.0)).alias("odd")).first()
    if not s["n"]:
        raise ValueError("no rows")
    if s["low"] != s["high"]:
        raise ValueError("rows differ in their number of features")
    if not 1 <= s["high"] <= MAX_FEATURES:
        raise ValueError(f"1 to {MAX_FEATURES} features are allowed")
    if binary and s["odd"]:
        raise ValueError("labels must be 0 or 1")
    ready = df.select("label", array_to_vector("features").alias("features"))
    spread = ready.select(Summarizer.metrics("min", "max").summary(F.col("features")).alias("s")).first()["s"]  # one pass, whatever the number of features
    if any(low == high for low, high in zip(spread["min"], spread["max"], strict=True)):
        raise ValueError("singular training matrix: a feature is constant")
    return ready


def _dot(weights: list[float], x: list[float], intercept: float) -> float:
    if len(x) != len(weights):
        raise ValueError(f"{len(weights)} features are needed")
    return intercept + math.fsum(a * b for a, b in zip(weights, x, strict=True))


@dataclass(frozen=True)
class LinearModel:
    weights: list[float]
    intercept: float

    def predict(self, x: list[float]) -> float:
        return _dot(self.weights, x, self.intercept)

    def column(self, features: str = "features"):
        terms = F.zip_with(F.col(features), F.array(*map(F.lit, self.weights)), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(self.intercept), lambda s, t: s + t)


@dataclass(frozen=True)
class LogisticModel(LinearModel):
    def probability(self, x: list[float]) -> float:
        z = _dot(self.weights, x, self.intercept)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

    def predict(self, x: list[float]) -> float:
        """1 from a probability of one half on."""
        return float(self.probability(x) >= 0.5)


def train_linear(df: DataFrame, *, iterations: int = 100, l2: float = 0.0, intercept: bool = True) -> LinearModel:
    model = LinearRegression(maxIter=iterations, regParam=l2, fitIntercept=intercept, solver="l-bfgs", standardization=True, tol=1e-10).fit(_checked(df, False))
    return LinearModel([float(w) for w in model.coefficients], float(model.intercept))


def train_logistic(df: DataFrame, *, iterations: int = 100, l2: float = 0.0, intercept: bool = True) -> LogisticModel:
    model = LogisticRegression(maxIter=iterations, regParam=l2, fitIntercept=intercept, family="binomial", tol=1e-10).fit(_checked(df, True))
    return LogisticModel([float(w) for w in model.coefficients], float(model.intercept))
