"""Linear and logistic regression."""

from .regression import LinearModel, LogisticModel, parse_labeled, train_linear, train_logistic

__all__ = ["LinearModel", "LogisticModel", "parse_labeled", "train_linear", "train_logistic"]
