"""Column functions and guards."""

from .columns import byte_length, fields, nan_free, strip_marks, within

__all__ = ["byte_length", "fields", "nan_free", "strip_marks", "within"]
