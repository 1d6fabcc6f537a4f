"""Column categories by Spark type."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORIES = ("num", "date", "timestamp", "time", "string", "boolean", "other")


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))


def category(kind: T.DataType) -> str:
    """Category of a type; nested and other types pass through as ``other``."""
    if is_integer(kind) or is_fractional(kind):
        return "num"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if type(kind).__name__ == "TimeType":
        return "time"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "boolean" if isinstance(kind, T.BooleanType) else "other"


def classify(schema: T.StructType) -> dict[str, list[str]]:
    """Column names by category."""
    out: dict[str, list[str]] = {c: [] for c in CATEGORIES}
    for field in schema.fields:
        out[category(field.dataType)].append(field.name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
