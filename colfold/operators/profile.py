"""The schema profile: nulls, precision and scale of every column in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.types import category, is_fractional, quoted

#: Fraction digits that a double column can have and still be folded.
MOST_SCALE = 15


def as_double(column: Column, kind: T.DataType) -> Column:
    """A float by its decimal text, so that 0.1 is 0.1; others as they are."""
    return column.cast("string").cast("double") if isinstance(kind, T.FloatType) else column.cast("double")


def fraction_digits(value: Column) -> Column:
    """The least s up to MOST_SCALE with round(value, s) = value, else MOST_SCALE + 1.

    Doubles tell it while the units can be counted in one (below 2^53), decimals beyond."""
    out = F.lit(MOST_SCALE + 1)
    for s in range(MOST_SCALE, -1, -1):
        units = F.abs(value) * F.lit(float(10**s))
        same = F.when(units < F.lit(float(1 << 53)), F.floor(units + 0.5) / F.lit(float(10**s)) == F.abs(value)).otherwise(F.round(value, s) == value)
        out = F.when(same, s).otherwise(out)
    return out


def integer_digits(value: Column) -> Column:
    """Digits before the point; the fraction goes first, so that 999.9 has three."""
    size = F.abs(value)
    whole = F.when(size < F.lit(float(1 << 53)), F.floor(size).cast("decimal(38,0)")).otherwise(size.cast("decimal(38,0)"))
    return F.length(whole.cast("string"))


def profile(df: DataFrame) -> list[dict]:
    """For each column its name, type, whether any or all values are null, precision and scale."""
    exprs = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        exprs.append(F.count(c).alias(f"{i}_n"))
        if is_fractional(f.dataType) and not isinstance(f.dataType, T.DecimalType):
            v = as_double(c, f.dataType)
            finite = F.when(~F.isnan(v) & (F.abs(v) < 1e30), v)
            exprs += [F.max(fraction_digits(finite)).alias(f"{i}_s"), F.max(integer_digits(finite)).alias(f"{i}_l")]
    row = df.agg(*exprs).first()
    out = []
    for i, f in enumerate(df.schema.fields):
        precision, scale = 0, 0
        if isinstance(f.dataType, T.DecimalType):
            precision, scale = f.dataType.precision, f.dataType.scale
        elif is_fractional(f.dataType):
            scale = row[f"{i}_s"] or 0
            precision = (row[f"{i}_l"] or 0) + scale
        out.append({"name": f.name, "type": f.dataType.simpleString(), "null": {"any": row[f"{i}_n"] < row["n"], "all": row[f"{i}_n"] == 0}, "precision": precision, "scale": scale})
    return out


def distinct_counts(df: DataFrame) -> DataFrame:
    """One row per column: distinct values, a null counting as one more."""
    exprs = [(F.count_distinct(F.col(quoted(c))) + F.coalesce(F.max(F.col(quoted(c)).isNull().cast("long")), F.lit(0))).alias(str(i)) for i, c in enumerate(df.columns)]
    return df.agg(*exprs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("n")) for i, c in enumerate(df.columns)])))


def column_stats(df: DataFrame) -> DataFrame:
    """One row per numeric column: mean, max and min as doubles, in one pass."""
    names = [f.name for f in df.schema.fields if category(f.dataType) == "num"]
    exprs = [g(F.col(quoted(c)).cast("double")).alias(f"{i}_{k}") for i, c in enumerate(names) for k, g in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in ("mean", "max", "min")]) for i, c in enumerate(names)]
    return df.agg(*exprs).select(F.inline(F.array(*rows)))
