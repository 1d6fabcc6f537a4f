"""Models as columns: the formula, the residuals that make it exact, and its reconstruction.

A folded value is ``null`` if flagged, else its outlier if there is one, else formula plus offset. Offsets of
fractional columns count units of the last fraction digit, so that the sum is exact; a row that the formula
and offset do not give back bit for bit is an outlier, whatever the reason (null reference, overflow, NaN).
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.operators.profile import as_double
from colfold.types import category, is_integer, quoted

#: Decimal places that coefficients are rounded to.
PLACES = 4


def tidy(x: float) -> float:
    return round(float(x), PLACES)


def members(model: dict[str, Any]) -> list[dict[str, Any]]:
    """The lines of a model: one, or its k members."""
    return model["config"] if "config" in model else [model]


def references(model: dict[str, Any]) -> list[str]:
    """Columns that a model reads, each once."""
    return list(dict.fromkeys(c["col-name"] for m in members(model) for c in m["coeffs"] if tidy(c["coeff"])))


def _is_long(x: float) -> bool:
    return x.is_integer() and -(2.0**63) <= x < 2.0**63


def _literal(value: float, whole: bool) -> Column:
    return F.lit(int(value)).cast("long") if whole else F.lit(value)


class Target:
    """A column to fold: its type, scale and the types of all columns."""

    def __init__(self, schema: T.StructType, name: str, scale: int = 0):
        self.schema, self.name, self.scale = schema, name, scale
        self.kind = schema[name].dataType
        self.category = category(self.kind)
        self.temporal = self.category in ("date", "timestamp", "time")

    @property
    def offset_type(self) -> str:
        return "int" if self.category == "date" else "long"

    def line(self, member: dict[str, Any]) -> Column:
        """Intercept plus weighted references: in integers where all parts are (null on overflow), else in doubles, which
        are rounded where the target is an integer."""
        if self.temporal:
            return F.col(quoted(member["coeffs"][0]["col-name"]))
        parts = [(tidy(c["coeff"]), c["col-name"]) for c in member["coeffs"] if tidy(c["coeff"])]
        intercept = tidy(member["intercept"])
        whole = is_integer(self.kind) and _is_long(intercept) and all(_is_long(c) and is_integer(self.schema[r].dataType) for c, r in parts)
        terms = []
        for c, r in parts:
            ref = F.col(quoted(r)).cast("long") if whole else as_double(F.col(quoted(r)), self.schema[r].dataType)
            terms.append(ref if c == 1 else F.try_multiply(ref, _literal(c, whole)) if whole else ref * _literal(c, whole))
        if intercept or not terms:
            terms.append(_literal(intercept, whole))
        out = reduce(F.try_add if whole else lambda a, b: a + b, terms)
        return F.floor(out + 0.5) if is_integer(self.kind) and not whole else out

    def units(self, line: Column) -> Column:
        """A line's value as the whole number of units that the target counts in."""
        if self.temporal:
            return line
        if is_integer(self.kind):
            return line
        return F.floor(line.cast("double") * F.lit(float(10**self.scale)) + 0.5)

    def value_units(self) -> Column:
        """The target's own value in units."""
        value = F.col(quoted(self.name))
        if self.temporal:
            return value
        if isinstance(self.kind, T.DecimalType):
            return (value * F.lit(10**self.scale).cast("decimal(38,0)")).try_cast("long") if self.scale else value.try_cast("long")
        return self.units(as_double(value, self.kind)) if not is_integer(self.kind) else value.cast("long")

    def difference(self, line: Column) -> Column:
        """Value less line, in units, days or microseconds."""
        value = self.value_units()
        if self.category == "date":
            return F.date_diff(value, line)
        if self.category == "timestamp":
            return F.timestamp_diff("MICROSECOND", line, value)
        if self.category == "time":
            return F.call_function("time_diff", F.lit("MICROSECOND"), line, value)
        return F.try_subtract(value, self.units(line))

    def moved(self, line: Column, offset: Column | None) -> Column:
        """Line plus offset as a value of the target's type."""
        if self.category == "date":
            return line if offset is None else F.date_add(line, offset)
        if self.category == "timestamp":
            return line if offset is None else F.timestamp_add("MICROSECOND", offset, line)
        if self.category == "time":
            return line if offset is None else line + F.make_dt_interval(secs=(offset / F.lit(1_000_000)).cast("decimal(18,6)"))
        units = self.units(line)
        if offset is not None:
            units = F.try_add(units, offset.cast("long"))
        if isinstance(self.kind, T.DecimalType):
            return (units.cast("decimal(38,0)") / F.lit(10**self.scale).cast("decimal(38,0)")).try_cast(self.kind)
        if is_integer(self.kind):
            return units.try_cast(self.kind)
        return (units.cast("double") / F.lit(float(10**self.scale))).cast(self.kind)


def formula(target: Target, model: dict[str, Any], switch: Column | None = None) -> Column:
    """The line, or the member that ``switch`` names."""
    lines = [target.line(m) for m in members(model)]
    if len(lines) == 1 or switch is None:
        return lines[0]
    out = lines[-1]
    for i in range(len(lines) - 2, -1, -1):
        out = F.when(switch == i, lines[i]).otherwise(out)
    return out


def switch_of(target: Target, model: dict[str, Any]) -> Column:
    """Number of the nearest member, the first of equals; 0 where none has a value."""
    value = as_double(F.col(quoted(target.name)), target.kind)
    off = F.array(*[F.abs(value - target.line(m).cast("double")) for m in members(model)])
    return F.coalesce(F.array_position(off, F.array_min(off)) - 1, F.lit(0)).cast("short")


def rebuilt(target: Target, model: dict[str, Any], aux: dict[str, Column | None]) -> Column:
    """The value from what is stored: aux has columns (or constants) for null, outlier, offset and switch."""
    out = target.moved(formula(target, model, aux.get("switch")), aux.get("offset"))
    if aux.get("outlier") is not None:
        out = F.coalesce(aux["outlier"], out)
    if aux.get("null") is not None:
        out = F.when(aux["null"], F.lit(None)).otherwise(out)
    return out.cast(target.kind)
