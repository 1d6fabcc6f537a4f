"""The layout: which columns are folded, their auxiliary columns, and the projections both ways."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.functions.exprs import Target, formula, members, rebuilt, references, switch_of
from colfold.types import quoted

AUX = ("offset", "outlier", "null", "switch")


@dataclass
class Fold:
    """One folded column. aux: stored columns by kind; constants: values of auxiliary columns that had only one;
    bounds: least and largest stored offset."""

    target: str
    model_type: str
    model: dict[str, Any]
    scale: int = 0
    aux: dict[str, str] = field(default_factory=dict)
    constants: dict[str, Any] = field(default_factory=dict)
    bounds: dict[str, list[int]] = field(default_factory=dict)

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_json(data: dict[str, Any]) -> Fold:
        return Fold(**{k: data[k] for k in ("target", "model_type", "model", "scale", "aux", "constants", "bounds") if k in data})


def aux_names(columns: list[str], target: str) -> dict[str, str]:
    """Names of a target's auxiliary columns that clash with none of the table's."""
    taken = {c.lower() for c in columns}
    out = {}
    for kind in AUX:
        name, n = f"{target}_{kind}", 0
        while name.lower() in taken:
            n += 1
            name = f"{target}_{kind}_{n}"
        taken.add(name.lower())
        out[kind] = name
    return out


def new_fold(df: DataFrame, target: str, model_type: str, model: dict[str, Any], scale: int = 0) -> Fold:
    return Fold(target, model_type, model, scale, aux_names(df.columns, target))


def residuals(schema: T.StructType, fold: Fold) -> dict[str, Column]:
    """Expressions of all auxiliary columns from the original columns."""
    target = Target(schema, fold.target, fold.scale)
    value = F.col(quoted(fold.target))
    switch = switch_of(target, fold.model) if len(members(fold.model)) > 1 else None
    line = formula(target, fold.model, switch)
    offset = F.coalesce(target.difference(line), F.lit(0)).cast(target.offset_type)
    exact = target.moved(line, offset).cast(target.kind).eqNullSafe(value)
    out = {"offset": offset, "outlier": F.when(~exact, value), "null": value.isNull()}
    # where an outlier or null stands, the offset says nothing
    out["offset"] = F.when(exact & value.isNotNull(), offset).otherwise(F.lit(0)).cast(target.offset_type)
    if switch is not None:
        out["switch"] = switch
    return out


def layout(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """The base columns and every fold's auxiliary columns, in one projection over one scan."""
    added = [e.alias(f.aux[k]) for f in folds for k, e in residuals(df.schema, f).items()]
    return df.select(*[F.col(quoted(c)) for c in df.columns], *added)


def drop_constants(laid: DataFrame, folds: list[Fold], known: list[dict[str, Any]] | None = None) -> DataFrame:
    """Drop auxiliary columns with one distinct value; the value moves into the fold. One aggregate finds all, and
    the nulls of the columns of a profile ``known``, which it corrects."""
    named = [(f, k, n) for f in folds for k, n in f.aux.items() if n in laid.columns]
    exprs = [F.count("*").alias("n")]
    for i, (_, _, n) in enumerate(named):
        c = F.col(quoted(n))
        exprs += [F.count(c).alias(f"{i}_n"), F.min(c).eqNullSafe(F.max(c)).alias(f"{i}_e"), F.min(c).cast("string").alias(f"{i}_v")]
    offsets = [(f, n) for f, k, n in named if k == "offset"]
    exprs += [g(F.col(quoted(n))).alias(f"{i}_{g.__name__}_o") for i, (_, n) in enumerate(offsets) for g in (F.min, F.max)]
    exprs += [F.count(F.col(quoted(p["name"]))).alias(f"{i}_k") for i, p in enumerate(known or ())]
    row = laid.agg(*exprs).first()
    for i, (f, _) in enumerate(offsets):
        if row[f"{i}_min_o"] is not None:
            f.bounds["offset"] = [row[f"{i}_min_o"], row[f"{i}_max_o"]]
    for i, p in enumerate(known or ()):
        p["null"] = {"any": row[f"{i}_k"] < row["n"], "all": row[f"{i}_k"] == 0}
    gone = []
    for i, (f, k, n) in enumerate(named):
        if row[f"{i}_n"] == 0 or (row[f"{i}_n"] == row["n"] and row[f"{i}_e"]):
            del f.aux[k]
            gone.append(n)
            f.constants[k] = row[f"{i}_v"] if row[f"{i}_n"] else None
    for f in folds:
        f.aux = {k: n for k, n in f.aux.items() if n in laid.columns}
    return laid.drop(*gone)


def fold_frame(df: DataFrame, folds: list[Fold], known: list[dict[str, Any]] | None = None) -> DataFrame:
    """What is stored: targets dropped, auxiliary columns added, constants moved into the folds."""
    return drop_constants(layout(df, folds), folds, known).drop(*[f.target for f in folds]) if folds or known else df


def _stored(fold: Fold, target: Target) -> dict[str, Column | None]:
    kinds = {"offset": target.offset_type, "outlier": target.kind, "null": "boolean", "switch": "short"}
    out: dict[str, Column | None] = {}
    for k in AUX:
        if k in fold.aux:
            out[k] = F.col(quoted(fold.aux[k]))
        elif (v := fold.constants.get(k)) is not None and not (k == "offset" and v == "0") and not (k == "null" and v == "false"):
            out[k] = F.lit(v).cast(kinds[k])
    return out


def ordered(folds: list[Fold]) -> list[Fold]:
    """Folds such that each comes after those of its references."""
    by, done, out = {f.target: f for f in folds}, set(), []

    def visit(f: Fold, path: tuple[str, ...]) -> None:
        if f.target in path:
            raise ValueError(f"folds refer to each other in a circle: {' -> '.join((*path, f.target))}")
        if f.target not in done:
            for r in references(f.model):
                if r in by:
                    visit(by[r], (*path, f.target))
            done.add(f.target)
            out.append(f)

    for f in folds:
        visit(f, ())
    return out


def unfold_frame(stored: DataFrame, folds: list[Fold], schema: T.StructType) -> DataFrame:
    """The original columns in their order. References that are folded themselves come first; the optimizer
    merges the projections and reads only what a query needs."""
    out = stored
    for f in ordered(folds):
        target = Target(schema, f.target, f.scale)
        out = out.withColumn(f.target, rebuilt(target, f.model, _stored(f, target)))
    return out.select(*[F.col(quoted(c)) for c in schema.fieldNames()])
