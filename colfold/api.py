"""train, to_format, from_format, query, and the helpers around them."""

from __future__ import annotations

import json
import os
import time
from pathlib import PurePath
from statistics import mean
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colfold.operators.choose import estimate, optimize
from colfold.operators.drill import numeric_candidates, temporal_candidates, wants
from colfold.operators.fold import Fold, fold_frame, new_fold, unfold_frame
from colfold.operators.profile import MOST_SCALE, profile
from colfold.plans.sqlfront import query, where_folded
from colfold.sources.readers import head_sample, read, session, suffix
from colfold.sources.store import metadata, read_folded, write
from colfold.sources.workdir import folder_bytes, new_path
from colfold.types import category, is_fractional, quoted

__all__ = ["benchmark", "from_format", "functions_to_json", "generate_schema", "get_functions_from_json", "get_metadata_from_file", "query", "to_format", "train", "where_folded"]

DEFAULT_TYPES = ("sparse-lr", "custom")


def _dump(prefix: str | None, data: Any, component: str, content: Any) -> None:
    if prefix is not None:
        name = f"{component}_{PurePath(str(data)).name}.json" if isinstance(data, (str, PurePath)) else f"{component}.json"
        functions_to_json(content, os.path.join(prefix, name))


def _schema(schema: Any) -> Any:
    return get_functions_from_json(schema) if isinstance(schema, (str, os.PathLike)) else schema


def generate_schema(data: Any, nrows: int | None = None) -> list[dict]:
    """The profile: name, type, nulls, precision and scale of every column."""
    return profile(read(data, nrows))


def train(data: Any, nrows: int | None = None, sample_size: int = 10_000, model_types: Any = DEFAULT_TYPES, schema: Any = None, prefix: str | None = None) -> list[dict]:
    """Candidate functions between the columns of ``data``, found on a bounded, repeatable sample."""
    df = read(data, nrows)
    types = None if model_types is None else list(model_types)
    functions = numeric_candidates(df, sample_size, types)
    if types is None or any(t.startswith("custom") for t in types):
        functions += temporal_candidates(df)
    _dump(prefix, data, "driller", functions)
    return functions


def _foldable(df: DataFrame, functions: list[dict], known: list[dict], types: list[str] | None) -> list[dict]:
    """Candidates whose target can be given back exactly: not null throughout, few enough fraction digits."""
    by = {p["name"]: p for p in known}
    out = []
    for c in functions:
        p, kind = by[c["target-name"]], df.schema[c["target-name"]].dataType
        if p["null"]["all"] or (is_fractional(kind) and (p["scale"] > MOST_SCALE or p["precision"] > 18)):
            continue
        models = {n: m for n, m in c["models"].items() if wants(types, n)}
        if models:
            out.append({**c, "models": models})
    return out


def fold(data: Any, functions: list[dict] | None = None, schema: Any = None, nrows: int | None = None, model_types: Any = DEFAULT_TYPES, prefix: str | None = None) -> tuple[DataFrame, list[Fold], DataFrame, list[dict]]:
    """The stored frame, its folds, the original frame and its profile."""
    df = read(data, nrows)
    # scales come from a sample: rows with more digits become outliers; the pass that finds constants counts the nulls of all rows
    known = _schema(schema) or profile(head_sample(df))
    types = None if model_types is None else list(model_types)
    if functions is None:
        functions = train(df, model_types=types, prefix=None)
        _dump(prefix, data, "driller", functions)
    scales = {p["name"]: p["scale"] for p in known}
    candidates = estimate(df, _foldable(df, functions, known, types), scales)
    _dump(prefix, data, "estimates", candidates)
    layout = optimize(candidates)
    _dump(prefix, data, "layout", layout)
    folds = [new_fold(df, e["target-name"], e["model-type"], e[e["model-type"]], scales[e["target-name"]] if category(df.schema[e["target-name"]].dataType) == "num" else 0) for e in layout["greedy"]["chosen"]]
    stored = fold_frame(df, folds, known)
    _dump(prefix, data, "schema", known)
    return stored, folds, df, known


def to_format(data: Any, format_path: str, functions: list[dict] | None = None, schema: Any = None, nrows: int | None = None, model_types: Any = DEFAULT_TYPES, prefix: str | None = None, enforce_base: str | None = None) -> list[Fold]:
    """Profile, search, choose and write ``data`` folded, as Parquet or CSV. Returns the folds. ``enforce_base`` names a Parquet folder for the plain table."""
    kind = suffix(format_path)
    if kind not in ("parquet", "csv", "btrblocks"):
        raise ValueError(f"unsupported format: {kind}")
    if kind == "btrblocks":
        raise NotImplementedError("BtrBlocks needs an external encoder; write Parquet or CSV")
    stored, folds, df, known = fold(data, functions, schema, nrows, model_types, prefix)
    write(stored, str(format_path), folds, df.schema, known)
    if enforce_base is not None:
        df.write.mode("overwrite").option("compression", "snappy").parquet(str(enforce_base))
    return folds


def from_format(format_path: str, functions: Any = None, schema: Any = None, spark: SparkSession | None = None) -> DataFrame:
    """The original table, columns in their order, as a lazy frame."""
    if suffix(format_path) not in ("parquet", "csv"):
        raise ValueError(f"unsupported format: {suffix(format_path)}")
    return read_folded(spark or session(), str(format_path), _schema(functions))


def functions_to_json(functions: Any, path: str) -> None:
    with open(path, "w") as f:
        json.dump([x.to_json() for x in functions] if functions and isinstance(functions, list) and isinstance(functions[0], Fold) else functions, f)


def get_functions_from_json(path: str) -> Any:
    with open(path) as f:
        return json.load(f)


def get_metadata_from_file(format_type: str, path: str, keys: list[str] | None = None) -> dict[str, Any]:
    """Any of schema, functions and header of a folded Parquet or CSV file."""
    if format_type not in ("parquet", "csv"):
        raise ValueError(f"unsupported format: {format_type}")
    about = metadata(session(), path) or {}
    return {k: about.get(k) for k in (keys or ["schema", "functions", "header"])}


def _seconds(action, runs: int) -> float:
    took = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return mean(took[1:])


def column_sums(df: DataFrame) -> DataFrame:
    """Sum of every numeric column, in one pass."""
    return df.agg(*[F.sum(F.col(quoted(f.name))).alias(f.name) for f in df.schema.fields if category(f.dataType) == "num"])


def _written_bytes(df: DataFrame) -> int:
    """Bytes of a frame as a folder of Snappy Parquet files in the shared folder."""
    path = new_path(df.sparkSession, "size")
    df.write.option("compression", "snappy").parquet(path)
    return folder_bytes(df.sparkSession, path)


def benchmark(bench_type: str, data: Any, schema: Any = None, layout: Any = None, optimize_layout: bool = True, nrows: int | None = None, runs: int = 10, rows: int = 1_000_000) -> dict[str, Any]:
    """size: bytes of plain and folded Snappy Parquet; latency: mean milliseconds of each column's sum, after a warm-up, on replicated rows."""
    stored, folds, df, _ = fold(data, layout, schema, nrows)
    if bench_type == "size":
        return {"base": _written_bytes(df), "folded": _written_bytes(stored)}
    if bench_type != "latency":
        raise ValueError(f"unknown benchmark: {bench_type}")
    times = -(-rows // max(1, df.count()))
    wide = lambda d: d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy").limit(rows).cache()
    plain, small = wide(df), wide(stored)
    view = unfold_frame(small, folds, df.schema)
    return {f.name: {"base": 1e3 * _seconds(lambda c=f.name: plain.agg(F.sum(quoted(c))).collect(), runs), "folded": 1e3 * _seconds(lambda c=f.name: view.agg(F.sum(quoted(c))).collect(), runs)} for f in df.schema.fields if category(f.dataType) == "num"}
