"""SQL over folded files: every read_parquet or read_csv call becomes a view on the reconstructed table."""

from __future__ import annotations

import re
import time
import uuid
import warnings
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.functions.exprs import tidy
from colfold.operators.fold import Fold
from colfold.sources.readers import NULL_TOKENS, read_csv, session
from colfold.sources.store import metadata, read_folded
from colfold.types import category, quoted

_TEXT = r"""'(?:[^']|'')*'|"(?:[^"]|"")*\""""
_TOKEN = re.compile(rf"""--[^\n]*|/\*.*?\*/|(?P<call>\bread_(?P<kind>parquet|csv)(?:_auto)?\s*\(\s*(?P<paths>{_TEXT}|\[\s*(?:(?:{_TEXT})\s*,?\s*)*\])(?P<options>(?:\s*,\s*\w+\s*=\s*(?:{_TEXT}|[\w.+-]+))*)\s*\))|{_TEXT}|`(?:[^`]|``)*`""", re.IGNORECASE | re.DOTALL)
_PART = re.compile(_TEXT)
_OPTION = re.compile(rf"(\w+)\s*=\s*({_TEXT}|[\w.+-]+)")
QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
#: Rows of a task that sorts a dealt table.
TASK_ROWS = 500_000


def _content(text: str) -> str:
    return text[1:-1].replace(text[0] * 2, text[0]) if text[:1] in ("'", '"') else text


def _calls(sql: str) -> dict[str, tuple[str, list[str], dict[str, str]]]:
    """Kind, paths and options of every call, by its text; texts and comments are not looked into."""
    out = {}
    for m in _TOKEN.finditer(sql):
        if m["call"]:
            out[m["call"]] = (m["kind"].lower(), [_content(p[0]) for p in _PART.finditer(m["paths"])], {k.lower(): _content(v) for k, v in _OPTION.findall(m["options"] or "")})
    return out


def sources(sql: str) -> list[str]:
    """Paths of all files that a statement reads."""
    return list(dict.fromkeys(p for _, paths, _ in _calls(sql).values() for p in paths))


def rewritten(sql: str, views: dict[str, str]) -> str:
    """``views``: by the text of a call."""
    return _TOKEN.sub(lambda m: views[m["call"]] if m["call"] else m[0], sql)


def _flag(options: dict[str, str], name: str, otherwise: bool) -> bool:
    return options[name].lower() in ("true", "1", "t") if name in options else otherwise


_KNOWN = {"parquet": {"hive_partitioning", "union_by_name"}, "csv": {"delim", "sep", "quote", "header", "nullstr", "all_varchar", "union_by_name"}}


def source(spark: SparkSession, kind: str, paths: list[str], options: dict[str, str], functions: Any = None) -> DataFrame:
    """The table of one call: one path or several, folded or plain ones, with the options of the call for plain ones."""
    if unknown := set(options) - _KNOWN[kind]:
        raise ValueError(f"unknown option of read_{kind}: {', '.join(sorted(unknown))}")
    if not paths:
        raise ValueError(f"read_{kind} has no path")

    def plain(*some: str) -> DataFrame:
        if kind == "csv":
            nulls = (options["nullstr"],) if "nullstr" in options else NULL_TOKENS
            return read_csv(spark, some[0], None, options.get("delim", options.get("sep")), options.get("quote"), _flag(options, "header", True), nulls, _flag(options, "all_varchar", False))
        reader = spark.read.option("mergeSchema", _flag(options, "union_by_name", False))
        return (reader if _flag(options, "hive_partitioning", True) else reader.option("recursiveFileLookup", True)).parquet(*some)

    if len(paths) > 1 and kind == "parquet" and all(metadata(spark, p) is None for p in paths):
        return plain(*paths)
    frames = [read_folded(spark, p, functions, plain) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=_flag(options, "union_by_name", False)), frames)


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` dealt by columns to tasks of about TASK_ROWS rows, however many rows there are; rows of one key stay together.

    The number of tasks is named: adaptive execution merges others until there are few more than cores, so that what a
    window or sort holds in one of them grows with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *map(quoted, columns))


def query(sql: str, functions: Any = None, schema: Any = None, engine: str = "spark", run: bool = True, fancy: bool = True, return_execution_time: bool = False, spark: SparkSession | None = None, deal: list[str] | None = None) -> Any:
    """Run SQL whose tables are calls of read_parquet or read_csv on folded or plain files: a path, a glob or a list, and options.

    Returns a Spark frame (a pandas frame with engine 'pandas'); the rewritten SQL, whose views stay, if ``run`` is
    false; with ``return_execution_time`` also the nanoseconds that the whole result took. Column names are those of
    the original columns whatever ``fancy`` says. ``functions`` may replace what the files say about themselves.
    ``deal`` names the columns that windows are partitioned by: tables that have them are dealt by them to tasks of bounded size.
    """
    if engine not in ("spark", "pandas", "duckdb"):
        raise ValueError(f"unknown engine: {engine}")
    if engine == "duckdb":
        warnings.warn("there is one engine; 'duckdb' runs on Spark", stacklevel=2)
    spark = spark or session()
    views = {}
    for call, (kind, paths, options) in _calls(sql).items():
        views[call] = f"colfold_{uuid.uuid4().hex}"
        table = source(spark, kind, paths, options, functions)
        (dealt(table, deal) if deal and set(deal) <= set(table.columns) else table).createOrReplaceTempView(views[call])
    text = rewritten(sql, views)
    if not run:
        return text
    before = spark.conf.get(QUOTES, "false")
    spark.conf.set(QUOTES, "true")
    try:
        out = spark.sql(text)
    finally:
        spark.conf.set(QUOTES, before)
        for view in views.values():  # the analysed plan has no need of the name
            spark.catalog.dropTempView(view)
    if return_execution_time:
        began = time.time_ns()
        result = out.toPandas() if engine == "pandas" else out
        if engine != "pandas":
            out.write.format("noop").mode("overwrite").save()
        return result, time.time_ns() - began
    return out.toPandas() if engine == "pandas" else out


def where_folded(df: DataFrame, path: str, column: str, op: str, value: Any) -> DataFrame:
    """``df`` filtered by ``column op value``, with the implied filter on the one reference of a line, so that row
    groups can be skipped. The bounds of the stored offsets come from the file's layout. A fold with outliers implies
    nothing; nulls and rounding do no harm, as the column itself is tested too."""
    about = metadata(df.sparkSession, path)
    test = _compared(F.col(quoted(column)), op, value)
    fold = next((Fold.from_json(x) for x in (about or {}).get("functions", []) if x["target"] == column), None)
    if fold is None or "config" in fold.model or len(fold.model["coeffs"]) != 1 or "outlier" in fold.aux or "offset" not in fold.bounds:
        return df.where(test)
    low, high = fold.bounds["offset"]
    ref = F.col(quoted(fold.model["coeffs"][0]["col-name"]))
    kind = category(T.StructType.fromJson(about["struct"])[column].dataType)
    implied = []
    if kind in ("date", "timestamp"):
        moved = lambda n: F.date_add(F.lit(value).cast("date"), -n) if kind == "date" else F.timestamp_add("MICROSECOND", F.lit(-n), F.lit(value).cast(df.schema[column].dataType))
        implied += [ref >= moved(high)] if op in (">", ">=", "=") else []
        implied += [ref <= moved(low)] if op in ("<", "<=", "=") else []
    elif kind == "num" and (a := tidy(fold.model["coeffs"][0]["coeff"])):
        b, unit = tidy(fold.model["intercept"]), 10.0**-fold.scale
        # a unit for rounding, and what doubles of this size may lose
        slack = unit + 1e-9 * max(1.0, abs(float(value)), abs(b), abs(low * unit), abs(high * unit))
        ends = [(">=", (float(value) - b - high * unit - slack) / a)] if op in (">", ">=", "=") else []
        ends += [("<=", (float(value) - b - low * unit + slack) / a)] if op in ("<", "<=", "=") else []
        for side, bound in ends:
            side = side if a > 0 else {">=": "<=", "<=": ">="}[side]
            if category(df.schema[fold.model["coeffs"][0]["col-name"]].dataType) == "num" and not isinstance(df.schema[fold.model["coeffs"][0]["col-name"]].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
                if abs(bound) >= 1 << 53:
                    continue
                bound = int(bound // 1) if side == ">=" else -int(-bound // 1)  # as a whole number the filter reaches the scan
            implied.append(_compared(ref, side, bound))
    for x in implied:
        df = df.where(x)
    return df.where(test)


def _compared(column: Column, op: str, value: Any) -> Column:
    tests = {"=": column == value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}
    return tests[op]
