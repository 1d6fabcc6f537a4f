"""Folded files: Parquet with the layout in column metadata, CSV with JSON sidecars."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.operators.fold import Fold, unfold_frame
from colfold.sources.readers import suffix
from colfold.types import category, quoted

KEY = "colfold"
#: Stored instead, if all columns of a table are folded into constants.
DUMMY = "dummy_column"
#: Null in a folded CSV file. A text of this and backslashes before it gets one backslash more.
NULL = "NULL"
_CSV = {"header": True, "sep": ",", "quote": '"', "escape": '"', "lineSep": "\n", "nullValue": NULL, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_ZONED = "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def sidecar(path: str, what: str) -> str:
    return f"{str(path).rstrip('/').removesuffix('.csv')}-{what}.json"


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def _has_text(schema: T.StructType) -> bool:
    return any(category(f.dataType) in ("string", "other") for f in schema.fields)


def to_texts(df: DataFrame) -> DataFrame:
    """Every column as a text that ``from_texts`` gives back exactly."""
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, _ZONED)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif _nested(f.dataType):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        out.append(_escaped(c, f.dataType).alias(f.name))
    return df.select(*out)


def _escaped(text: Column, kind: T.DataType) -> Column:
    if category(kind) != "string":
        return text
    return F.when(text.rlike(rf"^\\*{NULL}\z"), F.concat(F.lit("\\"), text)).otherwise(text)


def from_texts(raw: DataFrame, schema: T.StructType) -> DataFrame:
    out = []
    for f in schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(c)
        elif _nested(f.dataType):
            c = F.from_json(c, f.dataType)
        elif category(f.dataType) == "string":
            c = F.when(c.rlike(rf"^\\+{NULL}\z"), F.substring(c, 2, 2**31 - 1)).otherwise(c)
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return raw.select(*out)


def write(stored: DataFrame, path: str, folds: list[Fold], schema: T.StructType, profile: list[dict[str, Any]]) -> None:
    """Write a folded frame. ``schema`` is that of the original table."""
    kind, spark = suffix(path), stored.sparkSession
    about = {"functions": [f.to_json() for f in folds], "schema": profile, "struct": schema.jsonValue()}
    if not stored.columns:
        stored = stored.select(F.lit(1).alias(DUMMY))
    if kind == "parquet":
        first = stored.columns[0]
        old = stored.schema[first].metadata
        stored.withMetadata(first, {**old, KEY: json.dumps(about)}).write.mode("overwrite").option("compression", "snappy").parquet(path)
    elif kind == "csv":
        to_texts(stored).write.mode("overwrite").options(**_CSV, quoteAll=_has_text(stored.schema), emptyValue="").csv(path)
        write_text(spark, sidecar(path, "functions"), json.dumps(about["functions"]))
        write_text(spark, sidecar(path, "schema"), json.dumps({"profile": profile, "struct": about["struct"], "stored": stored.schema.jsonValue()}))
    elif kind == "btrblocks":
        raise NotImplementedError("BtrBlocks needs an external encoder; write Parquet or CSV")
    else:
        raise ValueError(f"unsupported format: {kind}")


def metadata(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """functions, schema, struct and header of a folded file; None for a plain one."""
    if suffix(path) == "csv":
        if not exists(spark, sidecar(path, "functions")):
            return None
        about = json.loads(read_text(spark, sidecar(path, "schema")))
        stored = T.StructType.fromJson(about["stored"])
        return {"functions": json.loads(read_text(spark, sidecar(path, "functions"))), "schema": about["profile"], "struct": about["struct"], "header": stored.fieldNames(), "stored": stored}
    return of_frame(spark.read.parquet(path))


def of_frame(df: DataFrame) -> dict[str, Any] | None:
    for f in df.schema.fields:
        if KEY in f.metadata:
            return json.loads(f.metadata[KEY]) | {"header": df.columns}
    return None


def read_folded(spark: SparkSession, path: str, functions: list[dict[str, Any]] | None = None, plain=None) -> DataFrame:
    """The original table as a view on the stored one; a plain file as it is, or as ``plain(path)`` reads it."""
    about = metadata(spark, path)
    if about is None and plain is not None:
        return plain(path)
    if suffix(path) == "csv":
        if about is None:
            from colfold.sources.readers import read

            return read(path, spark=spark)
        texts = T.StructType([T.StructField(n, T.StringType()) for n in about["header"]])
        raw = from_texts(spark.read.schema(texts).options(**_CSV, emptyValue="", multiLine=_has_text(about["stored"])).csv(path), about["stored"])
    else:
        raw = spark.read.parquet(path)
    if about is None:
        return raw
    folds = [Fold.from_json(x) for x in (functions if functions is not None else about["functions"])]
    return unfold_frame(raw, folds, T.StructType.fromJson(about["struct"]))
