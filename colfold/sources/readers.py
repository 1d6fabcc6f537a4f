"""Sources: Parquet, CSV, pandas and Spark frames; limits and samples."""

from __future__ import annotations

import csv
import os
import zlib
from collections.abc import Iterable
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colfold.types import category, quoted

#: Texts that mean null in a CSV file.
NULL_TOKENS = ("NULL", "null", "", "None")
#: Bits of a hash that a sample is drawn by.
DRAW = 40


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def suffix(path: str) -> str:
    """Format by the last extension of a path or URL; a folder of Parquet files needs none."""
    name = str(path).split("?")[0].rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else "parquet"


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Delimiter and quote from the first five lines; comma and double quote if they tell nothing."""
    lines = [r["value"] for r in spark.read.text(path).limit(5).collect()]
    try:
        found = csv.Sniffer().sniff("\n".join(lines))
        return found.delimiter, found.quotechar or '"'
    except csv.Error:
        return ",", '"'


def has_broken_lines(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether a quoted field goes over a line's end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: Any = None, sep: str | None = None, quote: str | None = None, header: bool = True, nulls: Iterable[str] = NULL_TOKENS, text_only: bool = False) -> DataFrame:
    """A CSV file; every token of ``nulls`` is null before types are inferred. Delimiter and quote are sniffed if not given.

    Files whose quoted fields hold line ends are read whole by file, others in splits."""
    found = sniff(spark, path) if sep is None or quote is None else (sep, quote)
    sep, quote = sep or found[0], quote or found[1]
    reader = spark.read.option("header", header).option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", has_broken_lines(spark, path, quote))
    texts = reader.csv(path)
    if not header:
        texts = texts.toDF(*(f"column{i}" for i in range(len(texts.columns))))
    clean = texts.select(*[F.when(F.col(quoted(c)).isin(*nulls), None).otherwise(F.col(quoted(c))).alias(c) for c in texts.columns])
    if text_only:
        return clean
    if schema is None:
        schema = infer_types(clean)
    return clean.select(*[F.col(quoted(c)).cast(schema[c]).alias(c) for c in clean.columns])


def infer_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest type that all of a text column's values have, in one pass."""
    kinds = ("bigint", "double", "boolean", "date", "timestamp_ntz")
    exprs = []
    for i, c in enumerate(texts.columns):
        col = F.col(quoted(c))
        for k in kinds:
            ok = col.try_cast(k).isNotNull()
            if k == "bigint":
                ok = col.rlike(r"^[+-]?\d{1,19}$") & ok
            elif k == "date":
                ok = col.rlike(r"^\d{4}-\d\d-\d\d$") & ok
            exprs.append(F.bool_and(col.isNull() | ok).alias(f"{i}_{k}"))
        exprs.append(F.count(col).alias(f"{i}_n"))
    row = texts.agg(*exprs).first()
    return {c: next((k for k in kinds if row[f"{i}_n"] and row[f"{i}_{k}"]), "string") for i, c in enumerate(texts.columns)}


def read(data: Any, nrows: int | None = None, spark: SparkSession | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Spark frame from a Spark or pandas frame, or a path or URL of a Parquet or CSV file; only ``columns``, if given.

    hf:// and http(s):// have no Hadoop file system: such a file is downloaded by the driver."""
    if isinstance(data, DataFrame):
        df = data
    else:
        spark = spark or session()
        if isinstance(data, (str, PurePath, os.PathLike)):
            path = str(data)
            if path.startswith(("hf://", "http://", "https://")):
                import pandas as pd

                df = spark.createDataFrame(pd.read_parquet(path) if suffix(path) == "parquet" else pd.read_csv(path))
            elif suffix(path) == "csv":
                df = read_csv(spark, path)
            elif suffix(path) == "parquet":
                df = spark.read.parquet(path)
            else:
                raise ValueError(f"unsupported input: {path}")
        else:
            df = spark.createDataFrame(data)
    if columns is not None:
        df = df.select(*map(quoted, columns))
    return df if nrows is None else df.limit(nrows)


def header(data: Any) -> list[str]:
    return read(data).columns


def project(df: DataFrame, *categories: str) -> DataFrame:
    """Only the columns of some categories; the scan reads no others."""
    return df.select(*[quoted(f.name) for f in df.schema.fields if category(f.dataType) in categories])


def head_sample(df: DataFrame, n: int = 50_000) -> DataFrame:
    return df.limit(n)


def repeatable_sample(df: DataFrame, n: int, *categories: str) -> DataFrame:
    """The n rows with the smallest hashes, nulls as zero: the same rows on every run and in any partitioning.

    Only rows under a bound on the hash are ordered, about 4 n of them however many partitions there are. Equal rows
    have one hash: where they crowd the sample, about n rows are drawn of the counted distinct ones, each as often as
    its share asks for."""
    some = project(df, *(categories or ("num",))).na.fill(0)
    columns = [quoted(c) for c in some.columns]
    order = F.xxhash64(*columns)
    rows = some.count()
    bound = -(1 << 63) + min((1 << 64) - 1, (4 * n * (1 << 64)) // max(1, rows))
    drawn = some.where(order <= F.lit(bound)).orderBy(order, *columns).limit(n)
    if not columns or rows <= n or drawn.distinct().count() * 2 >= n:
        return drawn
    share = F.count("*") * F.lit(n / rows)
    luck = F.pmod(order, F.lit(1 << DRAW)) / F.lit(float(1 << DRAW))
    often = some.groupBy(*columns).agg(share.alias("_share")).withColumn("_copies", F.floor(F.col("_share") + luck).cast("int"))
    return often.where("_copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def fraction_sample(df: DataFrame, n: int = 1000, *categories: str, seed: int = 0) -> DataFrame:
    """About n rows without nulls; nulls as zero if too few rows are whole. Drawn by a hash of seed and values, so
    that the partitioning has no say; equal rows go together."""
    some = project(df, *(categories or ("num",)))
    whole = some.na.drop()
    rows = whole.count()
    if rows < len(some.columns):
        whole, rows = some.na.fill(0), some.count()
    share = int(min(1.0, n / max(1, rows)) * (1 << DRAW))
    return whole.where(F.pmod(F.xxhash64(F.lit(seed), *map(quoted, whole.columns)), F.lit(1 << DRAW)) < F.lit(share))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's column names, types and rows, whatever their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*map(quoted, df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{zlib.crc32(df.schema.simpleString().encode()):08x}{row['n']:x}{int(row['h'] or 0) % (1 << 64):016x}"
