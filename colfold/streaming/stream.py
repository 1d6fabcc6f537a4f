"""A folded Parquet folder as a stream: reconstruction is a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.operators.fold import Fold, unfold_frame
from colfold.sources.store import metadata


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files of a folded folder, reconstructed. Watermarks, windows and joins are those of any stream."""
    about = metadata(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.parquet(path)
    return raw if about is None else unfold_frame(raw, [Fold.from_json(x) for x in about["functions"]], T.StructType.fromJson(about["struct"]))


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """start, keys, n: rows by window of ``time``. Rows later than ``late`` behind the latest time seen are left out, and
    the state of windows that far back is dropped."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")
