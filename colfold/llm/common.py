"""Shared helpers: the shared work folder, tables that cut lineage, batch iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colfold.sources import workdir

DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def new_path(spark: SparkSession, name: str) -> str:
    """In the folder that driver and executors share."""
    return workdir.new_path(spark, name, "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(labels: DataFrame) -> DataFrame:
    """_l_id, _l_quality, _l_toxic (0 or 1): the worst that any label says of a document."""
    toxic = F.col("toxic").cast("int") if "toxic" in labels.columns else F.lit(0)
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_l_id")).agg(F.min("quality").alias("_l_quality"), F.coalesce(F.max(toxic), F.lit(0)).alias("_l_toxic"))


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1 ..., which clash with no name that an operator uses, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def text_column(df: DataFrame, column: str = "text"):
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes without decoding; null is empty."""
    binary = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    return [x or b"" for x in binary.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def task_id() -> int:
    """Number of the partition that this task works on."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
