"""Best-fit-decreasing sharding of indivisible groups of equal texts.

Groups are taken by decreasing size; each enters the shard with the tightest remaining capacity that still
holds it, found in a balanced tree. ``fewest_shards`` minimises shards of a fixed capacity. ``near_equal``
searches the smallest capacity under which best-fit-decreasing needs no more than a fixed number of shards,
which makes their sizes near equal.

What is decided centrally is a histogram: groups of one size are interchangeable, so a run of equal groups
is placed at once. Sizes are rounded up to DIGITS binary digits there, one in 2048 at most, so the histogram has
no more than some 100,000 rows for any input. Which group of a size goes where follows from its rank, counted per
partition and summed by prefix; nothing is ordered in one task.

A group larger than an equal share is kept whole (groups are indivisible), in a shard of its own; the share of the
other shards is then an equal part of the rest, and so on. So all shards without such a group are near equal.

Edge cases: a null text counts as empty, size 1; all such texts are one group. Repeated rows are rows of
their group. An empty table gives no rows. Extra columns are ignored. Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.llm.common import stored, task_id, text_column

SHARDS = 16
#: Binary digits of a group's size in the histogram.
DIGITS = 12


class RemainingTree:
    """Shards by remaining capacity: an AVL tree of (remaining, shard) keys."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _rotated(self, node, side: int):
        child = node[side]
        node[side], child[3 - side] = child[3 - side], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child

    def _balanced(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        side = 1 if lean > 0 else 2
        if self._height(node[side][side]) < self._height(node[side][3 - side]):
            node[side] = self._rotated(node[side], 3 - side)
        return self._rotated(node, side)

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._balanced(node)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def drop(node, key):
            if node[0] == key:
                if not node[1] or not node[2]:
                    return node[1] or node[2]
                least = node[2]
                while least[1]:
                    least = least[1]
                node[0] = least[0]
                node[2] = drop(node[2], least[0])
            else:
                side = 1 if key < node[0] else 2
                node[side] = drop(node[side], key)
            return self._balanced(node)

        self.root = drop(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (shard, index into sizes, number of groups); ``sizes`` decrease. None if more than ``most`` shards are needed."""
    tree, shards, runs = RemainingTree(), 0, []
    for i, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        while left:
            key = tree.tightest(size)
            if key is None:
                if shards == most:
                    return None
                key, shards = (capacity, shards), shards + 1
            else:
                tree.remove(key)
            n = min(left, key[0] // size)
            runs.append((key[1], i, n))
            left -= n
            tree.add((key[0] - n * size, key[1]))
    return runs


def near_equal(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Runs under the smallest capacity for which ``shards`` shards are enough, within one in a million.

    Groups above an equal share of what is left go first, each into a shard of its own."""
    total, alone, large = int((sizes * counts).sum()), [], 0
    while large < len(sizes) and int(sizes[large]) * (shards - len(alone)) > total and len(alone) + int(counts[large]) < shards:
        alone += [(len(alone) + i, large, 1) for i in range(int(counts[large]))]
        total -= int(sizes[large] * counts[large])
        large += 1
    rest = _level(sizes[large:], counts[large:], shards - len(alone), total)
    return [*alone, *((s + len(alone), i + large, n) for s, i, n in rest)]


def _level(sizes: np.ndarray, counts: np.ndarray, shards: int, total: int) -> list[tuple[int, int, int]]:
    if not len(sizes):
        return []
    low, high, found = max(-(-total // shards), int(sizes[0])), None, None
    step = max(1, low // 1_000_000)
    found = best_fit_decreasing(sizes, counts, low, shards)
    while found is None:
        high = low + step
        found = best_fit_decreasing(sizes, counts, high, shards)
        if found is None:
            low, step = high, step * 4
    while high is not None and high - low > max(1, low // 1_000_000):
        middle = (low + high) // 2
        if (better := best_fit_decreasing(sizes, counts, middle, shards)) is None:
            low = middle
        else:
            high, found = middle, better
    return found


def fewest_shards(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Runs over as few shards of a fixed capacity as best-fit-decreasing needs."""
    if len(sizes) and int(sizes[0]) > capacity:
        raise ValueError("a group is larger than a shard")
    return best_fit_decreasing(sizes, counts, capacity) or []


def _ranker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a partition from 0."""
    at, part = 0, task_id()
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "_part", "_rank"])
        at += n


def _slotter(shards: int):
    """Numbers the rows of each shard within a partition from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = task_id(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), dtype=np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(rank + seen[shard])], names=[*batch.schema.names, "_part", "_rank"])
            seen += counts

    return run


def _numbered(df: DataFrame, run, name: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])
    return stored(df.mapInArrow(run, schema), name)


def _starts(numbered: DataFrame, *by: str) -> dict[tuple, int]:
    """How many rows lie in earlier partitions, by (key ..., partition): a row per key and partition is collected."""
    starts, sums = {}, {}
    for r in numbered.groupBy(*by, "_part").count().orderBy("_part").collect():
        key = tuple(r[b] for b in by)
        starts[(*key, r["_part"])] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + r["count"]
    return starts


def _at(starts: dict[tuple, int], df: DataFrame, *by: str) -> DataFrame:
    schema = T.StructType([*(df.schema[b] for b in (*by, "_part")), T.StructField("_start", T.LongType())])
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(*k, v) for k, v in starts.items()], schema)), [*by, "_part"])


def _placer(at: np.ndarray, shard: np.ndarray, starts: dict[tuple, int]):
    first = np.zeros(max((k[0] for k in starts), default=0) + 1, dtype=np.int64)
    for (part,), v in starts.items():
        first[part] = v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = first[batch.column(1).to_numpy(zero_copy_only=False)] + batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard[np.searchsorted(at, rank, side="right")])], names=["key", "shard"])

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law ``bytes``."""
    text = text_column(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
    )
    rows = stored(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("exact")).withColumn("cut", F.greatest(F.length(F.bin("exact")) - DIGITS, F.lit(0)))
    groups = groups.select("key", F.expr("shiftleft(shiftright(exact - 1, cut) + 1, cut)").alias("weight"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = _numbered(groups.repartitionByRange(parts, F.desc("weight"), "key").sortWithinPartitions(F.desc("weight"), "key"), _ranker, "groups")
    histogram = ranked.groupBy("weight").count().toPandas().sort_values("weight", ascending=False)
    counts = histogram["count"].to_numpy()
    runs = near_equal(histogram["weight"].to_numpy(), counts, shards)
    of_run = np.array([r[0] for r in runs], dtype=np.int32)
    ends = np.cumsum(np.array([r[2] for r in runs], dtype=np.int64)) if runs else np.zeros(0, np.int64)
    placed = ranked.select("key", "_part", "_rank").mapInArrow(_placer(ends, of_run, _starts(ranked)), "key binary, shard int")
    numbered = _numbered(rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard"), _slotter(shards), "slots")
    return _at(_starts(numbered, "shard"), numbered, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") + F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
