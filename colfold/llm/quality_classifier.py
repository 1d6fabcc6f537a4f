"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and neighbouring pairs of words are hashed into buckets. The target model counts them in documents
labelled good, the raw model in all documents. A document's log weight is the sum over its n-grams of the
logarithm of target over raw probability. Adding Gumbel noise (a fixed function of seed and doc_id) and
taking the k largest samples k documents without replacement in proportion to their weights.

Documents are ranked by their mean: the noisy weight over the number of their n-grams and SHRINK more of weight 0. A sum
grows with the length, so that a long document of poor text would rank before a short one of good text, or after it.
The k largest are sampled, ties at the k-th with them. ``k`` may be given; else the labels say how large the sample is:
as many documents as rank with all but a share MISS of the held-out labelled good documents. The target is fitted on at most MOST_TARGET of the other
half of them (those with the smallest hashes); the raw model and the weights take every document.

Toxic text is good prose but for a few words, which no mean over n-grams shows. So a document is good only if no
label calls it toxic, and a second model weighs words by the documents that have them: the logarithm of their share
among labelled toxic over that among good ones (the same half). A document counts by its heaviest word, and goes if
that is above what all but a share MISS of held-out good documents reach.

Edge cases: a null or empty text has no n-grams and weight 0, so its noise alone decides. Without good labels every document is kept.
Repeated rows get equal weights and noise. A null doc_id draws a noise of its own. Labels without toxic ones weigh no words. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.llm.common import numbered_columns, small_batches, stored, truth

BUCKETS = 1 << 14
#: Bytes of text that a task hashes at once.
BATCH_BYTES = 1 << 19
MOST_TARGET = 50_000
#: Words of the toxic model, each in two labelled toxic documents at least.
MOST_WORDS = 10_000
MISS = 0.002
#: N-grams of weight 0 that every mean counts besides a document's own: a few words say little.
SHRINK = 30
SEED = 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for x in (_BASE, inverse):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data``, and the text that each belongs to."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = ((data >= 9) & (data <= 13)) | (data == 32)
    first = np.zeros(n + 1, dtype=bool)
    first[starts[starts < n]] = True
    inside = ~blank
    begin = np.flatnonzero(inside & (first[:n] | np.concatenate(([True], blank[:-1]))))
    end = np.flatnonzero(inside & (first[1:] | np.concatenate((blank[1:], [True])))) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, at = np.zeros(len(begin), dtype=np.uint64), 0
    while at < len(begin):  # a part of the text at a time, of whole words
        low = int(begin[at])
        to = max(at + 1, int(np.searchsorted(end, low + BATCH_BYTES, side="right")))
        part = data[low : end[to - 1]]
        power, inverse = _powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        prefix[1:] = part
        prefix[1:] += np.uint64(1)
        prefix[1:] *= power[: len(part)]
        np.cumsum(prefix, out=prefix)
        words[at:to] = _mixed((prefix[end[at:to] - low] - prefix[begin[at:to] - low]) * inverse[begin[at:to] - low])
        at = to
    return words, np.searchsorted(starts, begin, side="right") - 1


def gram_buckets(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts that lie end to end in ``data``, and the text that each belongs to."""
    return _grams(*word_hashes(data, starts), buckets)


def _grams(words: np.ndarray, owner: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    pair = owner[1:] == owner[:-1]
    pairs = _mixed(words[:-1] * np.uint64(3) + words[1:] * _BASE + np.uint64(1))[pair]
    both = np.concatenate((words, pairs))
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate((owner, owner[1:][pair]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts."""
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in small_batches(batches, "text", BATCH_BYTES):
        buckets, owner = gram_buckets(*_flat(batch.column(0)))
        raw += np.bincount(buckets, minlength=BUCKETS)
        good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
        if good.any():
            target += np.bincount(buckets[good[owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def good_ids(labels: DataFrame) -> DataFrame:
    """_g_id: documents that no label calls bad or toxic, once each."""
    return truth(labels).where("_l_quality = 1 and _l_toxic = 0").select(F.col("_l_id").alias("_g_id"))


def toxic_ids(labels: DataFrame) -> DataFrame:
    """_g_id: documents that a label calls toxic, once each."""
    return truth(labels).where("_l_toxic > 0").select(F.col("_l_id").alias("_g_id"))


def _held_out() -> Column:
    """Half of the labelled documents set the level; the model is fitted on the others only."""
    return F.pmod(F.xxhash64(F.lit(SEED + 1), "_g_id"), F.lit(2)) == 1


def _drawn(ids: DataFrame, name: str) -> DataFrame:
    return stored(ids.where(~_held_out()).orderBy(F.xxhash64("_g_id"), "_g_id").limit(MOST_TARGET), name)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Log of target over raw probability by bucket: BUCKETS numbers, whatever the input's size."""
    sample = _drawn(good_ids(labels), "target").withColumn("_g_good", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("long").alias("_d_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("_d_id") == F.col("_g_id"), "left")
    counted = marked.select("text", F.coalesce("_g_good", F.lit(False)).alias("good")).mapInArrow(_counter, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return None
    smooth = lambda x: np.log((x + 0.5) / (x.sum() + 0.5 * BUCKETS))
    return smooth(target) - smooth(raw)


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", BATCH_BYTES):
        words, owner = word_hashes(*_flat(batch.column(0)))
        order = np.lexsort((words, owner))
        words, owner = words[order], owner[order]
        once = np.concatenate(([True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])))[: len(words)]
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)[owner[once]]
        kinds, place = np.unique(words[once], return_inverse=True)
        counts = [np.bincount(place[of], minlength=len(kinds)) for of in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "toxic", "good"])


def fit_toxic(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and weights of the words that labelled toxic documents have more often than good ones: MOST_WORDS at most."""
    sample = _drawn(toxic_ids(labels), "toxic").withColumn("_g_toxic", F.lit(True)).unionByName(_drawn(good_ids(labels), "good").withColumn("_g_toxic", F.lit(False)))
    marked = docs.select(F.col("doc_id").cast("long").alias("_d_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("_d_id") == F.col("_g_id")).select("text", F.col("_g_toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = lambda c: (F.col(c) + 0.5) / F.lit(n.get(c == "toxic", 0) + 1.0)
    counted = marked.mapInArrow(_word_counter, "word long, toxic long, good long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("good").alias("good"))
    weighed = counted.where("toxic > 1").select("word", F.log(share("toxic") / share("good")).alias("weight")).where("weight > 0")
    found = weighed.orderBy(F.desc("weight"), "word").limit(MOST_WORDS).collect()
    words, weights = np.array([r["word"] for r in found], np.int64).view(np.uint64), np.array([r["weight"] for r in found], np.float64)
    order = np.argsort(words)
    return words[order], weights[order]


def _scorer(ratio: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], at: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, BATCH_BYTES):
            words, of = word_hashes(*_flat(batch.column(at)))
            heaviest = np.zeros(batch.num_rows)
            if len(toxic[0]):
                place = np.minimum(np.searchsorted(toxic[0], words), len(toxic[0]) - 1)
                hit = toxic[0][place] == words
                np.maximum.at(heaviest, of[hit], toxic[1][place[hit]])
            buckets, owner = _grams(words, of)
            weight = np.bincount(owner, weights=ratio[buckets], minlength=batch.num_rows).astype(np.float64)
            grams = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(grams.astype(np.int64)), pa.array(heaviest)], names=[*batch.schema.names, "_w_log", "_w_grams", "_w_toxic"])

    return run


def with_weights(docs: DataFrame, ratio: np.ndarray | None, toxic: tuple[np.ndarray, np.ndarray], column: str = "text") -> DataFrame:
    """``docs`` with _w_log (log weight), _w_grams (number of n-grams) and _w_toxic (the heaviest word of the toxic model, else 0)."""
    docs = docs.withColumn(column, F.col(column).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_w_log", T.DoubleType()), T.StructField("_w_grams", T.LongType()), T.StructField("_w_toxic", T.DoubleType())])
    return docs.mapInArrow(_scorer(np.zeros(BUCKETS) if ratio is None else ratio, toxic, docs.columns.index(column), column), schema)


def noisy(seed: int = SEED, doc_id: str = "doc_id") -> Column:
    """Log weight plus Gumbel noise from 52 bits of a hash of seed and doc_id."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("long")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return F.col("_w_log") - F.log(-F.log(uniform))


def noisy_mean(doc_id: str = "doc_id") -> Column:
    """Noisy weight per n-gram, drawn towards 0 in short texts: what documents are ranked by."""
    return noisy(doc_id=doc_id) / (F.col("_w_grams") + F.lit(SHRINK))


def levels_for(scored: DataFrame, labels: DataFrame, miss: float = MISS) -> tuple[float | None, float | None]:
    """The noisy mean that all but a share ``miss`` of the held-out good documents reach, and the toxic weight that all
    but such a share stay within: their least and most, if they are too few to show it."""
    good = scored.select(F.col("doc_id").cast("long").alias("_d_id"), noisy_mean().alias("noisy"), "_w_toxic").join(good_ids(labels).where(_held_out()), F.col("_d_id") == F.col("_g_id"), "left_semi")
    r = good.agg(F.percentile_approx("noisy", F.lit(miss), F.lit(100_000)), F.percentile_approx("_w_toxic", F.lit(1 - miss), F.lit(100_000))).first()
    return r[0], r[1]


def level_for_k(scored: DataFrame, k: int, bits: int = 12, scale: int = 40) -> float:
    """The k-th largest noisy mean, to 2**-scale, by histograms that narrow a whole number ``bits`` bits at a time."""
    low, width = -(1 << 59), 60
    value = F.floor(noisy_mean() * float(1 << scale)).cast("long")
    left = k
    while width:
        width -= bits
        cell = F.shiftright(value - F.lit(low), width)
        cells = scored.where((value >= low) & (cell < (1 << bits))).groupBy(cell.alias("c")).count().orderBy(F.desc("c")).collect()  # at most 2**bits rows
        for r in cells:
            if left <= r["count"]:
                low += r["c"] << width
                break
            left -= r["count"]
        else:
            return float("-inf")
    return low / (1 << scale)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, noisy_weight, kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = fit(narrow, labels)
    scored = stored(with_weights(narrow, ratio, fit_toxic(narrow, labels)).drop("text"), "weights")
    level, most = (None, None) if ratio is None else sampled(scored, labels, k)
    kept = F.lit(True) if level is None else _fine(level, most)
    return scored.select("doc_id", F.col("_w_grams").alias("n_grams"), F.round("_w_log", 6).alias("log_weight"), F.round(noisy(), 6).alias("noisy_weight"), kept.alias("kept"))


def sampled(scored: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[float | None, float]:
    """The level that the k documents of the sample reach, and the toxic weight that they stay within. A k that is given
    takes the k largest, whatever words they have; else the labels say it, and nothing is said without them."""
    if k is not None:
        return level_for_k(scored, k), float("inf")
    reached, most = levels_for(scored, labels)
    if reached is None:
        return None, float("inf")
    return level_for_k(scored, scored.where(noisy_mean() >= F.lit(reached)).count()), most


def _fine(level: float, most: float, doc_id: str = "doc_id") -> Column:
    return (noisy_mean(doc_id) >= F.lit(level)) & (F.col("_w_toxic") <= F.lit(most))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their own columns, whatever their names."""
    ratio = fit(docs, labels)
    if ratio is None:
        return docs
    toxic = fit_toxic(docs, labels)
    scored = stored(with_weights(docs.select("doc_id", "text"), ratio, toxic).drop("text"), "weights")  # no text is shuffled to meet its label
    level, most = sampled(scored, labels)
    if level is None:
        return docs
    own, name = numbered_columns(docs)
    return with_weights(own, ratio, toxic, name["text"]).where(_fine(level, most, name["doc_id"])).select(*own.columns).toDF(*docs.columns)
