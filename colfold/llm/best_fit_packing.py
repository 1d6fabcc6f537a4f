"""Hierarchical residual packing of tokenised documents into fixed-length sequences.

Every partition tokenises its documents, cuts only those longer than a sequence, and packs the pieces
best-fit by decreasing length. Bins that are nearly full are final. The others travel as items (id, used
length) up a tree of merges: each round gathers a few neighbouring partitions' bins in one task, packs
them best-fit again and emits those that became nearly full. A bin in a bin is a shift, so a piece's place
is its place in its first bin plus the shifts on the way up. Before each round bins that not even the shortest
open one fits beside are final too. A merge task takes about MOST_ITEMS bins: while more are open, a round deals
them over as many tasks by chance, and the rounds end when one joins next to nothing.

Ids are those of the tokenizer on the whole text. Words between ASCII blanks are independent under it, so they are
remembered; those beyond Latin-1, and whole texts that hold a special token, go through the tokenizer itself.

Edge cases: a null or empty text is the single closing id. Documents without rows give no rows. Repeated
rows and ties are packed one by one. Extra columns are ignored. A text of any length is cut into pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.llm.common import DEFAULT_TOKENIZER, small_batches, stored, task_id, text_column, tokenizer_path, utf8_texts

SEQUENCE = 2048
#: A bin with at most this share of a sequence free is final.
NEARLY_FULL = 1 / 64
#: Partitions whose open bins meet in one merge task.
FAN_IN = 8
#: Items that one task packs at once: the leaf of the hierarchy.
MOST_ITEMS = 200_000
#: A round of dealing by chance that joins less than this share of the open bins is the last.
LEAST_GAIN = 1 / 100
#: Words that a worker remembers, and bytes of the longest of them.
MOST_WORDS = 500_000
LONGEST_WORD = 64
BATCH_BYTES = 1 << 20

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("bin", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("used", T.LongType()),
        T.StructField("part", T.IntegerType()),
    ]
)

#: Latin-1 letters and digits as the tokenizer's pre-tokenizer classes them, after lower-casing; words hold no ASCII blanks.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stays, the rest moves up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class WordIds(dict):
    """Little-endian unsigned 32-bit ids by white-space word; words are independent under this tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() or max(text) < "Ā":
            ids = [t.id for p in _SPLIT.findall(text.lower()) for t in self.tokenize("".join([self.letters[b] for b in p.encode()]))]
        else:
            ids = self._encoded(text)
        out = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = out
        return out

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: bytes) -> bytes:
        low = text.lower()
        if any(x in low for x in self.special):
            return np.array(self._encoded(text.decode()), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, (low if text.isascii() else text).split()))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def best_fit(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place, each bin's used length.

    Open bins hang by their free length; a bit mask of free lengths finds the tightest in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    places = np.empty(len(lengths), dtype=np.int64)
    used: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            b, free = len(used), capacity
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += n
        if left := free - n:
            by_free[left].append(b)
            mask |= 1 << left
    return bins, places, np.array(used, dtype=np.int64)


def _first_round(path: str, sequence: int, closing: int):
    end = np.array([closing], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, base = word_ids(path), task_id(), 0
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal base
            docs, *numbers = zip(*rows, strict=True)
            piece, start, length, crc = (np.array(x, dtype=np.int64) for x in numbers)
            bins, places, used = best_fit(length, sequence)
            ids = (np.int64(part) << 36) + base + bins
            base += len(used)
            columns = (piece.astype(np.int32), start, length, crc, ids, places, used[bins], np.full(len(docs), part, np.int32))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c) for c in columns)], names=PIECES.fieldNames())

        for batch in small_batches(batches, "text", BATCH_BYTES):
            for doc, text in zip(batch.column(0).to_pylist(), utf8_texts(batch.column(1)), strict=True):
                ids = words.of(text) + end
                step = 4 * sequence
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            if len(rows) >= MOST_ITEMS:
                yield packed()
        if rows:
            yield packed()

    return run


def _merge(sequence: int):
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin", kind="stable").reset_index(drop=True)
        out = []
        for at in range(0, len(bins), MOST_ITEMS):
            some = bins.iloc[at : at + MOST_ITEMS]
            into, places, used = best_fit(some["used"].to_numpy(), sequence)
            first = np.full(len(used), -1, dtype=np.int64)
            at_start = places == 0
            first[into[at_start]] = some["bin"].to_numpy()[at_start]
            out.append(pd.DataFrame({"bin": some["bin"].to_numpy(), "parent": first[into], "shift": places, "used": used[into], "part": some["node"].to_numpy().astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"bin": [], "parent": [], "shift": [], "used": [], "part": []})

    return run


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, closing: int = 0, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or tokenizer_path(DEFAULT_TOKENIZER)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    pieces = stored(wanted.mapInArrow(_first_round(path, sequence, closing), PIECES), "pieces")
    limit = int(sequence * (1 - nearly_full))
    open_bins = pieces.where(F.col("used") < limit).select("bin", "used", "part").distinct()
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    moved, turn = None, 0
    while True:
        lengths = {r["used"]: r["count"] for r in open_bins.groupBy("used").count().collect()}  # at most ``sequence`` rows
        room = sequence - min(lengths, default=0)
        left = sum(n for used, n in lengths.items() if used <= room)
        parts, turn = -(-parts // FAN_IN), turn + 1
        if crowded := left > MOST_ITEMS * parts:
            parts = -(-left // MOST_ITEMS)
        node = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(parts)) if crowded else F.floor(F.col("part") / FAN_IN)
        dealt = open_bins.where(F.col("used") <= room).withColumn("node", node.cast("int"))
        merged = stored(dealt.groupBy("node").applyInPandas(_merge(sequence), "bin long, parent long, shift long, used long, part int"), "merged")
        steps = merged.where(F.col("bin") != F.col("parent")).select("bin", "parent", "shift")
        joined = steps.count()
        if moved is None:
            moved = steps
        else:  # what had moved moves along with its bin; bins that move for the first time join the list
            later = steps.select(F.col("bin").alias("_b"), F.col("parent").alias("_p"), F.col("shift").alias("_s"))
            followed = moved.join(later, moved["parent"] == later["_b"], "left").select("bin", F.coalesce("_p", "parent").alias("parent"), (F.col("shift") + F.coalesce("_s", F.lit(0))).alias("shift"))
            moved = stored(followed.unionByName(steps), "moved")
        if parts <= 1 or (crowded and joined < LEAST_GAIN * left):
            break
        open_bins = merged.where((F.col("bin") == F.col("parent")) & (F.col("used") < limit)).select("bin", "used", "part")
    places = moved.withColumnRenamed("bin", "_bin")
    return pieces.join(places, pieces["bin"] == places["_bin"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
