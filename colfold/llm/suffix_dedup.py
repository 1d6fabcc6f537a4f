"""Repeated byte strings through a Burrows-Wheeler transform with threshold-bounded interval expansion.

A byte goes if a string of LENGTH bytes covers it that starts anywhere else too, same document included.

Windows. Every window of LENGTH bytes has an anchor: its smallest-hashed gram of GRAM bytes, the leftmost of
equals. Equal windows have equal anchors at equal places. Neighbouring windows share anchors, so a document
falls into stretches (about 170 windows each) of windows with one anchor. Stretches equal as a whole are
counted by hash and settled; of those alike in the anchor only, one copy of each distinct stretch goes on.

Transform. Distinct stretches with one anchor meet in a block. Their bytes are joined, sorted by suffix to
LENGTH bytes, and transformed. Boundaries between suffix intervals are then found breadth-first by backward
extension, by increasing common prefix: a boundary of prefix l before rank p is extended by each character c of
the transform at p and after it, to the boundary of prefix l + 1 before rank LF of c's first place there. It
stops at LENGTH: where no boundary was found, the neighbours share LENGTH bytes or more. While most ranks lie
on the frontier the same step is taken from the other end: a rank becomes a boundary when one lies between the
ranks that follow its two neighbours.

Crowded anchors. If more than MOST distinct stretches share an anchor (a passage in very many documents whose
surroundings differ), each is cut into shorter stretches that are dealt by all bytes their windows share,
down to single windows, which are equal or not. So no block is unbounded and no window is skipped.

Words. ``strip`` looks for two kinds of windows in one go: of bytes as above, and of words, the symbols of the same steps
then being 64-bit hashes of words and a window WORDS of them. So a passage of WORDS words goes however few bytes it
has, and one of LENGTH bytes however few words; white space between words is not compared. The kinds never meet: they
share the scans and shuffles only.

Edge cases: null and empty texts, and those shorter than LENGTH, lose nothing. Repeated rows and ties lose
their common bytes in every copy, the first included. An empty table gives no rows.
Extra columns are ignored. Rows with a null or repeated doc_id are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import forget, numbered_columns, small_batches, stored, text_column, utf8_texts

LENGTH = 400
GRAM = 64
#: Words in a window where words are the symbols ("over 50"), and in an anchor.
WORDS = 51
WORD_GRAM = 8
#: Distinct stretches of one anchor in a block, and windows in a stretch once a crowded one is cut.
MOST = 1000
CUTS = (16, 1)
#: Keys at most that stand in more than a share 1 / HOT_KEYS of all stretches (and MOST of them): those are broadcast.
HOT_KEYS = 4096
#: Bytes of a block, and blocks of a task.
BLOCK = 1 << 19
TASK_BLOCKS = 8
#: Ranks after a boundary in which its extensions are looked for first.
NEAR = 8
MOST_PARTITIONS = 20_000
#: Bytes of text that a task works on at once, and windows of a long text; some 120 bytes of arrays stand for each.
BATCH_BYTES = 1 << 18
#: Bits for places in the order of grams.
SEGMENT = 1 << 18
PLACE_BITS = np.uint64(31)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if (which, size) not in _POWERS:
        for k in [k for k in _POWERS if k[0] == which]:
            del _POWERS[k]
        both = []
        for x in (_BASES[which], np.uint64(pow(int(_BASES[which]), -1, 1 << 64))):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[which, size] = (both[0], both[1])
    return _POWERS[which, size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _BASES[0]
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of any slices of a byte array."""

    def __init__(self, data: np.ndarray):
        self.prefix = []
        for which in (0, 1):
            p = np.zeros(len(data) + 1, dtype=np.uint64)
            p[1:] = data
            p[1:] += np.uint64(1)
            p[1:] *= _powers(which, len(data) + 1)[0][: len(data)]
            np.cumsum(p, out=p)
            self.prefix.append(p)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        p = self.prefix[which]
        h = p[end]
        h -= p[begin]
        h *= _powers(which, len(p))[1][begin]
        h += (end - begin).astype(np.uint64)
        return _mixed(h)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words (cut at space and 0x09 to 0x0D) of texts that lie end to end."""
    inside = ~(((data >= 9) & (data <= 13)) | (data == 32))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    begin = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([True], inside))[:-1]))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside, [False]))[1:])) + 1
    return begin, end


def word_symbols(texts: list[bytes]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    ends = np.cumsum(sizes)
    begin, end = word_bounds(data, ends - sizes)
    words, at = np.zeros(len(begin), np.uint64), 0
    while at < len(begin):  # a part of the text at a time, of whole words
        low = int(begin[at])
        to = max(at + 1, int(np.searchsorted(end, low + SEGMENT, side="right")))
        words[at:to] = Hashes(data[low : end[to - 1]]).of(begin[at:to] - low, end[at:to] - low, 1)
        at = to
    return np.split(words, np.searchsorted(begin, ends[:-1]))


def _symbols(texts: list[bytes], words: bool) -> list[np.ndarray]:
    return word_symbols(texts) if words else [np.frombuffer(x, dtype=np.uint8) for x in texts]


def _kind(words: bool) -> type:
    return np.uint64 if words else np.uint8


def stretches(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every stretch: text, first window, number of windows, the anchor's place in it, and hashes of its anchor and of all of it."""
    out, some, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), SEGMENT):  # windows of a long text are worked on a segment at a time
            some.append((i, at, text[at : at + SEGMENT + length - 1]))
            held += len(some[-1][2])
            if held >= SEGMENT:
                out.append(_stretches(*zip(*some, strict=True), length, gram))
                some, held = [], 0
    if some:
        out.append(_stretches(*zip(*some, strict=True), length, gram))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6


def _stretches(owner_of: tuple[int, ...], offset_of: tuple[int, ...], pieces: tuple[np.ndarray, ...], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of pieces of texts, each with its text's number and its offset there."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    data = np.concatenate(pieces)
    starts = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    n_grams, n_windows = len(data) - gram + 1, len(data) - length + 1
    low = hashes.of(np.arange(n_grams), np.arange(gram, len(data) + 1), 0)
    low = (low >> PLACE_BITS << PLACE_BITS) | np.arange(n_grams, dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: span - wide], low[wide - span :])
    anchor = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    seams = np.zeros(n_windows + 1, dtype=np.int32)  # windows over a seam of two pieces are none
    np.add.at(seams, np.clip(starts[1:] - length + 1, 0, n_windows), 1)
    np.subtract.at(seams, np.clip(starts[1:], 0, n_windows), 1)
    ok = np.cumsum(seams[:-1]) == 0
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]))))
    count = np.diff(np.append(first, n_windows))
    first, count = first[ok[first]], count[ok[first]]
    piece = np.searchsorted(starts, first, side="right") - 1
    at = anchor[first]
    key = hashes.of(at, at + gram, 1)
    whole = hashes.of(first, first + count + length - 1, 0) ^ _mixed((at - first).astype(np.uint64) * _BASES[1] + count.astype(np.uint64))
    return np.array(owner_of)[piece], first - starts[piece] + np.array(offset_of)[piece], count, at - first, key.view(np.int64), whole.view(np.int64)


STRETCHES = "words boolean, row long, first int, windows int, at int, anchor long, whole long"
#: What equal stretches have in common.
KEYS = ("words", "anchor", "whole")
#: Length of a window and of an anchor, by whether the symbols are words.
Kinds = dict[bool, tuple[int, int]]


def _stretcher(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            row = batch.column(0).to_numpy(zero_copy_only=False)
            texts = utf8_texts(batch.column(1))
            for words, (length, gram) in kinds.items():
                text, first, windows, at, anchor, whole = stretches(_symbols(texts, words), length, gram)
                columns = (np.full(len(text), words), row[text.astype(np.int64)], first.astype(np.int32), windows.astype(np.int32), at.astype(np.int32), anchor, whole)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["words", "row", "first", "windows", "at", "anchor", "whole"])

    return run


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` codes (equal ones share the rank of the first); codes are at least 1, the end sorts first."""
    n = len(codes)
    bits = int(codes.max()).bit_length()
    step = max(1, min(depth, 62 // bits))
    padded = np.concatenate((codes.astype(np.int64), np.zeros(step, np.int64)))
    packed = np.zeros(n, dtype=np.int64)
    for i in range(step):
        packed = (packed << bits) | padded[i : i + n]
    width = step

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        sorted_ = keys[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return rank

    rank = ranked(packed)
    while width < depth:
        shift = min(width, depth - width)
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - shift)] = rank[shift:] + 1
        rank = ranked(rank * (n + 1) + follow)
        width += shift
    return rank


def shared_prefix(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (to ``length`` codes) of codes whose last is a unique smallest end; and, for each rank, whether
    no boundary shorter than ``length`` lies before it: it shares ``length`` codes with the rank before."""
    n = len(codes)
    rank = suffix_order(codes, length)
    array = np.argsort(rank, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[array] = np.arange(n)
    first = codes[array]
    follow = place[(array + 1) % n]
    back = np.empty(n, dtype=np.int64)
    back[follow] = np.arange(n)  # LF: the rank of the suffix one longer
    bounded = np.concatenate(([True], first[1:] != first[:-1]))
    unset, fresh, wide = np.flatnonzero(~bounded), np.flatnonzero(bounded), None
    for _ in range(1, length):
        if not len(unset) or not len(fresh):
            break
        if wide is None and NEAR * len(fresh) >= len(unset):  # most ranks are on the frontier
            total = np.cumsum(bounded)
            found = total[follow[unset]] > total[follow[unset - 1]]
            fresh, unset = unset[found], unset[~found]
            bounded[fresh] = True
            continue
        if wide is None:
            wide = unset[(follow[unset] - follow[unset - 1] > NEAR) | (follow[unset] < follow[unset - 1])]
        new = []
        for d in range(NEAR):  # extensions of the boundary before p lie at the ranks LF(p), LF(p + 1) ...
            p = fresh[fresh + d < n]
            k = back[p + d]
            new.append(k[~bounded[k] & (follow[k - 1] < p)])
        if len(wide):  # neighbours whose followers lie far apart
            at = np.searchsorted(fresh, follow[wide - 1], side="right")
            hit = np.append(fresh, n)[at] <= follow[wide]
            new.append(wide[hit & ~bounded[wide]])
            wide = wide[~hit]
        fresh = np.unique(np.concatenate(new))
        bounded[fresh] = True
    return array, ~bounded


def repeated_windows(parts: list[bytes], windows: np.ndarray, length: int, kind: type = np.uint8) -> np.ndarray:
    """For the parts end to end: which of each part's windows occur at two places of all parts at least."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64) // np.dtype(kind).itemsize
    used, inverse = np.unique(np.frombuffer(b"".join(parts), dtype=kind), return_inverse=True)  # small alphabets sort faster
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    codes = np.full(len(inverse) + len(parts), 2, dtype=np.int64)
    inner = np.ones(len(codes), dtype=bool)
    inner[ends] = False
    codes[inner] = inverse + 3
    array, equal = shared_prefix(np.append(codes, 1), length)
    flag = np.zeros(len(codes) + 1, dtype=bool)
    at = np.flatnonzero(equal)
    flag[array[at]] = True
    flag[array[at - 1]] = True
    total = int(windows.sum())
    place = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(total)
    return flag[place]


def _runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags within consecutive groups of ``counts``: group, first, last."""
    if not len(flags):
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    inner = np.arange(len(flags)) - begins[owner]
    left = flags & ((inner == 0) | ~np.concatenate(([False], flags[:-1])))
    right = flags & ((inner == counts[owner] - 1) | ~np.concatenate((flags[1:], [False])))
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    return owner[a], inner[a], inner[b]


def _block(kinds: Kinds):
    """Repeated windows of one block's stretches; those that other rows share as a whole are settled and only compared with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        windows, words = rows["windows"].to_numpy().astype(np.int64), bool(rows["words"].iloc[0])
        flags = repeated_windows(rows["body"].tolist(), windows, kinds[words][0], _kind(words)) & np.repeat(rows["alone"].to_numpy(), windows)
        group, first, last = _runs(flags, windows)
        begin = rows["first"].to_numpy()[group]
        return pd.DataFrame({"words": words, "row": rows["row"].to_numpy()[group], "first": (begin + first).astype(np.int32), "last": (begin + last).astype(np.int32)})

    return run


_FIELDS = {"words": pa.bool_(), "row": pa.int64(), "first": pa.int32(), "windows": pa.int32(), "at": pa.int32(), "anchor": pa.int64(), "whole": pa.int64(), "alone": pa.bool_(), "many": pa.bool_(), "body": pa.binary()}
_SQL = {"words": "boolean", "row": "long", "first": "int", "windows": "int", "at": "int", "anchor": "long", "whole": "long", "alone": "boolean", "many": "boolean", "body": "binary"}


def _schema(*names: str) -> str:
    return ", ".join(f"{n} {_SQL[n]}" for n in names)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _FIELDS[n]) for c, n in zip(columns, names, strict=True)], names=list(names))


BODY = ("words", "row", "first", "windows", "at", "anchor", "alone", "many", "body")
PIECE = ("words", "row", "first", "windows", "at", "anchor", "whole", "alone", "body")


def _slicer(kinds: Kinds):
    """The symbols of the stretches wanted from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = utf8_texts(batch.column(1))
            lists = batch.column(2)
            names = ("words", "first", "windows", "at", "anchor", "alone", "many")
            fields = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
            counts = np.diff(lists.offsets.to_numpy())
            wanted = list(zip(np.repeat(np.arange(len(texts)), counts).tolist(), *(fields[n].to_pylist() for n in names), strict=True))
            rows = batch.column(0).to_pylist()
            for words, (length, _) in kinds.items():
                symbols, out = _symbols(texts, words), []
                for i, kind, first, windows, *rest in wanted:
                    if kind == words:
                        out.append((words, rows[i], first, windows, *rest, symbols[i][first : first + windows + length - 1].tobytes()))
                yield _batch(out, BODY)

    return run


def _cutter(kinds: Kinds, windows: int):
    """Cuts stretches, at places fixed by the anchor, into pieces of ``windows`` windows keyed by the symbols that these windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "body", BATCH_BYTES):
            out = []
            for words, row, first, count, at, anchor, alone, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols, length = np.frombuffer(body, dtype=_kind(words)), kinds[words][0]
                hashes = Hashes(symbols)
                cell = (at - np.arange(count)) // windows
                begins = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
                sizes = np.diff(np.append(begins, count))
                core = at - cell[begins] * windows  # what all windows of the whole cell share, wherever this stretch ends
                keys = _mixed(hashes.of(core, core - windows + 1 + length, 0) ^ np.uint64(anchor & (1 << 64) - 1) ^ _mixed((cell[begins] + (1 << 32)).astype(np.uint64)))
                whole = hashes.of(begins, begins + sizes + length - 1, 1) ^ _mixed((at - begins).astype(np.uint64) * _BASES[1] + sizes.astype(np.uint64))
                out += [(words, row, first + b, n, at - b, k, w, alone, symbols[b : b + n + length - 1].tobytes()) for b, n, k, w in zip(begins.tolist(), sizes.tolist(), keys.view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True)]
            yield _batch(out, PIECE)

    return run


def _expanded(bodies: DataFrame, kinds: Kinds) -> DataFrame:
    """Repeated windows of stretches that meet by anchor, in blocks of about BLOCK bytes."""
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    dealt = bodies.select("words", "row", "first", "windows", "alone", "body", F.pmod(F.xxhash64("words", "anchor"), F.lit(blocks)).alias("block")).repartition(min(-(-blocks // TASK_BLOCKS), MOST_PARTITIONS), "block")
    return dealt.groupBy("words", "block").applyInPandas(_block(kinds), _schema("words", "row", "first") + ", last int")


def repeats(docs: DataFrame, kinds: Kinds, most: int = MOST) -> DataFrame:
    """docs: row (unique long), text. Returns words, row, first, last: runs of windows that start elsewhere too.

    Places and lengths count bytes, or words where ``words`` is true."""
    if any(gram > length for length, gram in kinds.values()):
        raise ValueError("a gram is longer than a window")
    found = stored(docs.mapInArrow(_stretcher(kinds), STRETCHES), "stretches")
    distinct = stored(found.groupBy(*KEYS).agg(F.count("*").alias("n"), *_one(), F.min("windows").alias("windows"), F.min("at").alias("at")), "distinct")
    crowd = distinct.groupBy("words", "anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = distinct.join(crowd, ["words", "anchor"]).select("row", F.struct("words", "first", "windows", "at", "anchor", (F.col("n") == 1).alias("alone"), (F.col("kinds") > most).alias("many")).alias("w"))
    per_row = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    bodies = stored(docs.join(per_row, "row").select("row", "text", "wanted").mapInArrow(_slicer(kinds), _schema(*BODY)), "bodies")
    runs = [stored(_whole_runs(_shared(found, distinct, most)), "whole"), _expanded(bodies.where("not many"), kinds)]
    forget(found, distinct)
    left = bodies.where("many")
    for windows in (min(c, *(length for length, _ in kinds.values())) for c in CUTS):
        if left.isEmpty():
            break
        pieces = stored(left.select(*BODY).mapInArrow(_cutter(kinds, windows), _schema(*PIECE)), "pieces")
        sums = stored(pieces.groupBy(*KEYS).agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n"), *_one()), "kinds")
        runs.append(_whole_runs(_shared(pieces.where("alone"), sums, most)))
        if windows == 1:
            break
        crowd = sums.groupBy("words", "anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        ones = sums.join(crowd, ["words", "anchor"]).select("words", "row", "first", (F.col("n") == 1).alias("alone"), (F.col("kinds") > most).alias("many"))
        bodies = stored(pieces.drop("alone").join(ones, ["words", "row", "first"]).select(*BODY), "bodies")
        runs.append(_expanded(bodies.where("not many"), kinds))
        left = bodies.where("many")
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    return every


def _one() -> list[Column]:
    """Row and place of one of equal stretches; no struct, so that Spark aggregates by hash."""
    return [F.min("row").alias("row"), F.min_by("first", "row").alias("first")]


def _whole_runs(rows: DataFrame) -> DataFrame:
    return rows.select("words", "row", "first", (F.col("first") + F.col("windows") - 1).alias("last"))


def _shared(rows: DataFrame, kinds: DataFrame, most: int) -> DataFrame:
    """Rows whose anchor and whole stand in several rows. The few that stand in very many never meet in one task."""
    keys = list(KEYS)
    limit = max(most, (kinds.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    shared, hot = kinds.where("n > 1"), kinds.where(F.col("n") > limit).select(*keys)
    if hot.isEmpty():
        return rows.join(shared.select(*keys), keys, "left_semi")
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(shared.where(F.col("n") <= limit).select(*keys), keys, "left_semi")
    return rest.unionByName(rows.join(F.broadcast(hot), keys, "left_semi"))


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans [begin, end) of each owner, ordered; spans that touch are one."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order].astype(np.int64), begin[order].astype(np.int64), end[order].astype(np.int64)
    apart = int(end.max()) + 1  # an owner's spans lie beyond those of the owners before it
    reach = np.maximum.accumulate(owner * apart + end)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] * apart + begin[1:] > reach[:-1])))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], begin[first], reach[last] - owner[last] * apart


def _spans(texts: list[bytes], lists: pa.Array, length: int, words: int) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Of each text: maximal byte spans that its runs of windows of bytes cover, and those that all of its runs cover."""
    fields = dict(zip((f.name for f in lists.type.value_type), (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()), strict=True))
    counts = np.diff(lists.offsets.to_numpy())
    counts[np.asarray(lists.is_null())] = 0
    owner, by_word = np.repeat(np.arange(len(texts)), counts), fields["words"].astype(bool)
    first, last = fields["first"].astype(np.int64), fields["last"].astype(np.int64)
    at, begin, end = merged(owner[~by_word], first[~by_word], last[~by_word] + length)
    own, low, high = merged(owner[by_word], first[by_word], last[by_word] + words)
    for i in np.unique(own).tolist():
        a, b = np.searchsorted(own, (i, i + 1))
        starts, ends = word_bounds(np.frombuffer(texts[i], dtype=np.uint8), np.zeros(1, np.int64))
        low[a:b], high[a:b] = starts[low[a:b]], ends[high[a:b] - 1]
    every = merged(np.concatenate((at, own)), np.concatenate((begin, low)), np.concatenate((end, high)))
    return _by_owner(len(texts), at, begin, end), _by_owner(len(texts), *every)


def _by_owner(n: int, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[i].append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_REMOVED = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.bool_()), ("text", pa.string()))
REMOVED = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, text string"


def _remover(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts, rows = utf8_texts(batch.column(1)), []
            for text, spans, every in zip(texts, *_spans(texts, batch.column(2), length, words), strict=True):
                kept = _kept(text, spans) if spans else text
                left = _kept(text, every).decode("utf-8", "ignore").encode() if every else text
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), bool(every), left))
            columns = [pa.array(c, pa.binary() if n == "text" else t).cast(t) for c, (n, t) in zip(zip(*rows, strict=True), _REMOVED, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *(n for n, _ in _REMOVED)])

    return run


def _runs_by_row(rows: DataFrame, length: int, gram: int, most: int, words: int) -> DataFrame:
    """row, runs: of windows of ``length`` bytes and, if ``words`` is not 0, of so many words."""
    kinds: Kinds = {False: (length, gram)} | ({True: (words, min(WORD_GRAM, words))} if words else {})
    return repeats(rows, kinds, most).groupBy("row").agg(F.collect_list(F.struct("first", "last", "words")).alias("runs"))


def _ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own; else rows get numbers, in a written table."""
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    return ids["n"] == ids["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; and of what ``strip`` does with ``words`` (0: nothing but the above):
    repeats (something is taken out), text (what it leaves) and n_chars (its length).

    Where a removed span cuts a character, the rest of that character is left out of the text."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    key = _ids_are_keys(given)
    if not key:
        given = stored(given.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = given.select((F.col("doc_id") if key else F.col("row")).alias("row"), "text")
    per_row = _runs_by_row(rows, length, gram, most, words)
    out = rows.join(per_row, "row", "left").select("row", "text", "runs").mapInArrow(_remover(length, words), REMOVED)
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    if key:
        return out.withColumnRenamed("row", "doc_id")
    return out.join(given.select("row", "doc_id"), "row").select("doc_id", *out.columns[1:])


def _stripper(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts, own = batch.column(0).to_pylist(), utf8_texts(batch.column(0))
            for i, spans in enumerate(_spans(own, batch.column(1), length, words)[1]):
                if spans:
                    texts[i] = _kept(own[i], spans).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])

    return run


def strip(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with their columns, passages of ``length`` bytes or of ``words`` words that start elsewhere
    too taken out of ``text``; a null text stays null. Columns may have any names.

    Where a removed span cuts a character, the rest of that character is left out.
    """
    own, name = numbered_columns(docs)
    text, key = name["text"], _ids_are_keys(docs)
    rows = own.withColumn("row", F.col(name["doc_id"]).cast("long")) if key else stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    given = rows.select("row", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    per_row = _runs_by_row(given, length, GRAM, MOST, words)
    joined = rows.join(per_row, "row", "left").select(F.col(text).cast("string").alias("text"), "runs", *(c for c in own.columns if c != text))
    done = joined.mapInArrow(_stripper(length, words), joined.drop("runs").schema)
    return done.select(*("text" if c == text else c for c in own.columns)).toDF(*docs.columns)
