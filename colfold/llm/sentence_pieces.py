"""SentencePiece encoding and decoding by suffix-array matching and relaxation.

Text is cut where no piece can lie across: before a run of word marks and at characters that no piece holds.
Units not met before are joined to one text and indexed by a suffix array (to the longest piece's length);
every piece is binary-searched for the range of its occurrences; the resulting edges, sorted by position, are
relaxed from left to right. For a byte-pair model relaxation is not over scores: the last token of a prefix
is the one edge whose piece and the last token before it are what merging their joined characters gives, and
that token is unique. Pairs are tested once by merging and remembered. A unit that begins with several word
marks (pieces of equal score) or that no path covers is merged directly.

A character without a piece becomes the pieces of its UTF-8 bytes.

Edge cases: a null or empty text has no pieces. A word mark in the text is read as a blank. Repeated rows are
encoded one by one. Extra columns are ignored. Long texts are streamed unit by unit; a unit may be of any
length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import small_batches, text_column, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Letters of the longest unit that the index takes; its levels grow with the longest.
LONGEST_UNIT = 1000
MOST_UNITS = 600_000
BATCH_BYTES = 4 << 20
#: Characters of units that are indexed at once.
INDEXED = 1 << 19


class PieceModel:
    """Pieces, scores and the encoder's memory of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.vocab_size()
        self.piece = [model.id_to_piece(i) for i in range(self.n)]
        plain = [i for i in range(self.n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [self.piece[i].replace(MARK, " ").encode() for i in range(self.n)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        for i in range(self.n):
            if model.is_control(i):
                self.raw[i] = b""
        chars = sorted({c for p in self.id for c in p})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.barrier = "".join(c for c in "\n\t\r" if c not in self.code)
        b = re.escape(self.barrier) or "￾"
        self.units = re.compile(f"[{b}]|{MARK}*[^{MARK}{b}]+|{MARK}+").findall
        self.depth = max(map(len, self.id))
        self.pieces = [p for p in self.id if self.merged(p) == [p]]  # others are never made by merging
        self.keys = self._packed([[self.code[c] for c in p] for p in self.pieces])
        self.tokens = np.array([self.id[p] for p in self.pieces], dtype=np.int64)
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.raw_sizes = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.plain = self.barrier.startswith("\n")

    def units_of(self, text: str) -> list[str]:
        """The text cut where no piece lies across, blanks as word marks."""
        if not text:
            return []
        if self.plain and text[0] != " " and "  " not in text and "\t" not in text and "\r" not in text and MARK not in text:
            first, *lines = text.split("\n")
            units = [MARK + w for w in first.split(" ")]
            for line in lines:  # no two blanks meet, so a line's words are its units
                head, *rest = line.split(" ")
                units.append("\n")
                if head:
                    units.append(head)
                units += [MARK + w for w in rest]
            return units
        return self.units(MARK + text.replace(" ", MARK))

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-scored neighbours first, the leftmost of equals: a heap of neighbours
        by score and place, where those that have changed meanwhile are passed over."""
        n, score = len(text), self.score
        ends = list(range(1, n + 1))  # where the part that begins at a place ends; 0 if none begins there
        before = list(range(-1, n - 1))  # where the part before it begins
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (s := score.get(text[i : ends[j]])) is not None:
                heappush(heap, (-s, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            if i:
                offer(before[i])
        parts, at = [], 0
        while at < n:
            parts.append(text[at : ends[at]])
            at = ends[at]
        return parts

    @property
    def _bits(self) -> int:
        return max(1, len(self.code) + 1).bit_length()

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        """Rows of codes packed into as few 63-bit columns as hold them, in order."""
        each = 63 // self._bits
        out = []
        for a in range(0, codes.shape[1], each):
            column = np.zeros(len(codes), dtype=np.int64)
            for i in range(a, a + each):
                column <<= self._bits
                if i < codes.shape[1]:
                    column |= codes[:, i]
            out.append(column)
        return np.stack(out)

    def _packed(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest key with each row as prefix."""
        low = np.zeros((len(rows), self.depth), dtype=np.int64)
        high = np.full((len(rows), self.depth), (1 << self._bits) - 1, dtype=np.int64)
        for i, r in enumerate(rows):
            low[i, : len(r)] = r
            high[i, : len(r)] = r
        return self._columns(low), self._columns(high)

    @staticmethod
    def _search(columns: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
        """For each key, how many of the sorted rows lie before it (or at it too, with ``after``)."""
        low, high = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], columns.shape[1], np.int64)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for c in range(len(columns)):
                x = columns[c][middle]
                less |= equal & (x < keys[c])
                equal &= x == keys[c]
            less = (less | equal if after else less) & open_
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and index of the piece of every occurrence, sorted by start."""
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((codes, np.zeros(self.depth - 1, np.int64))), self.depth)
        columns = self._columns(rows)
        array = np.lexsort(columns[::-1])
        columns = columns[:, array]
        low, high = self._search(columns, self.keys[0], False), self._search(columns, self.keys[1], True)
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        start = array[np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        order = np.argsort(start, kind="stable")
        return start[order], piece[order]

    def _joined(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether two tokens stay apart, and stay as they are, when merged together."""
        key = before * (self.n + 1) + token
        kinds, inverse = np.unique(key, return_inverse=True)
        out = np.zeros(len(kinds), dtype=bool)
        for i, k in enumerate(kinds.tolist()):
            if (known := self.pairs.get(k)) is None:
                a, b = divmod(k, self.n + 1)
                known = True if self.n in (a, b) else self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
                if len(self.pairs) >= 2_000_000:
                    self.pairs.clear()
                self.pairs[k] = known
            out[i] = known
        return out[inverse]

    def learn(self, units: list[str]) -> None:
        """Encode units not met before, in one index; those of several word marks or of many letters are merged directly."""
        if len(self.known) + len(units) > MOST_UNITS:
            self.known.clear()
        direct = [u for u in units if len(u) > LONGEST_UNIT or u.startswith(MARK * 2)]
        for u in direct:
            self.known[u] = self._ids([self.id.get(p, p) for p in self.merged(u)])
        if direct:
            units = [u for u in units if not (len(u) > LONGEST_UNIT or u.startswith(MARK * 2))]
        if not units:
            return
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        text = "\0".join(units) + "\0"
        get = self.code.get
        codes = np.array([get(c, 0) for c in text], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        start, piece = self._edges(codes)
        unknown = np.flatnonzero(codes == 0)
        unknown = unknown[~np.isin(unknown, ends)]
        start = np.concatenate((start, unknown))
        token = np.concatenate((self.tokens[piece], np.full(len(unknown), self.n)))
        end = start + np.concatenate((self.lengths[piece], np.ones(len(unknown), np.int64)))
        depth = end - begins[np.searchsorted(begins, start, side="right") - 1]
        order = np.lexsort((start, depth))
        start, token, end, depth = start[order], token[order], end[order], depth[order]
        last = np.full(len(codes) + 1, -1, dtype=np.int64)  # last token of the prefix that ends before a place
        back = np.full(len(codes) + 1, -1, dtype=np.int64)
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[begins] = True
        edges = np.append(np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))), len(depth)) if len(depth) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            s, t, e = start[a:b], token[a:b], end[a:b]
            ok = first[s]
            inner = np.flatnonzero(~ok & (last[s] >= 0))
            ok[inner] = self._joined(last[s[inner]], t[inner])
            last[e[ok]], back[e[ok]] = t[ok], s[ok]
        last_, back_ = last.tolist(), back.tolist()
        for unit, begin, end_ in zip(units, begins.tolist(), ends.tolist(), strict=True):
            at, ids = end_, []
            while at > begin and last_[at] >= 0:
                ids.append(last_[at] if last_[at] < self.n else text[at - 1])
                at = back_[at]
            if at > begin:
                ids = [self.id.get(p, p) for p in self.merged(unit)][::-1]
            self.known[unit] = self._ids(ids[::-1])

    def _ids(self, parts: list[int | str]) -> bytes:
        """Ids end to end; what is no piece stands as its bytes."""
        return np.array([x for i in parts for x in ((i,) if isinstance(i, int) else (self.byte[b] for b in i.encode()))], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, waiting, new, held = [], [], {}, 0
        for text in texts:
            units = self.units_of(text)
            waiting.append(units)
            for u in set(units).difference(self.known):
                if u not in new:
                    new[u] = None
                    held += len(u) + 1
            if held >= INDEXED:
                out += self._flush(waiting, list(new))
                waiting, new, held = [], {}, 0
        return out + self._flush(waiting, list(new))

    def _flush(self, waiting: list[list[str]], new: list[str]) -> list[bytes]:
        if new:
            before = self.known
            if len(before) + len(new) > MOST_UNITS:  # what these texts need stays
                self.known = {u: before[u] for units in waiting for u in units if u in before}
            known, self.known = self.known, {}
            self.learn(new)
            known.update(self.known)
            self.known = known
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in waiting]

    def decode(self, ids: bytes) -> str:
        """The text of ids, all of its pieces' bytes gathered at once."""
        tokens = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        sizes = self.raw_sizes[tokens]
        place = np.repeat(self.raw_starts[tokens] - (np.cumsum(sizes) - sizes), sizes)
        text = self.flat[place + np.arange(len(place))].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids = model.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit ids in a binary column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(_encoder(model or tokenizer_path(MODEL)), "doc_id long, ids binary")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in small_batches(batches, "ids", BATCH_BYTES):
            texts = [model.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(model or tokenizer_path(MODEL)), "doc_id long, text string")


def _tripper(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            ids = model.encode(texts)
            back = [model.decode(x) for x in ids]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([a.replace(MARK, " ") == b for a, b in zip(texts, back, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "restored"])

    return run


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, restored (the decoded pieces are the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(_tripper(model or tokenizer_path(MODEL)), "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, restored boolean")
