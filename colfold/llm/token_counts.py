"""Edit-aware token counts: a segment tree over a document's pre-tokens, re-encoded only around edits.

A pre-token here is a run of white space with the run of other characters behind it. The tokenizer's own
pattern never matches across the end of such a pair, so its token count stands alone and is cached by worker.
Leaves of the tree hold LEAF pre-tokens, inner nodes the characters and tokens below them. An edit descends to
the leaves it touches, takes in one more pre-token on either side (an edit at a boundary may lengthen or join
them), cuts and encodes that region anew, and updates the sums on the way up.

Edge cases: a null or empty text has no tokens. Edits beyond the end are clipped to it. Edits may insert,
delete or replace, and may overlap; each applies to the text that earlier ones left. Repeated rows are counted
one by one. Extra columns are ignored. Memory is that of one batch and one document's tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import small_batches, text_column, tokenizer_path

TOKENIZER = "byte_bpe_50k.tiktoken"
LEAF = 64
MOST_WORDS = 700_000
BATCH_BYTES = 4 << 20
#: Unicode white space; the standard library's \s has four control characters more.
_SPACE = "\t-\r \x85\xa0  -     　"
_PRETOKEN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class TokenCounts(dict):
    """Number of tokens by pre-token."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = n = len(self.encode(word))
        return n


_COUNTS: dict[str, TokenCounts] = {}


def counts_of(path: str) -> TokenCounts:
    if path not in _COUNTS:
        _COUNTS[path] = TokenCounts(path)
    return _COUNTS[path]


class CountedText:
    """A text under edit whose token count is always known."""

    def __init__(self, text: str, counts: TokenCounts, leaf: int = LEAF):
        self.counts, self.leaf, self.encoded = counts, leaf, 0
        words = _PRETOKEN.findall(text)
        self._build([words[i : i + leaf] for i in range(0, len(words), leaf)] or [[]])

    def _build(self, leaves: list[list[str]]) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        count = self.counts.__getitem__
        for i, words in enumerate(leaves, self.size):
            self.chars[i] = sum(map(len, words))
            self.tokens[i] = sum(map(count, words))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one with any, and the characters before it."""
        if not self.chars[1]:
            return 0, 0
        node, before = 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, words: list[str]) -> None:
        self.leaves[leaf] = words
        node = leaf + self.size
        chars, tokens = sum(map(len, words)), sum(map(self.counts.__getitem__, words))
        self_chars, self_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += self_chars
            self.tokens[node] += self_tokens
            node //= 2

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace characters begin to end by ``new``."""
        total = self.chars[1]
        begin, end = min(begin, total), min(max(begin, end), total)
        first, before = self._find(begin - 1)
        last, _ = self._find(end)
        while last + 1 < len(self.leaves):  # what follows the touched pre-token may be joined to it
            last += 1
            if self.leaves[last]:
                break
        words = [w for i in range(first, last + 1) for w in self.leaves[i]]
        at, low, high, place = before, 0, len(words), before
        for i, w in enumerate(words):
            if at + len(w) < begin:
                low, place = i, at
            if at > end:
                high = min(high, i + 1)
                break
            at += len(w)
        region = "".join(words[low:high])
        changed = _PRETOKEN.findall(region[: begin - place] + new + region[end - place :])
        if high < len(words) and changed and not changed[-1].strip():  # trailing white space belongs to the next one
            changed = [*changed[:-1], changed[-1] + words[high]]
            high += 1
        self.encoded += len(changed)
        words[low:high] = changed
        if len(words) > 8 * self.leaf * (last - first + 1):
            flat = [*(w for leaf in self.leaves[:first] for w in leaf), *words, *(w for leaf in self.leaves[last + 1 :] for w in leaf)]
            self._build([flat[i : i + self.leaf] for i in range(0, len(flat), self.leaf)] or [[]])
            return
        each = -(-len(words) // (last - first + 1)) or 1
        for k, i in enumerate(range(first, last + 1)):
            self._set(i, words[k * each : (k + 1) * each])


def sample_edits(n_chars: int) -> list[tuple[int, int, str]]:
    """The edits of the query: a replacement, a deletion and an insertion at places that the length fixes."""
    return [(n_chars // 3, n_chars // 3 + 5, " revised"), (n_chars // 2, n_chars // 2 + 7, ""), (2 * n_chars // 3, 2 * n_chars // 3, " and a new clause, inserted")]


def _counter(path: str, edits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = []
            for text in batch.column(1).to_pylist():
                tree = CountedText(text, counts)
                n, todo = tree.n_tokens, edits(len(text))
                for edit in todo:
                    tree.edit(*edit)
                rows.append((n, len(todo), tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded"])

    return run


def count(docs: DataFrame, edits=sample_edits, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_reencoded (pre-tokens encoded for the edits)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(_counter(tokenizer or tokenizer_path(TOKENIZER), edits), "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long")
