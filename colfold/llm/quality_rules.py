"""Quality rules whose cutoffs are chosen under a proven limit on false rejection.

Each rule bounds one ratio of a text. Labels are split in halves by a hash. On the first half every rule of a
stratum gets the cutoff with the largest gain: labelled bad documents rejected, less COST for each good one, the
loosest of equals; rules without a gain stay off. The others are put in the order of their gains. The second half,
held out, is for the proof: a rule is added to those before it if an exact binomial test shows that all of them
together reject a share of good documents below the limit. The order is fixed before the held-out documents are looked
at and the tests stop at the first failure, so they need no correction among themselves (a fixed sequence); over
strata the error is divided (Bonferroni). Strata whose held-out good documents are too few for any test to pass are
judged as one, and so share their cutoffs.

Edge cases: a null or empty text has no words and fails the base rule. Without labels, or with too few, no
rule beyond the base is on. A null stratum is a stratum of its own. Repeated rows are judged one by one; a
document labelled more than once counts once, as bad if any label says so or calls it toxic. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colfold.llm.common import numbered_columns, small_batches, stored, truth, utf8_texts

SYMBOLS = b"#*$%&|<>"
BATCH_BYTES = 1 << 20
#: Share of good documents of a stratum that all rules together may reject, and the chance that this fails.
RISK, DELTA = 0.05, 0.05
#: Of the hash that halves the labels.
SEED = 29
#: Bad documents that one wrongly rejected good document outweighs.
COST = 20
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
_UPPER = bytes(range(65, 91))
#: Cutoffs of each rule, from the loosest to the tightest; larger ratios are rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (4.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "exclaim_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
}


def repeated_window_words(words: list[bytes], n: int = 5) -> int:
    """Words inside windows of ``n`` words that occur at least twice."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    windows = list(zip(*(words[i : len(words) - n + 1 + i] for i in range(n)), strict=True))
    if len(set(windows)) == count:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=count))
    np.add.at(covered, at, 1)
    np.subtract.at(covered, at + n, 1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def text_features(text: bytes) -> tuple[int, ...]:
    """The counts named in FEATURES. ``bytes.split`` cuts at exactly space and 0x09 to 0x0D."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        text.count(b"!"),
    )


def _featurer(at: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, BATCH_BYTES):
            rows = np.array([text_features(x) for x in utf8_texts(batch.column(at))], dtype=np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=[*batch.schema.names, *(f"_q_{f}" for f in FEATURES)])

    return run


def with_features(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with a column ``_q_<feature>`` for each of FEATURES."""
    docs = docs.withColumn(column, F.col(column).cast("string"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"_q_{f}", T.LongType()) for f in FEATURES)])
    return docs.mapInArrow(_featurer(docs.columns.index(column), column), schema)


def base_failed() -> Column:
    return (F.col("_q_n_words") < 10) | (100 * F.col("_q_n_repeat_words") > 20 * F.col("_q_n_words"))


def ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("_q_n_words"), F.lit(1)), F.greatest(F.col("_q_n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("_q_n_symbols") / words,
        "dup_line_share": F.col("_q_n_dup_lines") / lines,
        "upper_share": F.col("_q_n_upper") / F.greatest(F.col("_q_word_chars"), F.lit(1)),
        "exclaim_per_word": F.col("_q_n_exclaim") / words,
        "word_length": F.col("_q_word_chars") / words,
    }


def below_limit(rejected: int, n: int, limit: float, delta: float) -> bool:
    """Exact binomial test: at a true share of ``limit``, so few rejections have at most chance ``delta``."""
    if n == 0:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(limit) + (n - k) * math.log1p(-limit) for k in range(rejected + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(delta)


#: Labelled documents of a stratum: how many, by (held out, good, how many of each rule's cutoffs they exceed).
Counts = dict[tuple[bool, bool, tuple[int, ...]], int]


def pooled(counts: dict[str, Counts], risk: float = RISK, delta: float = DELTA) -> tuple[dict[str, Counts], dict[str, str]]:
    """Strata with those joined that can prove nothing alone, and the name of each one's own stratum."""
    held = {s: sum(n for (out, good, _), n in c.items() if out and good) for s, c in counts.items()}
    few = {s for s, n in held.items() if not below_limit(0, n, risk, delta / len(counts))}
    of = {s: f"few labels: {', '.join(sorted(few))}" if s in few else s for s in counts}
    out: dict[str, Counts] = {}
    for s, c in sorted(counts.items()):
        for key, n in c.items():
            mine = out.setdefault(of[s], {})
            mine[key] = mine.get(key, 0) + n
    return out, of


def choose_cutoffs(counts: dict[str, Counts], risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule). Cutoffs are nested: whoever exceeds j of n cutoffs exceeds the j tightest."""
    sizes = [len(c) for c in RULES.values()]
    above = lambda steps, r, i: steps[r] >= sizes[r] - i
    joint, of = pooled(counts, risk, delta) if counts else ({}, {})
    chosen: dict[str, dict[str, float]] = {}
    for stratum, own in joint.items():
        wanted = []
        for r, (rule, cutoffs) in enumerate(RULES.items()):
            gains = [sum(n * (-COST if good else 1) for (out, good, steps), n in own.items() if not out and above(steps, r, i)) for i in range(len(cutoffs))]
            if (best := max(gains)) > 0:
                wanted.append((-best, r, rule, gains.index(best)))
        held = [(good, steps, n) for (out, good, steps), n in own.items() if out and good]
        total, taken = sum(n for _, _, n in held), []
        for _, r, rule, i in sorted(wanted):
            rejected = sum(n for _, steps, n in held if any(above(steps, q, j) for q, j in [*taken, (r, i)]))
            if not below_limit(rejected, total, risk, delta / len(joint)):
                break
            taken.append((r, i))
            chosen.setdefault(stratum, {})[rule] = RULES[rule][i]
    return {(s, rule): c for s in of for rule, c in chosen.get(of[s], {}).items()}


def calibrate(featured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from all labelled documents. What is collected are counts by stratum, label, half and the
    numbers of cutoffs exceeded: some 60,000 rows a stratum at the very most, whatever the input's size."""
    known = truth(labels).where("_l_quality is not null or _l_toxic > 0").select("_l_id", F.expr("if(_l_toxic > 0, 0, _l_quality)").alias("_l_quality"))
    exceeded = F.array(*[sum(((value > c).cast("int") for c in RULES[name]), F.lit(0)) for name, value in ratios().items()])
    held_out = F.pmod(F.xxhash64(F.lit(SEED), "_l_id"), F.lit(2)) == 1
    rows = (
        featured.where(~base_failed())
        .select(F.col("doc_id").cast("long").alias("_d_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), exceeded.alias("e"))
        .join(known, F.col("_d_id") == F.col("_l_id"))
        .groupBy("stratum", (F.col("_l_quality") == 1).alias("good"), held_out.alias("held_out"), "e")
        .count()
        .collect()
    )
    counts: dict[str, Counts] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["held_out"], r["good"], tuple(r["e"])] = r["count"]
    return choose_cutoffs(counts, risk, delta)


def verdict(cutoffs: dict[tuple[str, str], float], stratum: str = "lang") -> Column:
    """True for a document that neither the base nor a rule of its stratum rejects."""
    key, bad = F.coalesce(F.col(stratum).cast("string"), F.lit("")), base_failed()
    for name, value in ratios().items():
        own = [x for (s, rule), c in sorted(cutoffs.items()) if rule == name for x in (F.lit(s), F.lit(c))]
        if own:
            bad = bad | F.coalesce(value > F.try_element_at(F.create_map(*own), key), F.lit(False))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    featured = stored(with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum, "text")).drop("text"), "features")
    cutoffs = calibrate(featured, labels, stratum)
    return featured.select("doc_id", *(F.col(f"_q_{f}").alias(f) for f in FEATURES[:5]), base_failed().alias("base_failed"), verdict(cutoffs, stratum).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    narrow = with_features(docs.select("doc_id", stratum, "text")).drop("text")  # no text is shuffled to meet its label
    cutoffs = calibrate(narrow, labels, stratum)
    own, name = numbered_columns(docs)
    return with_features(own, name["text"]).where(verdict(cutoffs, name[stratum])).select(*own.columns).toDF(*docs.columns)
