"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of the segments' bit
counts. The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.
Embeddings are kept in unary, so that this distance is the bit count of an exclusive or. The grid: the 32
dimensions form GROUPS slabs. Two points within distance 2 differ in at most two slabs, so they agree on one
of the choices of GROUPS - 2 slabs, and that choice with the counts in it is a grid cell that both enter.
Inside a cell the lower bound is tested, then the exact Hamming distance.

Only distinct fingerprints take part, so copies never pair up. A cell with more than MOST members (a large
group of near copies) is not joined pairwise: each member names its 64 one-bit neighbours and itself, and
members that name the same one are within two bits, exactly; a name has at most 65 members.

By similarity (``similar_groups``). Texts that share 0.8 of their sets of five-word shingles lie about ten bits
apart, beyond any radius that a grid can search. There the grid is one source of candidates and bands of
minimal hashes are the other (BANDS of ROWS; a pair at 0.8 misses all of them once in 2,800 times). Every
candidate is verified on the whole shingle sets. A band with more than MOST_BAND members is not joined
pairwise: all are compared with the one whose shingles are the most common, and those that this leaves apart are
joined exactly, by the rarest shingles of each set (``_crowded_links``).

Edge cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other.
Repeated rows and ties share a fingerprint and a component. An empty table gives no rows. Extra columns are
ignored. A null doc_id is no component's smallest unless all are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import small_batches, stored, text_column, utf8_texts
from colfold.llm.components import roots

RADIUS = 2
SHINGLE = 3
SEGMENTS = 32
GROUPS = 6
MOST = 64
#: Bytes of text in a batch, and bytes of one long text that are worked on at once.
BATCH_BYTES = 1 << 19
PART = 1 << 18
SIMILAR_SHINGLE = 5
#: Bands, minimal hashes in each, and members of a band that are still paired.
BANDS, ROWS = 20, 5
MOST_BAND = 32
#: Rounds of comparing a crowded band with one member, and the ratio of sizes that its exact join takes together.
HUBS = 2
SIZE_STEP = 1.05
_EVEN = 0x5555555555555555
_BLANK = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: bytes, n: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 (seed 42) of every shingle of ``n`` words, repeats included, those of about PART bytes at a time; ASCII letters are lower-cased."""
    words, at, whole = [], 0, True
    while at < len(text):
        cut = _BLANK.search(text, at + PART)
        stop = cut.end() if cut else len(text)
        words += text[at:stop].lower().split()
        at = stop
        if len(words) >= n:
            yield _hashed(words, n)
            words, whole = words[len(words) - n + 1 :], False
    if words and whole:
        yield [xxhash.xxh64_intdigest(b" ".join(words), 42)]


def _hashed(words: list[bytes], n: int) -> list[int]:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[n:], strict=False)]


def fingerprints(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes."""
    out = np.zeros((len(texts), 8), dtype=np.uint8)
    for i, text in enumerate(texts):
        ones, total = np.zeros(64, dtype=np.int64), 0
        for hashes in shingle_hashes(text, n):
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        out[i] = np.packbits(2 * ones > total, bitorder="little")
    return out.view("<u8").ravel()


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.array(x, dtype=np.uint64) for x in shingle_hashes(text, n))]))


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """One key for each band of minimal hashes; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full(len(factors), ~np.uint64(0), dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        mixed = (part ^ (part >> np.uint64(31)))[None, :] * factors[:, None]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def _fingerprinter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(utf8_texts(batch.column(1)), n).view(np.int64))], names=["doc_id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(_fingerprinter(n), "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Counts of the two-bit segments, each in unary: bit 0 for one at least, bit 1 for two."""
    high = F.shiftrightunsigned(fp, 1)
    even = F.lit(_EVEN)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slabs(groups: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` slabs among ``groups``."""
    edges = [SEGMENTS * i // groups for i in range(groups + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(masks, agree)]


def links(nodes: DataFrame, radius: int = RADIUS, groups: int = GROUPS, most: int = MOST) -> DataFrame:
    """nodes: distinct fp. u, v: links that connect exactly what pairs within ``radius`` (2 at most) bits connect."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    masks = _slabs(groups, groups - radius)
    cells = F.array(*[F.struct(F.lit(i).alias("slab"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    entered = nodes.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.inline(cells))
    sizes = stored(entered.groupBy("slab", "cell").count().where("count > 1"), "cells")
    small = entered.join(sizes.where(F.col("count") <= most).drop("count"), ["slab", "cell"])
    a, b = small.alias("a"), small.alias("b")
    near = (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= radius) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    pairs = a.join(b, (F.col("a.slab") == F.col("b.slab")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") > F.col("b.fp")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = sizes.where(F.col("count") > most).drop("count")
    if crowded.isEmpty():
        return pairs
    members = entered.join(crowded, ["slab", "cell"]).select("fp").distinct()
    flips = [0] if radius < 1 else [0, *(_signed(1 << i) for i in range(64))]
    named = members.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("name"))
    if radius == 1:  # one flip on one side only: the name has to be a fingerprint itself
        hub = named.join(members.select(F.col("fp").alias("name")), "name").select(F.col("fp").alias("u"), F.col("name").alias("v"))
    else:
        hub = named.groupBy("name").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("u"), F.array_min("all").alias("v"))
    return pairs.unionByName(hub.where("u != v"))


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: doc_id, fp. Adds component_id, the smallest doc_id reachable over links."""
    prints = stored(prints, "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = roots(links(nodes.select("fp"), radius))
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.where(F.col("fp") != F.col("root")).select("root", "least").unionByName(rooted.where(F.col("fp") == F.col("root")).select("root", "least")).groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return components(with_fingerprints(docs, n), radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = utf8_texts(batch.column(1))
            sets = [shingle_set(x, n) for x in texts]
            columns = [
                batch.column(0),
                pa.array(fingerprints(texts, n).view(np.int64)),
                pa.array([_signed(_set_key(x)) for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([band_keys(x, factors) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key", "size", "bands"])

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = [shingle_set(x, n) for x in utf8_texts(batch.column(1))]
            right = [i for i, (x, k) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if _signed(_set_key(x)) == k]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(_set_key(sets[i])) for i in right], pa.int64()), pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))], names=["key", "hashes"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of u, v whose sets of hashes are so similar."""
    a, b = sets.select(F.col("key").alias("u"), F.col("hashes").alias("ha")), sets.select(F.col("key").alias("v"), F.col("hashes").alias("hb"))
    both, common = F.size("ha") + F.size("hb"), F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "u").join(b, "v").where(common * (1 + similarity) >= similarity * both - 1e-9).select("u", "v")


def _crowded_links(crowded: DataFrame, sets: DataFrame, similarity: float) -> list[DataFrame]:
    """crowded: band, key. Links u, v that connect exactly what similar pairs inside the bands connect.

    Members of a band are compared with its most common member, those unlike it once more with theirs. Pairs that
    these links leave apart have a member outside the group of its band's first hub; such members meet all others by
    a prefix join: tokens in one order from rare to common, one shared token near the front of both, and as many left
    behind it as the sizes ask for.
    """
    t, slack = similarity, 1e-9
    bucket = lambda size: F.floor(F.log(size) / F.log(F.lit(SIZE_STEP)))
    tokens = sets.join(crowded.select("key").distinct(), "key", "left_semi").select("key", F.explode("hashes").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    placed = tokens.join(often, "token", "left").select("key", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token").alias("x"))
    ordered = placed.groupBy("key").agg(F.count("*").alias("size"), F.avg(F.log("x.n")).alias("common"), F.sort_array(F.collect_list("x")).alias("tokens"))
    length = (F.col("size") - F.ceil(t * F.col("size") - slack) + 1).cast("int")
    ordered = stored(ordered.select("key", "size", "common", F.slice("tokens", F.lit(1), length).alias("tokens")), "ordered")
    rank = ordered.select("key", "common")
    left, found, first = crowded, [], None
    for _ in range(HUBS):
        drawn = stored(left.join(rank, "key").groupBy("band").agg(F.max_by("key", F.struct("common", "key")).alias("v")), "hubs")
        first = drawn if first is None else first
        tried = left.join(drawn, "band").where("key != v").select("band", F.col("key").alias("u"), "v")
        linked = stored(_verified(tried.select("u", "v").distinct(), sets, t), "similar")
        found.append(linked)
        left = stored(tried.join(linked, ["u", "v"], "left_anti").select("band", F.col("u").alias("key")), "crowded")
    root = roots(_union(found))
    named = stored(ordered.join(root, ordered["key"] == root["node"], "left").select("key", "size", F.coalesce("root", "key").alias("label"), "tokens"), "labelled")
    label = named.select("key", "label")
    hubs = first.join(label, first["v"] == label["key"]).select("band", F.col("label").alias("hub"))
    apart = crowded.join(label, "key").join(hubs, "band").where("label != hub").select("key").distinct()
    entries = lambda df: df.select("key", "size", "label", F.posexplode("tokens").alias("at", "x")).select("key", "size", "label", "at", "x.n", "x.token").where("n > 1").drop("n")
    reach = F.least((F.col("size") - F.col("at")) * ((1 + t) / t) - F.col("size"), F.col("size") / t) + slack
    asking = entries(named.join(apart, "key", "left_semi")).withColumn("lowest", F.greatest(t * F.col("size") - slack, F.lit(1.0))).where(reach >= F.col("lowest"))
    a = asking.select("token", "key", "size", "label", "at", F.explode(F.sequence(bucket(F.col("lowest")), bucket(reach))).alias("bucket")).alias("a")
    b = entries(named).withColumn("bucket", bucket(F.col("size"))).alias("b")
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    enough = rest * (1 + t) >= t * (F.col("a.size") + F.col("b.size")) - slack
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & enough)
    pairs = stored(met.select(F.greatest("a.key", "b.key").alias("u"), F.least("a.key", "b.key").alias("v")).distinct(), "candidates")
    return [*found, stored(_verified(pairs, sets, t), "similar")]


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every


def similar_groups(docs: DataFrame, n: int = SIMILAR_SHINGLE, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over pairs whose sets of ``n``-word shingles are so similar.

    Equal sets are one node, texts without words one more; copies never pair up.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    sketches = stored(texts.mapInArrow(_sketcher(n), "doc_id long, fp long, key long, size long, bands array<long>"), "sketches")
    nodes = stored(sketches.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    by_print = nodes.groupBy("fp").agg(F.min("key").alias("hub"))
    same = nodes.join(by_print, "fp").where("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    near = links(by_print.select("fp"), radius).distinct()
    hub = lambda c: by_print.select(F.col("fp").alias(c), F.col("hub").alias(f"_{c}"))
    grid = near.join(hub("u"), "u").join(hub("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    entered = nodes.select("key", "size", F.explode("bands").alias("band"))
    counts = stored(entered.groupBy("band").count().where("count > 1"), "bands")
    members = entered.join(counts, "band")
    small = members.where(F.col("count") <= MOST_BAND)
    a, b = small.select("band", F.col("key").alias("u"), F.col("size").alias("su")), small.select("band", F.col("key").alias("v"), F.col("size").alias("sv"))
    alike = F.least("su", "sv") >= similarity * F.greatest("su", "sv") - 1e-9
    pairs = a.join(b, "band").where((F.col("u") > F.col("v")) & alike).select("u", "v")
    candidates = stored(pairs.unionByName(grid).unionByName(same).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
    crowded = stored(members.where(F.col("count") > MOST_BAND).select("band", "key"), "crowded")
    needed = candidates.select(F.col("u").alias("key")).unionByName(candidates.select(F.col("v").alias("key"))).unionByName(crowded.select("key")).distinct()
    no_id = F.lit(-(1 << 63))
    sources = nodes.join(needed, "key", "left_semi").select("key", F.coalesce("least", no_id).alias("_id"))
    sets = stored(texts.withColumn("_id", F.coalesce("doc_id", no_id)).join(sources, "_id").select("key", "text").mapInArrow(_setter(n), "key long, hashes array<long>").dropDuplicates(["key"]), "sets")
    found = [stored(_verified(candidates, sets, similarity), "similar")]
    if not crowded.isEmpty():
        found += _crowded_links(crowded, sets, similarity)
    root = roots(_union(found))
    rooted = nodes.join(root, nodes["key"] == root["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id")
    return sketches.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
