"""The text operators against plain versions on small tables, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from colfold.llm import best_fit_packing, media_columns, quality_classifier, quality_rules, sentence_pieces, sharding, simhash_near_dedup, suffix_dedup, token_counts, warc_segments
from colfold.llm.common import DEFAULT_TOKENIZER, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, bin int, fp string, shard string, key string, part string"


def make(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, "f", "g", "k", "p") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def sample_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    out[3:6] = [out[2]] * 3
    return [*out, None, "", "   ", "\n\t", "One", "A" * 3000, "word " * 9000]


def rows(df):
    return [r.asDict() for r in df.collect()]


OPERATORS = {
    "pack": lambda d, lab: best_fit_packing.pack(d),
    "media": lambda d, lab: media_columns.digests(media_columns.to_media(d)),
    "tokens": lambda d, lab: token_counts.count(d),
    "rules": lambda d, lab: quality_rules.judge(d, lab),
    "shard": lambda d, lab: sharding.shard(d),
    "pieces": lambda d, lab: sentence_pieces.round_trip(d),
    "suffix": lambda d, lab: suffix_dedup.remove(d),
    "simhash": lambda d, lab: simhash_near_dedup.near_duplicates(d),
    "similar": lambda d, lab: simhash_near_dedup.similar_groups(d),
    "classify": lambda d, lab: quality_classifier.resample(d, lab),
}
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_cases(spark, name):
    """An empty table gives no rows; repeated and null ids, null and empty texts give as many documents as came in."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], LABELS)
    assert OPERATORS[name](make(spark, []).where("doc_id = 0"), labels.where("false")).count() == 0
    got = OPERATORS[name](make(spark, ["a b", "a b", None, "", "x y z"], [1, 1, None, 3, 3]), labels)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([1, 1, None, 3, 3])


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = sample_texts()
    got = rows(best_fit_packing.pack(make(spark, texts)))
    encoder = Tokenizer.from_file(tokenizer_path(DEFAULT_TOKENIZER))
    total = 0
    for i, text in enumerate(texts):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += len(ids)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 1


def test_best_fit_prefers_the_tightest():
    bins, places, used = best_fit_packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(used.tolist()) == [10, 10] and bins[0] == bins[2] and places[2] == 6


@pytest.mark.parametrize("name", sorted(media_columns.FILTERS))
def test_media_filters(name):
    data = np.random.default_rng(0).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes()
    media = media_columns.encode(data, 64, name, chunk=100)
    assert media_columns.decode(media).tobytes() == data
    broken = bytearray(media)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media_columns.decode(bytes(broken))


def test_mixed_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 20), dtype=np.uint8)
    kinds = rng.integers(0, 5, 12)
    wide = np.zeros((13, 21), dtype=np.int16)
    wide[1:, 1:] = image
    filtered = np.stack([np.append(k, (image[y].astype(np.int16) - media_columns._predicted(int(k), wide[y + 1, :-1], wide[y, 1:], wide[y, :-1])) & 255) for y, k in enumerate(kinds)]).astype(np.uint8)
    assert (media_columns.unfilter(filtered) == image).all()


def test_media(spark):
    texts = sample_texts()
    for r in rows(media_columns.digests(media_columns.to_media(make(spark, texts)))):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    back = {r["doc_id"]: bytes(r["payload"]) for r in rows(media_columns.from_media(media_columns.to_media(make(spark, texts))))}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_token_tree():
    counts, rng = token_counts.counts_of(tokenizer_path(token_counts.TOKENIZER)), random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("ab c'\n s1!  é") for _ in range(rng.randint(0, 120)))
        tree = token_counts.CountedText(text, counts, leaf=rng.choice([1, 2, 5]))
        for _ in range(6):
            b = rng.randint(0, len(text) + 3)
            e, new = b + rng.choice([0, 1, 3, 40]), "".join(rng.choice("ab '\n é") for _ in range(rng.choice([0, 1, 20])))
            tree.edit(b, e, new)
            text = text[:b] + new + text[min(e, len(text)) :] if b <= len(text) else text + new
            assert tree.text == text and tree.n_tokens == len(counts.encode(text))


def test_token_counts(spark):
    texts, counts = sample_texts(), token_counts.counts_of(tokenizer_path(token_counts.TOKENIZER))
    for r in rows(token_counts.count(make(spark, texts))):
        text = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(counts.encode(text))
        for b, e, new in token_counts.sample_edits(len(text)):
            b, e = min(b, len(text)), min(e, len(text))
            text = text[:b] + new + text[e:]
        assert r["n_tokens_after"] == len(counts.encode(text))


def test_rule_features():
    rng = random.Random(2)
    for _ in range(100):
        text = " ".join(rng.choice("ab") if rng.random() < 0.9 else "c#\n" for _ in range(rng.randint(0, 60)))
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.split()]
        assert quality_rules.text_features(text.encode())[:5] == (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(covered))


def test_risk_control():
    """The binomial test is exact, the choice is made on one half, the proof on the other stops at the first failure,
    a rule without gain stays off, and strata with few labels are joined."""
    assert quality_rules.below_limit(0, 600, 0.01, 0.0025) and not quality_rules.below_limit(0, 590, 0.01, 0.0025)
    rules = list(quality_rules.RULES)
    steps = lambda **k: tuple(k.get(r, 0) for r in rules)
    clean, long, loud = steps(), steps(word_length=6), steps(upper_share=8)
    first = {(False, True, clean): 500, (False, False, long): 50, (False, False, loud): 30, (False, False, clean): 5}
    choose = lambda held, **strata: quality_rules.choose_cutoffs({"en": {**first, **held}, **strata})
    both = {("en", "word_length"): 40.0, ("en", "upper_share"): 0.9}
    assert choose({(True, True, clean): 500}) == both
    assert choose({(True, True, clean): 500, (True, True, long): 5, (True, True, loud): 4}) == both
    assert choose({(True, True, clean): 500, (True, True, loud): 60}) == {("en", "word_length"): 40.0}
    assert choose({(True, True, clean): 500, (True, True, long): 60}) == {}
    assert choose({(True, True, clean): 20}) == {}
    assert quality_rules.choose_cutoffs({"en": {(False, True, long): 3, **first, (True, True, clean): 500}}) == {("en", "upper_share"): 0.9}
    few = {(True, True, clean): 50, (False, False, long): 9}
    got = choose({(True, True, clean): 500}, de=few, fr=few, es={(True, True, clean): 5})
    assert got == both | {(s, "word_length"): 40.0 for s in ("de", "fr", "es")}
    assert quality_rules.choose_cutoffs({}) == {}


def test_false_rejection_stays_below_the_limit():
    """Over many draws of labels from rules that reject six in a hundred good documents, a proof hardly ever passes."""
    rng = np.random.default_rng(0)
    rules, passed = list(quality_rules.RULES), 0
    hit, clean = tuple(8 if r == "upper_share" else 0 for r in rules), (0,) * len(rules)
    for _ in range(400):
        wrong = int(rng.binomial(400, 0.06))
        passed += bool(quality_rules.choose_cutoffs({"en": {(False, True, clean): 400, (False, False, hit): 100, (True, True, clean): 400 - wrong, (True, True, hit): wrong}}))
    assert passed <= 400 * 0.05


def test_rules_find_planted_junk(spark):
    rng = random.Random(4)
    clean = [" ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 999)}" for _ in range(30)) for _ in range(2000)]
    junk = [" ".join(f"{rng.randint(0, 999)}###" for _ in range(30)) for _ in range(200)]
    docs = make(spark, clean + junk)
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in range(0, 2200)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in rows(quality_rules.judge(docs, labels))}
    assert all(kept[i] == (i < 2000) for i in kept)
    assert quality_rules.keep(docs, labels).count() == 2000


def test_sharding(spark):
    texts = sample_texts(300) + ["same text"] * 200
    got = rows(sharding.shard(make(spark, texts)))
    assert len(got) == len(texts)
    shard_of, slots, sizes = {}, {}, Counter()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes"
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(shard_of.values()) < 16


def test_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        items = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 80)))
        sizes = np.array(sorted(items, reverse=True))
        counts = np.array([items[s] for s in sizes])
        free: list[int] = []
        for s in sizes.tolist():
            for _ in range(items[s]):
                fits = [i for i, f in enumerate(free) if f >= s]
                i = min(fits, key=lambda i: (free[i], i)) if fits else len(free)
                if i == len(free):
                    free.append(60)
                free[i] -= s
        runs = sharding.fewest_shards(sizes, counts, 60)
        assert max(r[0] for r in runs) + 1 == len(free) and sum(r[2] for r in runs) == sum(items.values())
        equal = sharding.near_equal(sizes, counts, 4)
        load = Counter()
        for s, i, n in equal:
            load[s] += int(sizes[i]) * n
        assert set(load) <= set(range(4)) and sum(load.values()) == int((sizes * counts).sum())


def test_sentence_pieces(spark):
    import sentencepiece

    rng = random.Random(6)
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sentence_pieces.MODEL))
    texts = [*("".join(rng.choice("abc eth  inr\n\t日é😀1'#") for _ in range(rng.randint(0, 60))) for _ in range(300)), *sample_texts(30)]
    for r in rows(sentence_pieces.round_trip(make(spark, texts))):
        want = np.array(model.encode(texts[r["doc_id"]] or ""), dtype="<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(want) and r["n_pieces"] == len(want) // 4 and r["restored"]


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows():
    rng = random.Random(7)
    for length in (1, 2, 3, 5, 8):
        for alphabet in (b"ab", b"abcd"):
            for _ in range(15):
                parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(length, length + 20))) for _ in range(rng.randint(1, 6))]
                seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
                want = [seen[p[i : i + length]] > 1 for p in parts for i in range(len(p) - length + 1)]
                assert suffix_dedup.repeated_windows(parts, np.array([len(p) - length + 1 for p in parts]), length).tolist() == want


@pytest.mark.parametrize("most", [1000, 2])
def test_suffix_dedup(spark, most):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    passages = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(100):
        t = " ".join(rng.choice(words) + (str(rng.randint(0, 999)) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.6:
            t += rng.choice(passages)[: rng.randint(5, 60)] + str(rng.randint(0, 99)) + t[:10]
        texts.append(rng.choice(texts) if texts and rng.random() < 0.1 else t)
    texts += ["", "a" * 100, "a" * 19, "a" * 20]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.remove(make(spark, texts), 20, 6, most))}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 20)


def test_simhash(spark):
    rng = random.Random(9)
    base = [" ".join(str(rng.randint(0, 50)) for _ in range(rng.randint(3, 200))) for _ in range(60)]
    texts = [*base, *(b + " extra" for b in base), *[base[0]] * 5, None, "", " \n", "Word", "word"]
    got = {r["doc_id"]: r for r in rows(simhash_near_dedup.near_duplicates(make(spark, texts)))}
    prints = []
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[j : j + 3]), 42) for j in range(max(1, len(words) - 2))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        assert got[i]["fingerprint"] == f"{prints[-1]:016x}"
    check_components({i: r["component_id"] for i, r in got.items()}, prints)


@pytest.mark.parametrize("most", [32, 2])
def test_similar_groups(spark, most, monkeypatch):
    """Groups over five-word shingles at 0.8 as all pairs give them, with a crowd that is not paired; shared passages alone link nothing."""
    monkeypatch.setattr(simhash_near_dedup, "MOST_BAND", most)
    rng = random.Random(12)
    draw = lambda n: [str(rng.randint(0, 500)) for _ in range(n)]
    base = [draw(rng.randint(4, 150)) for _ in range(30)]
    crowd, passage = draw(300), draw(60)

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = "x" + str(rng.random())
        return words

    lists = [*base, *(edited(b, rng.choice([0, 1, 2, 3])) for b in base), *(edited(crowd, rng.randint(0, 4)) for _ in range(40)), *(passage + draw(80) for _ in range(10)), *[base[0]] * 3]
    texts = [*(" ".join(x) for x in lists), None, "", " \n", "Word", "word"]
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash_near_dedup.similar_groups(make(spark, texts)))}
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and (a == b or 10 * len(a & b) >= 8 * len(a | b)):
                    label[i], changed = label[j], True
    assert [got[i] for i in range(len(texts))] == label


def check_components(component, prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [component[i] for i in range(len(prints))] == label


@pytest.mark.parametrize("most", [64, 3])
def test_crowded_cells(spark, most):
    """A crowd of near fingerprints is linked as pairs would link it, with and without the exact way for crowds."""
    rng = random.Random(10)
    centre = rng.getrandbits(63)
    prints = [centre, *(centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(60)), *(rng.getrandbits(63) for _ in range(40))]
    nodes = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash_near_dedup.links(nodes, most=most).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    order = sorted(set(prints))
    parent = {p: p for p in order}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    check_components({i: order.index(root(p)) for i, p in enumerate(order)}, order)


def test_warc(spark):
    rng = random.Random(11)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("<a>éx \n") for _ in range(rng.choice([0, 10, 70_000])))) for i in range(40)]
    pages += [(40, None, None), (41, "u", ""), (42, "u v", pages[5][2]), (43, "u", pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    for r in rows(warc_segments.round_trip(df)):
        html = dict((p[0], p[2]) for p in pages)[r["page_id"]] or ""
        origin = first[html]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), warc_segments.payload_digest(html.encode()))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == r["page_id"] else ("revisit", origin))
    back = {r["page_id"]: r["payload"] for r in rows(warc_segments.read(warc_segments.write(df), payloads=True))}
    whole = next(p for p in pages if len(p[2] or "") == 70_000)
    assert bytes(back[whole[0]]) == whole[2].encode() and back[43] is None
    assert warc_segments.round_trip(df.where("false")).count() == 0


def test_warc_errors():
    with pytest.raises(ValueError):
        warc_segments.reassembled([{"number": 1, "total": None, "page": "a: b", "block": b"x"}, {"number": 3, "total": 2, "page": None, "block": b"y"}])
    with pytest.raises(ValueError):
        warc_segments.reassembled([{"number": 1, "total": 5, "page": "a: b", "block": b"x"}])
    with pytest.raises(ValueError):
        warc_segments.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_classifier(spark):
    rng = random.Random(12)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW$$", "***"]) for _ in range(40)) for _ in range(100)]
    docs = make(spark, [*good, *bad, None])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], LABELS)
    got = {r["doc_id"]: r for r in rows(quality_classifier.resample(docs, labels))}
    held_out = range(1, 400, 2)
    assert sum(got[i]["kept"] == (i < 300) for i in held_out) >= 198
    assert sum(r["kept"] for r in quality_classifier.resample(docs, labels, k=123).collect()) == 123
    assert quality_classifier.keep(docs, labels.where("false")).count() == 401


def test_gumbel_top_k_samples_by_weight(spark):
    """Over many documents of two weights, the shares of a top-k sample follow the weights."""
    df = spark.range(40_000).selectExpr("id as doc_id", "if(id % 2 = 0, ln(3.0D), 0.0D) as _w_log", "70L as _w_grams")
    level = quality_classifier.level_for_k(df, 400)
    kept = [r["doc_id"] for r in df.where(quality_classifier.noisy_mean() >= level).collect()]
    assert len(kept) == 400 and 0.67 < sum(i % 2 == 0 for i in kept) / 400 < 0.83


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_classifier_rejects_bad_documents_of_every_length(spark, sf):
    """Bad documents are never fitted as target; the level is set on good ones only."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = quality_classifier.resample(docs, labels).join(labels, "doc_id").collect()
    share = lambda some: sum(not r["kept"] for r in some) / len(some)
    bad = [r for r in got if r["quality"] == 0]
    short, good = [r for r in bad if r["n_grams"] < 400], [r for r in got if r["quality"] == 1 and r["toxic"] == 0]
    print(f"sf{sf}: rejected bad {share(bad):.3f} of {len(bad)}, short bad {share(short):.3f} of {len(short)}, good {share(good):.4f} of {len(good)}")
    assert share(bad) > 0.6 and share(short) > 0.5 and share(good) < 0.01


def test_toxic_documents_are_rejected(spark):
    """Held-out documents that differ from good ones by a word that only labelled toxic documents have."""
    rng = random.Random(13)
    prose = lambda: [rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(40)]
    texts = [" ".join(prose()) for _ in range(300)] + [" ".join([*prose()[:20], rng.choice(["scum", "idiot"]), *prose()]) for _ in range(100)]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 400, 2)], LABELS)
    got = {r["doc_id"]: r["kept"] for r in rows(quality_classifier.resample(docs, labels))}
    assert not any(got[i] for i in range(300, 400)) and sum(got[i] for i in range(300)) >= 295
    assert {r["doc_id"] for r in rows(quality_classifier.keep(docs, labels))} == {i for i in got if got[i]}
    assert rows(quality_classifier.good_ids(spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0), (3, 1, 1), (4, 1, None), (5, None, 1)], LABELS)).orderBy("_g_id")) == [{"_g_id": 1}, {"_g_id": 4}]
