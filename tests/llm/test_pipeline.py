"""The pipeline's stages and whole, on a small table."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from colfold.llm import best_fit_packing, suffix_dedup


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    prose = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(100))
    texts = [*prose, prose[0], prose[1], *(f"{p} {passage}" for p in prose[2:5]), *(" ".join(rng.choice(words) + "###" for _ in range(60)) for _ in range(10)), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 125), 0) for i in range(134)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, left, str(tmp_path))
        assert after.columns == docs.columns
        left = spark.createDataFrame(after.collect(), docs.schema)
        ids = {r["doc_id"] for r in left.collect()}
        if name == "near duplicates":
            assert not ids & {120, 121} and {0, 1} <= ids
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert not set(range(125, 135)) & set(kept) and all(passage not in kept[i] for i in (122, 123, 124) if i in kept)
    want = {(r["doc_id"], r["ids_crc32"]) for r in best_fit_packing.pack(left).collect()}
    assert {(r["doc_id"], r["ids_crc32"]) for r in pipeline.run(spark, str(tmp_path)).collect()} == want


def test_short_repeated_passages_go(spark, tmp_path):
    """Passages of 51 words and more go even below 400 bytes, those of 50 stay; texts without words, nulls and repeated ids too."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    lengths = [50, *range(51, 61)]
    passages = [prose(n) for n in lengths]
    assert all(len(p) < 400 for p in passages)
    texts, want = [], []
    for n, p in zip(lengths, passages, strict=True):
        for gap in (" ", "\n"):
            before, after = prose(30), prose(30)
            texts.append(f"{before} {p.replace(' ', gap)} {after}")
            want.append(texts[-1] if n == 50 else f"{before}  {after}")
    x, y = prose(55), "".join(rng.choice("abcdefghij") for _ in range(420))
    texts += [f"é {y} a", f"ü {y} b", x, x, None, "", " \n"]
    want += ["éa", "üb", "", "", None, "", " \n"]  # the spaces around are equal bytes too
    for ids in (range(len(texts)), [i // 2 if i % 3 else None for i in range(len(texts))]):
        docs = spark.createDataFrame([(i, t, "en", str(at), len(t or "")) for at, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = {int(r["source"]): r["text"] for r in pipeline.remove_repeats(spark, docs, str(tmp_path)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_repeated_word_windows(spark):
    """Word windows against plain counting, crowded anchors included."""
    rng = random.Random(4)
    texts = []
    for _ in range(120):
        t = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(t + rng.choice([x.split() for x in texts])[:20] if texts and rng.random() < 0.4 else t))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    for length, gram, most in ((6, 2, 1000), (12, 3, 1)):
        seen = Counter(tuple(w[i : i + length]) for w in map(str.split, texts) for i in range(len(w) - length + 1))
        want = {(row, i) for row, t in enumerate(texts) for w in [t.split()] for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1}
        got = {(r["row"], i) for r in suffix_dedup.repeats(docs, {True: (length, gram)}, most).collect() for i in range(r["first"], r["last"] + 1)}
        assert got == want


def test_repeated_and_null_ids_keep_different_texts(spark, tmp_path):
    """Only near copies go, whatever the ids; of them the row with the smallest id stays, null last."""
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    own, a, b = [prose() for _ in range(12)], prose(), prose()
    rows = [(7, t) for t in own[:4]] + [(None, t) for t in own[4:8]] + list(zip(range(20, 24), own[8:], strict=True))
    rows += [(None, a), (31, f"{a} more"), (30, a), (7, b), (7, b), (5, f"{b} more")]
    docs = spark.createDataFrame([(i, t, "en", str(at), len(t)) for at, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {int(r["source"]) for r in left.collect()} == {*range(12), 14, 17}
