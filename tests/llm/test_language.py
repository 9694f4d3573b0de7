import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import language as L

SF = "/root/testdata/sf0.001"


def brute_grams(text):
    flat, last = " ", True
    for c in (text or "").lower() + " ":
        if c.isalpha():
            flat, last = flat + c, False
        elif not last:
            flat, last = flat + " ", True
    return [flat[i : i + L.GRAM] for i in range(len(flat) - L.GRAM + 1)]


def test_grams_match_a_plain_walk():
    texts = ["", None, "Été 42 à la mer!!", "a", "ab cd", "  ß--ü  x", "one two"]
    h, rows, letters = L.gram_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        grams = brute_grams(t)
        mine = h[rows == i]
        if t and any(c.isalpha() for c in t):
            assert len(mine) == len(grams), t
            for g, x in zip(grams, mine, strict=True):
                assert seen.setdefault(g, x) == x
        assert letters[i] == sum(c.isalpha() for c in (t or "").lower())
    assert len(set(map(int, seen.values()))) == len(seen)


def test_masks_return_every_language_of_a_gram():
    grams = {n: np.arange(i * 50, i * 50 + 100, dtype=np.uint64) for i, n in enumerate("abc")}
    f = L.Filters.build(list("abc"), {n: (g, np.full(100, 5)) for n, g in grams.items()}, slots=1 << 12)
    for i, n in enumerate("abc"):
        slots = L._slots(grams[n], len(f.table), f.probes)
        mask = f.table[slots[0], 0] & f.table[slots[1], 0]
        assert ((mask >> i) & 1).all()
        for j, m in enumerate("abc"):
            shared = np.isin(grams[n], grams[m])
            assert ((mask[shared] >> j) & 1).all()


def test_many_languages_use_more_words():
    names = [f"l{i:03}" for i in range(70)]
    counts = {n: (np.arange(i * 100, i * 100 + 100, dtype=np.uint64), np.full(100, 9)) for i, n in enumerate(names)}
    f = L.Filters.build(names, counts, slots=1 << 16)
    assert f.table.shape == (1 << 16, 2)
    slots = L._slots(counts["l069"][0], len(f.table), f.probes)
    assert ((f.table[slots[0], 1] & f.table[slots[1], 1]) >> np.uint64(5) & np.uint64(1)).all()


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_decisions_match_plain_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    share = {n: {g: k / c.total() for g, k in c.items()} for n, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    least = {n: L.LEAST_COUNT if c.total() >= L.LARGE_SAMPLE else 1 for n, c in counts.items()}
    held = {n: {g for g, k in c.items() if k >= least[n] and share[n][g] * L.CONTRAST >= most[g]} for n, c in counts.items()}
    got, same = {r.doc_id: r for r in L.report(docs).collect()}, 0
    for r in rows:
        grams = brute_grams(r.text)
        part = {n: sum(g in held[n] for g in grams) / max(1, len(grams)) for n in sorted(held)}
        best = max(part.values())
        same += got[r.doc_id].lang_pred == max(part, key=part.get)
        assert abs(part.get(got[r.doc_id].lang_pred, best) - best) < 0.03 and abs(got[r.doc_id].score - best) < 0.03
    assert same >= 0.99 * len(rows)


def test_a_language_with_few_short_texts_is_learnt(spark):
    few = ["zorvax quilmet brundel", "quilmet hadrow zorvax", "brundel hadrow ximbel", "ximbel zorvax tolquen"]
    rows = [(i, "the and that of which with from " * 30, "en") for i in range(200)] + [(1000 + i, t, "zz") for i, t in enumerate(few * 3)] + [(5000, "hadrow quilmet ximbel", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.report(df).where("doc_id = 5000").first().lang_pred == "zz"


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", None), (None, "the and that", "en"), (5, "the and that " * 40, "en"), (6, "der die das " * 40, "de"), (6, "der die das " * 40, "de")],
        "doc_id long, text string, lang string",
    )
    rows = L.report(docs).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (1, 2, 3)} == {"und"} and by[3].score == 0
    assert by[None].lang_pred in ("en", "de", "und")
    assert L.report(docs.limit(0)).count() == 0
    assert L.report(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_very_long_texts(spark):
    en, de = "the and that of which with from ", "der die das und nicht mit ein "
    rows = [(i, en * 20, "en") for i in range(40)] + [(100 + i, de * 20, "de") for i in range(40)] + [(1000, en * 60_000, None), (1001, de * 60_000 + en, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.report(df).where("doc_id >= 1000").collect()}
    assert got == {1000: "en", 1001: "de"}
