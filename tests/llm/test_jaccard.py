import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_simhash import brute_components
from weftgraph.llm import jaccard


def shingled(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(texts, least=0.8):
    ids, sets = list(texts), {i: shingled(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a) >= least * len(b) and len(b) >= least * len(a) and len(a & b) >= least * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def near_copies(rng, n, words=200):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def stage(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in dict(P.STAGES)["SimHash near-dedup"](spark, df, "").collect()}


def test_the_stage_leaves_no_similar_pair(spark):
    rng = random.Random(3)
    texts = dict(enumerate(t for _ in range(20) for t in near_copies(rng, 6)))
    first = {int(c) for _, _, c in brute_components(list(texts.items()), P.SHINGLE, P.THRESHOLD)}
    want = brute_kept({i: t for i, t in texts.items() if i in first})
    assert len(want) < len(first)  # fingerprints alone leave some
    assert stage(spark, texts) == want


def similar_dropped(df):
    rows = df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("doc_id").alias("_row"))
    gone = {r[0] for r in jaccard.later_rows(rows, 5).collect()}
    return {r.doc_id for r in df.collect()} - gone


def test_bands_meet_as_often_as_they_should():
    rng = np.random.default_rng(1)
    met = []
    for least in (0.8, 0.5):
        n = 0
        for _ in range(200):
            common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            own = round(400 * (1 / least - 1))
            left, right = (np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in (own // 2, own - own // 2))
            n += int((jaccard.bands(left) == jaccard.bands(right)).sum())
        met.append(n / 200 / jaccard.BANDS)
    assert abs(met[0] - 0.8**7) < 0.03 and abs(met[1] - 0.5**7) < 0.01


def test_large_buckets_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    monkeypatch.setattr(jaccard, "SHARED", 2)
    rng = random.Random(4)
    texts = dict(enumerate([*near_copies(rng, 90, 100), *near_copies(rng, 60, 60)]))
    assert similar_dropped(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == brute_kept(texts)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in sorted(docs.collect())}
    assert similar_dropped(docs) == brute_kept(texts)
