import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lmscore as L

SF = "/root/testdata/sf0.001"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def brute(rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in words(t))
    two = Counter(p for t in train for p in zip([None, *words(t)], words(t)))
    n, v = sum(one.values()), len(one)
    q = lambda c, pair=False: float(L.quantised(np.array([c]), L.PAIR_LEVELS if pair else L.LEVELS)[0])
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        own = 0.0
        for a, b in zip([None, *w], w):
            k = L.KAPPA[0] * max(1, q(one[a])) ** L.KAPPA[1]
            own += math.log10((q(two[a, b], True) + k * (q(one[b]) + 1) / (n + v + 1)) / (q(one[a]) + k))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, base, own))
    return out


def test_levels():
    assert L.level(np.array([0, 1, 2, 3, 4, 5])).tolist() == [0, 1, 2, 3, 4, 5]
    c = np.array([7, 100, 12345, 10**9])
    assert (abs(np.log(L.quantised(c) / c)) < 0.13).all()


def test_filter_returns_levels():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = rng.geometric(0.5, 20_000)
    bits = L.build_filter(keys & np.uint64((1 << 48) - 1), L.level(counts))
    read = L.probed(bits, keys & np.uint64((1 << 48) - 1), len(L.LEVELS))
    assert (read >= L.level(counts)).all()
    assert (read == L.level(counts)).mean() > 0.98
    assert (L.probed(bits, rng.integers(0, 1 << 48, 20_000, dtype=np.uint64), len(L.LEVELS)) > 0).mean() < 0.01


@pytest.mark.parametrize("chunk_bytes", [L.CHUNK_BYTES, 20_000])
def test_matches_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(L.score, "__defaults__", ("text", chunk_bytes))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6, None), (10**6 + 1, " \n"), (None, "The of"), (7, "a\x1fb A\x1fB"), (8, "of the " * 50_000)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    want = sorted(brute(rows), key=str)
    got = sorted((tuple(r) for r in L.report(df).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    off = abs(np.array([g[6] for g in got]) / np.array([w[6] for w in want]) - 1)
    assert off.max() < 0.05 and off.mean() < 0.005


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b a b", "x", 3.5, [1, 2]), (2, "a b", None, None, None)], "id long, body string, `odd name` string, score double, n_known array<int>")
    got = L.score(df, F.lit(None).cast("boolean") | (F.col("id") == 1), "body")
    assert got.columns == ["id", "odd name", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    assert [(r.id, r["odd name"], r.n_tokens, r.n_known, r.train_tokens) for r in got.orderBy("id").collect()] == [(1, "x", 5, 5, 5), (2, None, 3, 3, 5)]


def test_model_beats_the_base_on_held_out(spark):
    rows = L.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.report(df).count() == 0
    only = spark.createDataFrame([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    r = L.report(only).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0)
