"""Ranked search against DuckDB and against brute force over all documents."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import search

SF = "/root/testdata/sf0.001"
SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(rows, items, k=10):
    texts = [search.term_list(t) for _, t in rows]
    documents, total = sum(map(bool, texts)), sum(map(len, texts))
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for i, text in items:
        found = []
        for (d, _), t in zip(rows, texts, strict=True):
            score = 0
            for w in set(search.term_list(text)):
                if tf := t.count(w):
                    m = 10 + (90 * len(t) * documents) // total
                    score += search.weight(df[w], documents) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def answered(spark, rows, items, **options):
    found = search.search(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS), **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query_says_what_its_sql_says(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = search.report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(search.SQL).fetchall())


def made(n, seed):
    draw = random.Random(seed)
    word = lambda: f"w{min(int(draw.expovariate(0.05)), 400)}"
    rows = [(i, " ".join(word() for _ in range(draw.randint(0, 60)))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(25)]  # ties beyond ten
    draw.shuffle(rows)
    return rows, [(i, " ".join(word() for _ in range(draw.randint(1, 12)))) for i in range(15)] + [(99, rows[0][1]), (100, rows[3][1])]


def test_every_shard_size_says_what_brute_force_says(spark, monkeypatch):
    rows, items = made(700, 5)
    want = brute(rows, items)
    assert answered(spark, rows, items) == want
    monkeypatch.setattr(search, "SHARD_BYTES", 700)
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "FAN", 2)
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    assert answered(spark, rows, items) == want
    assert answered(spark, rows, items, k=3) == brute(rows, items, 3)


def test_odd_rows(spark):
    long_text = "alpha " * 400_000 + "beta"
    rows = [(1, None), (2, ""), (3, "--- !!"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha beta"), (5, long_text), (6, "Été alpha"), (7, "été"), (8, "gamma2x")]
    items = [(1, "ALPHA beta alpha"), (1, "alpha"), (2, None), (3, "..."), (4, "été"), (None, "gamma2x"), (5, "unknown")]
    assert answered(spark, rows, items) == brute(rows, [i for i in items if i[1]])


def test_empty_tables_and_clashing_columns(spark):
    assert answered(spark, [], [(1, "a")]) == [] and answered(spark, [(1, "a")], []) == [] and answered(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], SCHEMA).select("doc_id", "text", *(F.lit(1).alias(c) for c in ("id", "item", "score", "rank", "shard", "n")))
    got = search.search(docs, spark.createDataFrame([(5, "a", 9)], f"{ITEMS}, rank int"))
    assert [(r.item_id, r["rank"], r.doc_id) for r in got.collect()] == [(5, 1, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_best_first_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(0, 6, (4, 500)) * (rng.random((4, 500)) < 0.2)
    weights, ids = rng.integers(1, 5, 4), rng.permutation(500).tolist()
    scores = weights @ matrix
    for least in (0, int(np.sort(scores)[-3])):
        want = sorted(((-int(s), i) for s, i in zip(scores, ids, strict=True) if s >= max(least, 1)))[:10]
        assert search.best_in_shard(matrix, weights, ids, 10, least) == [(-s, i) for s, i in want]
