"""b-bit MinHash against brute force over full sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import minhash

SCHEMA = "doc_id long, text string"


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")


def shingles(text):
    words = [w for w in words_of(text) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, least=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (low.get(find(i)), d) if x is not None]
        low[find(i)] = min(known) if known else None
    out = []
    for i, (d, _) in enumerate(rows):
        c = low[find(i)]
        out.append((d, len(sets[i]), c, None if d is None or c is None else d == c))
    return sorted(out, key=str)


def answered(spark, rows, **options):
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def made(seed, n_groups, copies, size=120):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(draw.randint(5, size))]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 3))):
                own[draw.randrange(len(own))] = word()
            rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_links_are_those_of_full_sets(spark):
    rows = made(3, 25, 6)
    assert answered(spark, rows) == brute(rows)


def test_small_blocks_say_the_same(spark, monkeypatch):
    rows = made(4, 3, 60, 80)
    monkeypatch.setattr(minhash, "SIGNATURES", 16)
    monkeypatch.setattr(minhash, "SETS", 7)
    monkeypatch.setattr(minhash, "MOST_BROADCAST", 0)
    assert answered(spark, rows) == brute(rows)


def test_groups_that_a_star_leaves_apart_are_joined(spark):
    """A chain: neighbours are similar, the smallest is similar to the next one only."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{j}" if j < 10 * i else w for j, w in enumerate(base))) for i in range(12)]
    want = brute(rows)
    assert {c for _, _, c, _ in want} == {0}
    assert answered(spark, rows) == want


def test_odd_rows(spark):
    long_text = " ".join(f"word{i % 5000}" for i in range(200_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five"), (7, long_text), (8, long_text + " end"), (None, "one two"),
        (9, "same words here again and again"), (9, "same words here again and again"), (10, "É é É é É"), (11, "é é é é é"), (None, "alone by itself without any number at all"),
    ]
    assert answered(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert answered(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e f")], SCHEMA).select("doc_id", "text", *(F.lit(7).alias(c) for c in ("unit", "_row", "_text", "component_id", "kept", "keys", "n")))
    found = minhash.near_duplicates(docs)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1, True)] and found.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("similarity", [0.5, 0.85, 0.95])
def test_low_bits_estimate_similarity(similarity):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n = 1000
        shared = round(2 * n * similarity / (1 + similarity))
        values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        one, other = values[:n], np.concatenate([values[:shared], values[n : 2 * n - shared]])
        equal = minhash.equal_places(minhash.packed(minhash.minima(one)), minhash.packed(minhash.minima(other))[None, :])
        errors.append(minhash.estimate(equal)[0] - similarity)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_packed_places_count_equal_low_bits():
    rng = np.random.default_rng(2)
    one, many = rng.integers(0, 1 << 63, minhash._PLACES, dtype=np.uint64), rng.integers(0, 1 << 63, (50, minhash._PLACES), dtype=np.uint64)
    want = ((one & np.uint64(3)) == (many & np.uint64(3))).sum(axis=1)
    assert (minhash.equal_places(minhash.packed(one), np.array([minhash.packed(m) for m in many])) == want).all()


def test_shingles_of_slices():
    texts = ["a b c d e f", "", "A b", None, "a b c d e a b c d e"]
    sizes = [c for _, _, counts in minhash.shingle_sets(pa.array(texts, pa.large_string()).fill_null("")) for c in counts.tolist()]
    assert sizes == [len(shingles(t)) for t in texts]


def test_full_sets_meet_once_for_buckets_of_the_same_units(spark, monkeypatch):
    members = spark.createDataFrame([(5, 1, 9), (5, 2, 8), (6, 1, 9), (6, 2, 8), (7, 1, 9), (7, 3, 7), (8, 1, 9)], "bucket long, unit long, root long")
    assert sorted(tuple(r) for r in minhash._one_of_equals(members).collect()) == [(5, 1, 9), (5, 2, 8), (7, 1, 9), (7, 3, 7), (8, 1, 9)]


def test_keys_of_one_unit_are_not_shuffled(spark):
    units = spark.createDataFrame([(u, [u * 1000 + i for i in range(30)] + [-7]) for u in range(200)], "unit long, keys array<long>")
    found = [tuple(r) for r in minhash._maybe_in(units, spark.createDataFrame([(-7,), (5,)], "key long")).collect()]
    assert {(-7, u) for u in range(200)} | {(5, 0)} <= set(found) and len(found) < 400
    assert minhash._maybe_in(units, spark.createDataFrame([], "key long")).count() == 0
