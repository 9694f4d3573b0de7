import hashlib

from weftgraph.llm import digest as D


def brute(rows):
    """rows: (doc_id, text) with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        same = lambda a, b: float(D.canonical(a) == D.canonical(b))
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), same(t, new), same(t, after))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    got = D.report(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want
    texts = dict(rows)
    for a in got:
        for b in got:
            assert (a.fingerprint == b.fingerprint) == (D.canonical(texts[a.doc_id]) == D.canonical(texts[b.doc_id]))


def test_canonical_folds():
    assert D.canonical("  Ａ Straße\n\tÉ ") == D.canonical("a strasse É") == "a strasse é"
    assert D.canonical(None) == D.canonical(" \n") == ""
    assert D.canonical("ﬁ ΟΔΟΣ") == D.canonical("FI οδος")


def test_report_matches_brute_force(spark):
    check(spark, [(9, "abcd"), (3, None), (4, ""), (5, "Ab  CD"), (6, "ab cd"), (7, "𝄞é" * 50), (100, "x"), (-2, "long " * 30_000), (8, "ab cd"), (None, "none")])
    check(spark, [(1, "alone")])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    assert D.report(df).count() == 5
    assert D.report(df.limit(0)).count() == 0


def test_collisions_are_told_apart_by_bytes(spark):
    texts = [f"text {i % 40}" for i in range(80)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    rows = D.fingerprints(df, bits=4).collect()
    assert len(rows) == 80 and max(len(r.fingerprint) for r in rows) > 1
    for a in rows:
        for b in rows:
            assert (a.fingerprint == b.fingerprint) == (a.text == b.text)
