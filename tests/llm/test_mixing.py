import duckdb
import pytest

from weftgraph.llm import mixing as M

SF = "/root/testdata/sf0.001"


def test_targets_reshare_the_excess():
    got = M.targets({"b": 10, "a": 100, None: 1000, "c": 0})
    assert got["c"] == 0 and all(got[k] <= 2 * s for k, s in {"a": 100, "b": 10, None: 1000}.items())
    assert sum(got.values()) == pytest.approx(1.5 * 1110)
    even = M.targets({"a": 100, "b": 100, "c": 100})
    assert even == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    assert M.targets({}) == {}


def brute(rows, quality):
    import hashlib
    import math

    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goals = M.targets(sizes)
    out = []
    for source in sizes:
        epochs = int(goals[source] // sizes[source]) if sizes[source] else 0
        rest, ahead = goals[source] - epochs * sizes[source], 0

        def key(r):
            u = (int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / quality.get(r[0], 1.0), r[0] is not None, r[0] or 0, r[2])

        for r in sorted((r for r in rows if r[1] == source), key=key):
            out.append((r[0], r[2], sizes[source], goals[source], r[2] * min(2, epochs + (2 * ahead + r[2] <= 2 * rest))))
            ahead += r[2]
    return out


def test_mix_matches_brute_force(spark):
    rows = [(i, ["x", "y", None, "z"][i * 7 % 4] if i % 3 else "x", (i * 37) % 101) for i in range(300)] + [(None, "y", 5), (7, "x", 3), (7, "x", 3)]
    docs = spark.createDataFrame([(i, s, " a\n" * n if n else (None if i == 0 else ""), "t") for i, s, n in rows], "doc_id long, source string, text string, taken string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    quality = {i: 2.0 if i % 2 else 0.5 for i in range(0, 300, 3)} | {3: 1.25}
    got = sorted((tuple(r) for r in M.report(docs, labels).collect()), key=str)
    assert got == sorted(brute(rows, quality), key=str)
    for source_size, target, taken in {(r[2], r[3], sum(x[4] for x in got if x[2] == r[2])) for r in got}:
        assert abs(taken - target) <= 101
    assert all(r[4] <= 2 * r[1] for r in got)
    assert M.report(docs.limit(0), labels.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = sorted(tuple(r) for r in M.report(docs, labels).collect())
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(db.execute(M.SQL).fetchall())
    assert got == want


def test_long_texts_and_rows_without_an_identifier(spark):
    long = "word " * 400_000
    rows = [(1, long, "a"), (2, long, "b"), *((None, "w " * k, "a") for k in range(1, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = M.report(df, labels).collect()
    assert {r.size for r in got if r.doc_id} == {400_000} and len(got) == 201
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = sorted((r.size, r.taken) for r in got if r.doc_id is None)
    assert taken == sorted((r.size, r.taken) for r in M.report(df.repartition(3), labels).collect() if r.doc_id is None)
