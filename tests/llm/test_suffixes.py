import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffixes as S


def brute(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    covered = [np.zeros(len(t), bool) for t in texts]
    for spots in seen.values():
        if len(spots) > 1:
            for i, p in spots:
                covered[i][p : p + length] = True
    out = []
    for t, c in zip(texts, covered):
        edge = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        out.append((len(t), int(c.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["été", "the", "of", "zu", "x"]) + str(rng.randrange(900)) for _ in range(k))
    shared = [say(k) for k in (70, 75, 90, 200, 66)]
    texts = []
    for _ in range(n):
        parts = [say(rng.randrange(1, 90)) for _ in range(rng.randrange(0, 4))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            a = rng.randrange(0, 30)
            parts.insert(rng.randrange(len(parts) + 1), s[a:] if rng.random() < 0.5 else s)
        texts.append(" ".join(parts))
    copy = list(texts[3] + say(300))
    texts += ["".join(copy), "".join(copy[:700]) + "!" + "".join(copy[701:]), "a" * 1000, "ab" * 500, "a" * 399, "", texts[5], texts[5]]
    return texts


def test_collection_bwt_finds_repeats():
    rng = random.Random(1)
    texts = []
    for g in range(6):
        core = bytes(rng.randrange(97, 100) for _ in range(900))
        for _ in range(5):
            a = rng.randrange(0, 200)
            t = bytearray(core[a : a + rng.randrange(400, 700)])
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = 65
            texts.append((bytes(t), 300 - a, g))
    rng.shuffle(texts)
    got = S.repeated_starts(*([t for t, _, _ in texts], *(np.array([x[k] for x in texts]) for k in (1, 2))))
    count = {}
    for t, _, _ in texts:
        for p in range(len(t) - 399):
            count[t[p : p + 400]] = count.get(t[p : p + 400], 0) + 1
    for (t, _, _), flags in zip(texts, got):
        assert flags.tolist() == [count[t[p : p + 400]] > 1 for p in range(len(t) - 399)]


@pytest.mark.parametrize("group", [1000, 3])
def test_report_matches_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    texts = corpus(group)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (5, texts[5]), (3, "other " + texts[3]), (None, texts[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")
    want = brute([(t or "").encode() for _, t in rows], 400)
    got = [tuple(r) for r in S.report(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    assert sum(r[2] for r in got) > 5000
    assert S.report(df.limit(0)).count() == 0


def test_a_passage_with_other_surroundings_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 5)
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(450)
    texts = [say(rng.randrange(300, 900)) + passage[rng.randrange(0, 30) : 450 - rng.randrange(0, 30)] + say(500) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([t.encode() for t in texts], 400)
    assert [tuple(r)[1:] for r in S.report(df).orderBy("doc_id").collect()] == want


def test_kept_bytes(spark):
    texts = corpus(9)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in S.removed(df, with_bytes=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    want = {i: w for (i, _), w in zip(rows, brute([t for _, t in rows], 400))}
    assert {r.doc_id: tuple(r)[1:] for r in S.report(docs).collect()} == want


def test_very_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_300_000))
    other = long[700_000:700_450] + "".join(rng.choice("qrstuvwxyz ") for _ in range(5_000))
    df = spark.createDataFrame([(1, long), (2, other), (3, other[460:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.report(df).collect()}
    assert got[1] == (1_300_000, 450, 1) and got[2] == (5_450, 5_440, 2) and got[3] == (4_990, 4_990, 1)
