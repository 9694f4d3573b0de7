import random

import numpy as np
import xxhash

from weftgraph.llm import simhash as S


def brute_fp(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", " \n", "One", "É a", "a b c", "the cat sat ON the mat  x y\x1fz", "x y z " * 5000]:
        assert S.fingerprint(t) == brute_fp(t)


def test_anchors_meet_for_all_pairs_within_two():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
    for flips in ((), (3,), (50,), (1, 9), (0, 22), (23, 45), (5, 30), (22, 63)):
        other = fps.copy()
        for b in flips:
            other ^= np.uint64(1) << np.uint64(b)
        rows, at, home = S.anchors(fps)
        mine = [set() for _ in fps]
        for r, a in zip(rows, at):
            assert a not in mine[r]
            mine[r].add(a)
        rows2, at2, home2 = S.anchors(other)
        for r, a in zip(rows2[home2], at2[home2]):
            assert a in mine[r]
    assert 40 < len(rows) / len(fps) < 90


def brute_components(rows, k=3, d=2):
    fps = [brute_fp(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= d:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            low[r] = min(low.get(r, doc), doc)
    return sorted((str(doc), f"{fps[i]:016x}", str(low.get(find(i)))) for i, (doc, _) in enumerate(rows))


def test_report_matches_brute_force(spark):
    rng = random.Random(1)
    say = lambda n: [rng.choice(["a", "of", "x1", "zu", "été"] + [f"w{i}" for i in range(400)]) for _ in range(n)]
    rows = [(900, None), (901, ""), (None, "lone words here now"), (902, "a")]
    for g in range(12):
        base = say(400)
        for c in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(c // 2):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((rng.randrange(800), " ".join(copy)))
    rows += [rows[-1], rows[-1]]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.report(df).collect())
    assert got == brute_components(rows)
    assert S.report(df.limit(0)).count() == 0
    kept = S.keep_first(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({c for _, _, c in got})


def test_crowded_anchor_links_like_brute_force(monkeypatch):
    monkeypatch.setattr(S, "_PAIRS", 50)
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(46, 64, 30, dtype=np.uint64)) for _ in range(2)] + [rng.integers(0, 1 << 62, 20, dtype=np.uint64)]))
    rows, at, home = S.anchors(fps)
    a, b = S._compared(fps[rows], at, home, 2)
    label = {int(f): int(f) for f in fps} | {int(x): int(y) for x, y in zip(a, b)}
    want = {int(f): int(f) for f in fps}
    for _ in fps:
        for x in fps:
            for y in fps:
                if bin(int(x) ^ int(y)).count("1") <= 2:
                    want[int(x)] = want[int(y)] = min(want[int(x)], want[int(y)])
    assert label == want


def test_wider_thresholds_meet_halfway(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    groups = [base]
    for n in (1, 2, 3, 4, 5):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, n, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        groups.append(other)
    fps = np.unique(np.concatenate(groups))
    rows, at, home = S.anchors(fps)
    for pairs in (1 << 21, 3):
        monkeypatch.setattr(S, "_PAIRS", pairs)
        for d in (3, 4):
            a, b = S._compared(fps[rows], at, home, d)
            label = {int(f): int(f) for f in fps} | {int(x): int(y) for x, y in zip(a, b)}
            near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= d
            want = np.arange(len(fps))
            for _ in range(8):
                want = np.array([want[near[i]].min() for i in range(len(fps))])
            assert [label[int(f)] for f in fps] == [int(fps[w]) for w in want]
