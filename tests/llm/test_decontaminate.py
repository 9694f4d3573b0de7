import itertools
import random
import re

import numpy as np
import pyarrow as pa

from weftgraph.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def stretch(equal):
    best = (0, 0, 0)
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            if equal[a] and equal[b - 1] and sum(equal[a:b]) * 10 >= 8 * (b - a) and b - a > best[0]:
                best = (b - a, a, b)
    return best


def brute(doc, item):
    """Longest overlap over every offset, without seeds."""
    d, t = words(doc), words(item)
    if not t or not d:
        return 0
    if len(t) < 3:
        return len(t) if d == t else 0
    if len(t) < 7:
        return len(t) if any(d[i : i + len(t)] == t for i in range(len(d))) else 0
    need, best = min(D.LEAST_OVERLAP, round(0.8 * len(t))), 0
    for shift in range(-len(t) + 1, len(d)):
        equal = [0 <= i + shift < len(d) and d[i + shift] == t[i] for i in range(len(t))]
        if sum(equal) >= 0.8 * max(need, best):
            best = max(best, stretch(equal)[0])
    return best if best >= need else 0


def test_longest_overlap():
    rng = random.Random(5)
    for _ in range(200):
        equal = [rng.random() < 0.75 for _ in range(rng.randrange(0, 40))]
        a, b = D.longest_overlap(np.array(equal, dtype=bool))
        assert b - a == stretch(equal)[0], equal


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (14, 20, 33, 8, 5, 3, 40, 10, 12, 7, 2, 1)] + [["the"] * 15]
    docs = [None, "", " ".join(items[4]), " ".join(items[5] + items[5]), "the " * 500, " ".join(items[10]), items[11][0], " ".join(say(9) + items[4] + say(9))]
    for item in items[:4] + items[6:10] + items[12:]:
        for rate in (0, 0.08, 0.15, 0.3, 0.6):
            noisy = [rng.choice(vocabulary) if rng.random() < rate else w for w in item]
            docs.append(" ".join(say(30)) + ". " + ",\n".join(noisy).upper() + "! " + " ".join(say(25)))
            docs.append(" ".join(noisy[: len(noisy) // 2]))
    docs += [" ".join(say(200)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "o") for i, t in enumerate(docs)], "doc_id long, text string, overlaps_ string")
    bench = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(items)] + [(99, None, 1)], "item_id long, text string, doc_id int")
    want = {i: {k: n for k, t in enumerate(items) if (n := brute(d, " ".join(t)))} for i, d in enumerate(docs)}
    for size in (D.BLOCK_BYTES, 3000):
        rows = D.overlaps(df, bench, block_bytes=size).collect()
        assert {r.doc_id: {o.item_id: o.tokens for o in r.overlaps} for r in rows} == want
    assert {r.doc_id for r in D.clean(df, bench).collect()} == {i for i, w in want.items() if not w}
    rows = D.report(df, bench).collect()
    assert all(r.contaminated == bool(want[r.doc_id]) for r in rows)
    assert D.report(df.limit(0), bench).count() == 0
    assert D.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_every_pattern_of_short_items():
    for n in range(7, 17):
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        block = D.Block.build([0], pa.array([" ".join(f"w{i}" for i in range(n))]))
        (_, known, _), = D.text_tokens(pa.array([" ".join(f"w{i}" for i in range(n))]).cast(pa.large_string()))
        missed = total = 0
        for equal in itertools.product((False, True), repeat=n):
            if stretch(equal)[0] >= min(13, round(0.8 * n)):
                total += 1
                missed += not block.judge(np.where(equal, known, item), np.array([n]))
        assert missed <= (0 if n < D.LONG else 0.003 * total), n


def test_finds_every_plain_passage_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [words(r.text) for r in bench.collect()]
    plain = {r.doc_id for r in docs.collect() if any(f" {' '.join(t)} " in f" {' '.join(words(r.text))} " for t in items)}
    found = {r.doc_id for r in D.report(docs, bench).where("contaminated").collect()}
    assert plain and plain <= found and len(found) < 0.2 * docs.count()


def test_very_long_texts(spark):
    rng = random.Random(11)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    filler = " ".join(f"w{rng.randrange(10**5)}" for _ in range(500_000))
    df = spark.createDataFrame([(1, f"{filler} {item}"), (2, filler), (3, f"{item} {filler} {item}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in D.report(df, bench).where("contaminated").collect()} == {1, 3}
