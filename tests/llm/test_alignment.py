"""Alignment of tokenizers against a walk over each whole text's tokens."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import alignment

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def pair():
    folder = Path(alignment.FOLDER)
    return alignment.loaded((folder / alignment.BYTE_LEVEL).read_text(encoding="utf-8"), (folder / alignment.PIECES).read_bytes())


def walked(pair, text):
    """(a ids, b ids, groups, links) of a text that its tokens spell, else None."""
    if not text:
        return None
    (a,), (b,) = pair.encoded([text])
    left, right = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if not b"".join(left) == b"".join(right) == f" {text}".encode():
        return None
    groups, links, i, j, end_a, end_b, own_a, own_b = [], [], 0, 0, len(left[0]), len(right[0]), [], []
    while i < len(a):
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append((own_a + [a[i]], own_b + [b[j]]))
            own_a, own_b, i, j = [], [], i + 1, j + 1
            if i < len(a):
                end_a, end_b = end_a + len(left[i]), end_b + len(right[j])
        elif end_a < end_b:
            own_a.append(a[i])
            i += 1
            end_a += len(left[i])
        else:
            own_b.append(b[j])
            j += 1
            end_b += len(right[j])
    return a, b, groups, links


def brute(pair, rows):
    found, docs, most = [(d, walked(pair, t)) for d, t in rows], Counter(), defaultdict(int)
    for _, f in found:
        docs.update(set(f[3]) if f else ())
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


def answered(spark, rows):
    return sorted((tuple(r) for r in alignment.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def test_documents_of_the_table(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.report(docs).collect()), key=str) == brute(pair, rows)


def odd_rows():
    draw = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "▁", "\U0001f600", "é", "12345", "don't", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1c", "​", "#$%", "hello world", "ü"]
    rows = [(i, "".join(draw.choices(parts, k=draw.randint(1, 12)))) for i in range(250)]
    return [*rows, (None, None), (400, None), (401, ""), (402, " "), (403, "the  end "), (404, " the end"), (404, " the end"), (405, "ab " * 60_000), (406, "x" * 3000), (407, "a▁b c")]


def test_odd_texts(spark, pair):
    rows = odd_rows()
    assert answered(spark, rows) == brute(pair, rows)


def test_small_chunks_say_the_same(spark, pair, monkeypatch):
    rows = odd_rows()[:80]
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 40)
    assert answered(spark, rows) == brute(pair, rows)


def test_cutting_at_spaces_changes_no_token(pair):
    assert pair.segmented
    for _, text in odd_rows():
        if not text:
            continue
        cut = alignment.segments(text)
        assert " ".join(cut) == text
        whole, parts = pair.encoded([text]), pair.encoded(cut)
        assert [whole[i][0] == [x for ids in parts[i] for x in ids] for i in (0, 1)] == [True, True], text


def test_empty_table_and_clashing_columns(spark):
    assert answered(spark, []) == [] and answered(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    docs = spark.createDataFrame([(1, "the end")], SCHEMA).select("doc_id", "text", *(F.lit(1).alias(c) for c in ("id", "chunk", "key", "n_a", "digest")))
    assert alignment.report(docs).first().n_a == 2


def test_pairs_name_the_most_frequent_partner(spark):
    found = alignment.align(spark.createDataFrame([(1, "the end"), (2, "the"), (3, "the the")], SCHEMA))
    pairs = {(r.a, r.b): (r.docs, r.best) for r in found.pairs.collect()}
    assert max(pairs.values()) == (3, True) and found.links.count() >= 2


def test_equal_groups_are_one():
    groups = alignment.Groups(np.array([1, 2, 3, 1, 2, 3, 9]), np.array([4, 5, 4, 5]), np.array([2, 3, 5, 7]), np.array([1, 2, 3, 4]))
    distinct, number = groups.interned()
    assert len(distinct) == 3 and number[0] == number[2]
    assert alignment.Groups.of_keys(groups.keys()).keys() == groups.keys()


def test_a_chunk_is_encoded_and_counted_in_parts(spark, pair, monkeypatch):
    sizes, encoded = [], alignment.Pair.encoded
    monkeypatch.setattr(alignment, "ENCODED", 7)
    monkeypatch.setattr(alignment.Pair, "encoded", lambda self, texts: sizes.append(len(texts)) or encoded(self, texts))
    texts = [f"w{i}" for i in range(40)]
    groups, per_text, good = alignment.grouped(pair, texts)
    assert sizes == [7, 7, 7, 7, 7, 5] and good.all()
    monkeypatch.setattr(alignment, "ENCODED", 4096)
    whole, of_text, _ = alignment.grouped(pair, texts)
    assert groups.keys() == whole.keys() and (per_text == of_text).all()
    monkeypatch.setattr(alignment, "COUNTED", 3)
    assert [(s.start, s.stop) for s in alignment._some_documents(np.array([2, 0, 1, 5, 0, 1, 2]))] == [(0, 3), (3, 8), (8, 11)]


def test_chunks_move_compressed(spark):
    words = 30_000
    (row,) = alignment.align(spark.createDataFrame([(1, "the end " * words)], SCHEMA)).chunks.collect()
    assert len(row.segs) < words and len(alignment._unpressed(row.segs)) >= words and len(alignment._unpressed(alignment._pressed(np.zeros(0)))) == 0
