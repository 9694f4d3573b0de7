import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from weftgraph.llm import decontaminate, digest, language, mixing, secrets, simhash, webtext
from tests.llm.test_decontaminate import brute as overlap
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = "".join(random.Random(0).choice("qxzwkjvþđħ ") for _ in range(600))
    odd = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "12 34", None, "src1", 5), (10**6 + 2, noise, None, "src1", 600)], docs.schema)
    docs = docs.unionByName(odd)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    kept = P.identify_language(spark, docs, SF)
    assert kept.columns == COLUMNS
    before, now = rows_of(docs), rows_of(kept)
    assert set(before) - set(now) >= {10**6, 10**6 + 1, 10**6 + 2} and len(now) > 0.97 * len(before)

    alone = P.drop_near_duplicates(spark, kept, SF)
    assert alone.columns == COLUMNS
    first = {int(c) for _, _, c in brute_components([(i, r.text) for i, r in now.items()], P.SHINGLE, P.THRESHOLD)}
    want = brute_kept({i: now[i].text for i in sorted(first)})
    now = rows_of(alone)
    assert set(now) == want

    clean = P.decontaminate_benchmark(spark, alone, SF)
    assert clean.columns == COLUMNS
    some = sorted(now)[:25]
    left = rows_of(clean)
    for i in some:
        assert (i in left) == (not any(overlap(now[i].text, t) for t in items)), i

    masked = P.redact_secrets(spark, clean, SF)
    assert masked.columns == COLUMNS
    for i, r in rows_of(masked).items():
        assert r.n_chars == len(r.text)
        spans = secrets.find_spans(left[i].text)
        assert (r.text == left[i].text) == (not spans)
        assert not [s for s in secrets.find_spans(r.text) if s[1] < 3]

    mixed = P.mix_sources(spark, masked, SF)
    assert mixed.columns == [*COLUMNS, "size", "source_size", "target", "taken"]
    redacted = rows_of(masked)
    for r in mixed.collect():
        assert [r[c] for c in COLUMNS] == [redacted[r.doc_id][c] for c in COLUMNS]
        assert r.size == len(masked_words(r.text)) and 0 <= r.taken <= 2 * r.size
    totals = mixed.groupBy("source", "target").sum("size", "taken").collect()
    goals = mixing.targets({r.source: r["sum(size)"] for r in totals})
    assert all(abs(goals[r.source] - r.target) < 1e-6 for r in totals)


def masked_words(text):
    return text.split()


CLASHES = ["_lang", "_score", "_row", "_ID", "_overlaps", "overlaps", "fp", "component_id", "size", "taken", "target", "_source", "score", "Spans"]
REPLACED = {"size", "taken", "target"}


def test_clashing_columns_survive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i if i % 2 else f"v{i}"))
    plain = docs.select(COLUMNS)
    for (_, stage), last in zip(P.STAGES, [False] * 4 + [True]):
        docs, plain = stage(spark, docs, SF), stage(spark, plain, SF)
        assert set(docs.columns) >= set(COLUMNS + CLASHES)
        row = docs.first()
        assert all(row[n] == (i if i % 2 else f"v{i}") for i, n in enumerate(CLASHES) if not last or n not in REPLACED)
        assert sorted(map(str, docs.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_operators_replace_columns_of_their_own_names(spark):
    docs = spark.createDataFrame([(i, f"word {i} the and of", "en", "s", "x", "y", "z", 1, 2) for i in range(20)], "doc_id long, text string, lang string, source string, fp string, fingerprint string, overlaps string, size int, target int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert simhash.near_duplicates(docs).count() == 20
    assert digest.fingerprints(docs).select("fingerprint").distinct().count() == 20
    assert decontaminate.overlaps(docs, bench).where("size(overlaps) > 0").count() == 0
    assert mixing.mix(mixing.with_sizes(docs)).where("size = 5").count() == 20
    assert language.identify(docs, language.train(docs), lang_as="lang").count() == 20
    pages = spark.createDataFrame([("u", "<p>a</p>", 1, "h")], "url string, html string, text int, _host string")
    assert [tuple(r) for r in webtext.extract(pages).collect()] == [("u", "a")]


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, docs.collect())) == sorted(map(str, P.run(spark, SF).collect()))


def test_long_texts_and_repeated_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"the{rng.randrange(40_000)} of and" for _ in range(60_000))
    rows = [(1, long, "en", "a", None), (2, long + " end", "en", "a", None), (2, long + " end", "en", "a", None), (3, "of and the " * 9, "en", None, None), (3, "of and the " * 9, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert sorted((r.doc_id, len(r.text)) for r in docs.collect()) == [(1, len(long)), (3, 99)]


def test_empty_tables_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
