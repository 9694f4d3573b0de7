import hashlib
import glob

import zstandard
from pyspark.sql import functions as F

from weftgraph.llm import warc as W


def test_bundle_round_trip_and_seek():
    w = W.BundleWriter(frame_bytes=1000)
    records = {f"r{i}": W.warc_record({"WARC-Type": "response", "n": str(i)}, bytes([i % 251]) * (i * 37)) for i in range(60)}
    for k, v in records.items():
        w.add(k, v)
    data = w.finish()
    assert len(W.seek_table(data)) > 5
    for name, frame, offset, length in w.index:
        assert W.read_record(data, frame, offset, length) == records[name]
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(records.values())
    assert [len(b) for _, b in W.parse_records(plain)] == [i * 37 for i in range(60)]


def brute(rows):
    first = {}
    for pid, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and pid is not None:
            first[data] = min(first.get(data, pid), pid)
    out = []
    for pid, html in rows:
        data = (html or "").encode()
        keep = first.get(data, pid) == pid
        out.append((pid, len(data), hashlib.sha256(data).hexdigest(), "response" if keep else "revisit", None if keep else first[data]))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_report_matches_brute_force(spark, tmp_path):
    long, other = "é" * 80, "x" * 99
    rows = [(5, long), (3, long), (9, long), (7, other), (8, other), (1, None), (2, ""), (4, "y" * 100), (6, "y" * 100), (None, "z\r\n\r\nWARC/1.1"), (10, "w" * 300_000)]
    df = spark.createDataFrame([(p, f"http://h/{p}\r\nX: y", h, "junk") for p, h in rows], "page_id long, url string, html string, digest string")
    got = [tuple(r) for r in W.report(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    W.write(df, f"{tmp_path}/a")
    back = {r.page_id: bytes(r.payload) for r in W.read(spark, f"{tmp_path}/a").collect() if r.payload is not None}
    assert back["3"].decode() == long and back["10"] == b"w" * 300_000 and "5" not in back
    W.export(spark, f"{tmp_path}/a", f"file://{tmp_path}/files").collect()
    assert glob.glob(f"{tmp_path}/files/*.warc.zst")
    assert W.report(df.limit(0)).count() == 0


def test_equal_rows_are_one_response(spark):
    df = spark.createDataFrame([(1, "u", "q" * 200)] * 3, "page_id long, url string, html string")
    rows = W.report(df).collect()
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in rows} == {None, 1}


def test_revisits_lead_to_their_response_through_the_index(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "page " * 40 + str(i % 7)) for i in range(60)] + [(None, "u", "none " * 40), (None, "v", "none " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write(df, f"{tmp_path}/a")
    records = W.read(spark, f"{tmp_path}/a")
    names = records.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id"))
    assert names.count() == 54
    got = {r.record_id: r for r in W.fetch(spark, f"{tmp_path}/a", names).collect()}
    assert len(got) == 8 and all(r.record_type == "response" for r in got.values())
    by_id = {str(i): h for i, _, h in rows}
    for r in records.where("record_type = 'revisit' AND page_id IS NOT NULL").collect():
        there = got[r.refers_to_record]
        assert there.page_id == r.refers_to and bytes(there.payload).decode() == by_id[r.page_id] and there.payload_digest == r.payload_digest
    assert W.fetch(spark, f"{tmp_path}/a", spark.createDataFrame([("x",), (None,)], "record_id string")).count() == 0


def test_sql_says_the_same(spark):
    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}' UNION ALL SELECT page_id + 1000, url, html FROM '{path}' WHERE page_id % 3 = 0")
    pages = spark.read.parquet(path)
    more = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000 AS page_id", "url", "html")
    got = [tuple(r) for r in W.report(pages.unionByName(more)).collect()]
    assert sorted(got, key=key) == sorted(db.execute(W.SQL).fetchall(), key=key)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in df.collect()]
    assert sorted((tuple(r) for r in W.report(df).collect()), key=key) == sorted(brute(rows), key=key)
