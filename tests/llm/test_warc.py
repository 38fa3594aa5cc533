from pyspark.sql import functions as F

from tagweave.llm import warc

SCHEMA = ("record_id string, type string, url string, ts long, status int, reason string, "
          "headers array<struct<name:string,value:string>>, body string, doc string")


def rows(spark, *records):
    full = [(i, kind, url, ts, status, "", headers, body, "x") for i, kind, url, ts, status, headers, body in records]
    return spark.createDataFrame(full, SCHEMA)


TAG = [("ETag", '"a"'), ("X-Age", "0"), ("Content-Type", "text/html")]


def outcome(spark, *records):
    return {r.record_id: (r.outcome, r.refers_to, r.body) for r in warc.resolve(rows(spark, *records)).collect()}


def test_canonical_urls(spark):
    urls = {"HTTP://Ex.Org:80": "http://ex.org/", "https://ex.org:443/A?b=2&a=1#x": "https://ex.org/A?a=1&b=2",
            "http://ex.org/?utm_source=f&ref=x&reference=1": "http://ex.org/?reference=1", "http://ex.org:8080/a": "http://ex.org:8080/a",
            "": "/", "no url": "no url"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r[0]: r[1] for r in df.select("url", warc.canonical_url(df.url)).collect()}
    assert got == urls


def test_latest_earlier_full_response(spark):
    got = outcome(
        spark, ("1", "response", "http://a/x", 10, 200, TAG, "old"), ("2", "response", "http://a/x", 20, 200, TAG, "new"),
        ("3", "response", "http://a/x", 25, 404, TAG, "gone"), ("4", "revisit", "HTTP://A/x#t", 30, 304, [("ETag", 'W/"a"')], None),
        ("5", "revisit", "http://a/x", 15, 304, [("etag", '"b"')], None), ("6", "revisit", "http://a/x", 5, 304, TAG, None),
        ("7", "response", "http://a/x", 40, 200, TAG, "late"), ("8", "revisit", None, 50, 304, TAG, None),
        ("9", "revisit", "http://b/x", 50, 304, None, None), ("a", "revisit", "http://a/x", 45, 304, None, None))
    assert got == {"4": ("resolved", "2", "new"), "5": ("mismatch", "1", None), "6": ("no_earlier", None, None),
                   "8": ("no_url", None, None), "9": ("no_earlier", None, None), "a": ("mismatch", "7", None)}


def test_merged_headers(spark):
    new = [("etag", '"a"'), ("x-age", "9"), ("Content-Type", "text/plain"), ("Transfer-Encoding", "chunked"), ("Date", "d")]
    got = warc.resolve(rows(spark, ("1", "response", "u", 1, 200, TAG, ""), ("2", "revisit", "u", 2, 304, new, None))).first()
    assert [tuple(h) for h in got.headers] == [("Content-Type", "text/html"), ("etag", '"a"'), ("x-age", "9"), ("Date", "d")]
    assert got.body == ""


def test_ties_repeats_and_empty_tables(spark):
    tied = [("b", "response", "u", 7, 200, TAG, "b"), ("a", "response", "u", 7, 200, TAG, "a"),
            ("c", "revisit", "u", 7, 304, TAG, None), ("A", "revisit", "u", 7, 304, TAG, None)]
    got = outcome(spark, *tied)
    assert got == {"c": ("resolved", "b", "b"), "A": ("no_earlier", None, None)}
    twice = warc.resolve(rows(spark, *tied).union(rows(spark, *tied)))
    assert sorted((r.record_id, r.body) for r in twice.collect() if r.body) == [("c", "b")] * 2
    assert warc.resolve(rows(spark)).count() == 0


def test_one_hot_url(spark):
    many = [(f"r{n:05d}", "response" if n % 3 == 0 else "revisit", "u", n * 40_000, 200 if n % 3 == 0 else 304, TAG, str(n))
            for n in range(3000)]
    got = outcome(spark, *many)
    assert all(got[f"r{n:05d}"] == ("resolved", f"r{n - n % 3:05d}", str(n - n % 3)) for n in range(3000) if n % 3)


def test_one_hot_response(spark, monkeypatch):
    """A response that nearly all revisits name is copied for parts of them."""
    monkeypatch.setattr(warc, "COPY_ROWS", 50)
    many = [("r", "response", "u", 1, 200, TAG, "hot"), ("s", "response", "v", 1, 200, TAG, "cold"),
            *[(f"h{n}", "revisit", "u", 2 + n, 304, TAG, None) for n in range(700)], ("c", "revisit", "v", 2, 304, TAG, None)]
    got = outcome(spark, *many)
    assert len(got) == 701 and got["c"] == ("resolved", "s", "cold")
    assert all(got[f"h{n}"] == ("resolved", "r", "hot") for n in range(700))


def test_files_read_back(spark, tmp_path):
    records = rows(spark, ("1", "response", "http://a/", 0, 200, [("A", "b: c"), ("Empty", "")], "body\r\n\r\nWARC/1.1\nend 漢 "),
                   ("2", "revisit", "http://a/", 1_700_000_000, 304, None, None),
                   ("3", "response", "http://b/", 5, 200, TAG, "\r\n\r\n"), ("4", "response", None, 5, 200, [], "x" * 100_000))
    warc.write(records.coalesce(1), str(tmp_path / "w"))
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert all(r.complete for r in got.values())
    for want in records.collect():
        mine = got[want.record_id]
        assert (mine.type, mine.url, mine.ts, mine.status) == (want.type, want.url, want.ts, want.status)
        assert mine.headers == (want.headers or []) and mine.body == (want.body or "")
    warc.write(records.repartition(2), str(tmp_path / "z"), "gzip")
    packed = {r.record_id: r for r in warc.read(spark, str(tmp_path / "z")).collect()}
    assert packed == got and list((tmp_path / "z").glob("*.gz"))
    warc.write(records.filter("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_no_record_is_lost_at_the_edge_of_a_buffer(spark, tmp_path):
    """Many short records without bodies, so that buffers of the reader end at every place of a break."""
    n = 150_000
    many = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("record_id"), F.lit("revisit").alias("type"), F.lit("http://a/").alias("url"),
        F.col("id").alias("ts"), F.lit(304).alias("status"), F.lit("x").alias("reason"),
        F.lit(None).cast(warc.HEADERS).alias("headers"), F.lit(None).cast("string").alias("body"))
    warc.write(many, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert back.agg(F.count_distinct("record_id"), F.count_if("complete")).first() == (n, n)
