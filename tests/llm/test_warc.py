import hashlib

from stayline.llm import warc
from stayline.session import scratch_path

BIG = "<p>" + "ä&" * 600


def pages(spark):
    rows = [
        (1, "http://a.example/x", BIG, "k"),
        (2, "http://a.example/y?z=1", BIG, "k"),
        (9, None, BIG, "k"),
        (3, "http://b.example", "small", "k"),
        (4, "http://b.example/", "small", "k"),
        (5, "http://b.example/\r\nWARC-Type: forged", None, "k"),
        (6, "", "", "k"),
        (7, "http://c.example", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\nx" + "y" * 2000 + "\r\n\r\n", "k"),
        (8, "http://c.example", "z" * 3_000_000, "k"),
        (None, "http://d.example", "null id", "k"),
        (3, "http://b.example", "small", "k"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip_against_plain_python(spark):
    df = pages(spark)
    got = {(r.page_id, r.url): r for r in warc.archived_pages(df, scratch_path(spark, "w")).collect()}
    rows = {(r.page_id, r.url): r for r in df.collect()}
    assert len(got) == len(rows) == 10
    for (page_id, url), row in rows.items():
        body = (row.html or "").encode()
        out = got[(page_id, url.replace("\r", " ").replace("\n", " ") if url else None)] if url != "" else got[(page_id, "")]
        assert out.payload_bytes == len(body)
        assert out.payload_digest == hashlib.sha1(body).hexdigest()
        again = len(body) >= 1000 and any((o.html or "") == (row.html or "") and (o.page_id or -1) > (page_id or -1) for o in rows.values())
        assert out.record_type == ("revisit" if again else "response")
        assert out.refers_to == (9 if again else None)


def test_repeated_rows_are_records_of_their_own(spark):
    rows = [(1, "http://a.example", "small", "k")] * 3 + [(2, "http://a.example", BIG, "k")] * 3 + [(1, None, BIG, "k")] * 2 + [(None, None, None, "k")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string").repartition(4)
    path = scratch_path(spark, "w")
    out = warc.archived_pages(df, path).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {(r.page_id, r.record_type, r.refers_to): r["count"] for r in out} == {
        (1, "response", None): 3, (2, "response", None): 1, (2, "revisit", 2): 2, (1, "revisit", 2): 2, (None, "response", None): 2
    }
    ids = [r.record_id for r in warc.read_records(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)


def test_empty_table(spark):
    assert warc.archived_pages(pages(spark).limit(0), scratch_path(spark, "w")).count() == 0


def test_payloads_come_back_and_bad_bytes_are_reported(spark, tmp_path):
    path = scratch_path(spark, "w")
    warc.write_pages(pages(spark).where("page_id in (7, 5)"), path)
    found = warc.read_records(spark, path).where("record_type = 'response' and payload_bytes > 0").collect()
    html = pages(spark).where("page_id = 7").first().html.encode()
    assert len(found) == 1 and bytes(found[0].block).endswith(html) and found[0].problem is None
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(good + b"junk\r\n" + b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 99\r\n\r\ncut")
    problems = [r.problem for r in warc.read_records(spark, str(tmp_path)).collect()]
    assert problems == ["digest differs", "no length", "cut short", "1 lines outside records"]


def test_assembly_through_other_records(spark):
    schema = "record_id string, record_type string, concurrent_to string, extra int"
    rows = [
        ("r1", "response", None, 1), ("q1", "request", "r1", 1), ("m1", "metadata", "q1", 1), ("m2", "metadata", "r1", 1),
        ("r2", "response", "q2", 1), ("q2", "request", None, 1), ("m3", "metadata", "q2", 1),
        ("m4", "metadata", "gone", 1), ("v1", "revisit", None, 1), ("v1", "revisit", None, 1), (None, None, None, 1),
    ]
    out = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {"r1", "r2", "gone", "v1"}
    assert (out["r1"].request.record_id, out["r1"].metadata.record_id, out["r1"].n_metadata) == ("q1", "m1", 2)
    assert (out["r2"].request.record_id, out["r2"].metadata.record_id) == ("q2", "m3")
    assert out["gone"].main is None and out["v1"].main.record_type == "revisit"


def test_query_on_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "w")
    assert warc.archived_pages(df, path).count() == df.count()
    kinds = {r.record_type: r["count"] for r in warc.read_records(spark, path).groupBy("record_type").count().collect()}
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds.get("revisit", 0) == df.count()
