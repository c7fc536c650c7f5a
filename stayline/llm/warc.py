"""Web archives: write pages as WARC records, read archives, and assemble one capture per transaction."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import stored

# Fixed values of the format.
END = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 12_000


def record_id(kind: str) -> Column:
    """A urn:uuid made from what identifies the row, so that reruns and retries agree.

    Where the table repeats a row, its place in the table tells the copies apart.
    """
    name = F.md5(F.concat_ws("\u0001", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("\u0002")), "digest", "copy"))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header(name: str, value: Column | str) -> Column:
    """One header line; a null value gives no line. Line breaks inside a value become spaces."""
    value = F.regexp_replace(F.lit(value) if isinstance(value, str) else value, r"[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def record(kind: Column | str, own: Column, date: str, block: Column, *more: Column) -> Column:
    """Header lines and block of one record, as bytes in a string column."""
    lines = [F.lit(VERSION + END), header("WARC-Type", kind), header("WARC-Record-ID", own), header("WARC-Date", date), *more]
    head = F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END))
    return F.concat(head, block)


def versions(pages: DataFrame) -> DataFrame:
    """Pages with the digest and length of their payload, and the version each one repeats.

    Of pages with equal payloads of at least 1000 bytes the one with the
    largest (page_id, url) is the response; the others refer to it. Of a row
    that the table repeats the last is taken first, and the others have a
    `copy`, so none of them is lost. Digests are counted before any join, and
    only those held by several rows are joined, so unique payloads cost no row
    there.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body.cast("binary")).alias("digest"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    repeated = (
        rows.groupBy("digest", "n_bytes", "page_id", "url")
        .agg(F.max("row").alias("row"), F.count("*").alias("n"))
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.struct("page_id", "url", "row")).alias("keep"), F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("surplus"))
        .where((F.col("n") > 1) & ((F.col("n_bytes") >= MIN_REVISIT_BYTES) | (F.col("surplus") > 0)))
        .select(F.col("digest").alias("r_digest"), F.col("n_bytes").alias("r_bytes"), F.col("keep.page_id").alias("r_page"), F.col("keep.url").alias("r_url"), F.col("keep.row").alias("r_row"), "surplus")
    )
    joined = rows.join(repeated, (rows["digest"] == repeated["r_digest"]) & (rows["n_bytes"] == repeated["r_bytes"]), "left")
    other = F.col("r_digest").isNotNull() & (F.col("row") != F.col("r_row"))
    copy = F.when(other & (F.col("surplus") > 0), F.col("row").cast("string")).otherwise("")
    return joined.withColumns({"again": other & (F.col("n_bytes") >= MIN_REVISIT_BYTES), "copy": copy})


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a request, a response or revisit, and a metadata record for every page, gzipped.

    Spark's text writer puts the bytes out unchanged, with the record
    separator as its line separator, so files are committed by Spark like any
    others and a lost task leaves nothing half written. A file holds at most
    `records_per_file` records, which bounds what a reader holds.
    """
    rows = versions(pages)
    own, request, meta = record_id("response"), record_id("request"), record_id("metadata")
    uri = header("WARC-Target-URI", F.col("url"))
    digest = header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(RECORD_END))
    first = [F.col(c).alias(n) for c, n in (("r_page", "page_id"), ("r_url", "url"), ("digest", "digest"))]
    # The id of the version referred to is the same function of its own page_id and url.
    rows = rows.withColumns({"own": own, "request": request, "meta": meta}).withColumn("first", F.struct(*first))
    refers = rows.select("*", F.col("first.page_id").alias("f_page"), F.col("first.url").alias("f_url")).drop("first")
    refers = refers.withColumnsRenamed({"page_id": "p_page", "url": "p_url", "f_page": "page_id", "f_url": "url"}).withColumn("copy", F.lit("")).withColumn("refers", record_id("response"))
    rows = refers.drop("page_id", "url").withColumnsRenamed({"p_page": "page_id", "p_url": "url"})
    response_type = header("Content-Type", "application/http;msgtype=response")
    main = F.when(
        F.col("again"),
        record("revisit", F.col("own"), date, http, uri, digest, header("WARC-Profile", SAME_PAYLOAD), header("WARC-Refers-To", F.col("refers")), response_type),
    ).otherwise(record("response", F.col("own"), date, F.concat(http, "html"), uri, digest, response_type))
    with_main = header("WARC-Concurrent-To", F.col("own"))
    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^\r\n ]*)", 1), F.lit(""))
    get = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(RECORD_END))
    ask = record("request", F.col("request"), date, get, uri, with_main, header("Content-Type", "application/http;msgtype=request"))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END))
    note = record("metadata", F.col("meta"), date, fields, uri, with_main, header("Content-Type", "application/warc-fields"))
    lines = rows.select(F.explode(F.array(ask, main, note)).alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "header_digest string, payload_digest string, payload_bytes long, block binary, problem string"
)


def parse(stream, payloads: bool) -> Iterator[tuple]:
    """Records of one archive file, in order. Bytes that start no record end up in a row with `problem`."""
    lost = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            lost += bool(line.strip())
            continue
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            head.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
        length = head.get(b"content-length", "")
        if not length.isdigit():
            yield (head.get(b"warc-record-id"), None, None, None, None, None, None, None, None, None, "no length")
            continue
        block = stream.read(int(length))
        kind = head.get(b"warc-type")
        problem = None if len(block) == int(length) else "cut short"
        digest = size = None
        if kind == "response":
            at = block.find(b"\r\n\r\n")
            payload = block[at + 4 :] if at >= 0 else block
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
            said = head.get(b"warc-payload-digest", "")
            if said.startswith("sha1:") and len(said) == 45 and said[5:].lower() != digest:
                problem = problem or "digest differs"
        yield (
            head.get(b"warc-record-id"),
            kind,
            head.get(b"warc-target-uri"),
            head.get(b"warc-date"),
            head.get(b"warc-concurrent-to"),
            head.get(b"warc-refers-to"),
            head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None,
            digest,
            size,
            block if payloads or kind != "response" else None,
            problem,
        )
    if lost:
        yield (None, None, None, None, None, None, None, None, None, None, f"{lost} lines outside records")


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archive files under `path`, plain or gzipped, one row each.

    Digest and length of every response are computed from its bytes; a record
    that is cut short, has no length or another digest than it says carries
    `problem`. Without `payloads` the blocks of responses are left out of the
    rows after they have been read and checked.
    """
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                part, held = [], 0
                for row in parse(stream, payloads):
                    part.append(row)
                    held += len(row[9] or b"") + 400
                    if held > 4_000_000:
                        yield pd.DataFrame(part, columns=names).astype({"payload_bytes": "Int64"})
                        part, held = [], 0
                if part:
                    yield pd.DataFrame(part, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInPandas(read, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata records.

    A record belongs to the capture whose response or revisit it names in
    WARC-Concurrent-To, directly or through another record of the same
    transaction (metadata that names the request). Responses may name their
    request instead. Captures are then one aggregation by that id, in which
    the first record of each kind by id stands and the others are counted
    (`n_requests`, `n_metadata`), so no list grows with the data. Records
    whose capture is not there form rows of their own with a null `main`;
    repeated records fall together but are counted each. Unreadable rows (null
    id) are left out: they stay in `records`.
    """
    records = records.where("record_id is not null")
    main = F.col("record_type").isin("response", "revisit")
    links = records.where("concurrent_to is not null").select(
        F.col("record_id").alias("l_id"), F.col("concurrent_to").alias("l_to"), main.alias("l_main")
    ).distinct()
    # Ids that a response names stand for that response; ids of other records stand for what they name.
    stands = links.select(F.when(F.col("l_main"), F.col("l_to")).otherwise(F.col("l_id")).alias("s_id"), F.when(F.col("l_main"), F.col("l_id")).otherwise(F.col("l_to")).alias("s_for"))
    stands = stands.groupBy("s_id").agg(F.min("s_for").alias("s_for"))
    once = F.when(main, F.col("record_id")).otherwise(F.coalesce("s_for", "concurrent_to", "record_id"))
    keyed = records.join(stands, F.col("record_id") == F.col("s_id"), "left").withColumn("anchor", once).drop("s_id", "s_for")
    stands = stands.withColumnsRenamed({"s_id": "t_id", "s_for": "t_for"})
    keyed = keyed.join(stands, (F.col("anchor") == F.col("t_id")) & ~main, "left").withColumn("anchor", F.coalesce("t_for", "anchor")).drop("t_id", "t_for")
    cells = F.struct(*[c for c in records.columns])

    def first(kind: Column) -> Column:
        return F.min_by(F.when(kind, cells), F.when(kind, F.col("record_id")))

    is_request, is_meta = F.col("record_type") == "request", F.col("record_type") == "metadata"
    return keyed.groupBy(F.col("anchor").alias("capture_id")).agg(
        first(main).alias("main"),
        first(is_request).alias("request"),
        first(is_meta).alias("metadata"),
        F.count(F.when(is_request, 1)).alias("n_requests"),
        F.count(F.when(is_meta, 1)).alias("n_metadata"),
    )


def archived_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write `pages` to archives under `path`, read them back, and describe each page's record.

    Returns page_id, url, payload_bytes, payload_digest, record_type and
    refers_to. A null html is an empty payload; a null
    page_id or url stays null; every repeated row is a capture of its own.
    Empty input gives no rows.
    """
    spark = pages.sparkSession
    write_pages(pages, path)
    captures = assemble(read_records(spark, path, payloads=False)).where("main is not null")
    page = F.regexp_extract(F.decode("metadata.block", "utf-8"), r"page_id: (-?\d+)", 1)
    captures = stored(
        captures.select(
            "capture_id",
            F.when(page != "", page.cast("long")).alias("page_id"),
            F.col("main.target_uri").alias("url"),
            F.col("main.payload_bytes").alias("payload_bytes"),
            F.coalesce("main.payload_digest", "main.header_digest").alias("payload_digest"),
            F.col("main.record_type").alias("record_type"),
            F.col("main.refers_to").alias("first_id"),
        ),
        "captures",
    )
    revisits, responses = captures.where("record_type = 'revisit'"), captures.where("record_type = 'response'")
    first = responses.select(F.col("capture_id").alias("first_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    back = revisits.join(first, "first_id", "left").withColumn("payload_bytes", F.col("first_bytes"))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(back.select(names))
