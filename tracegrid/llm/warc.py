"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: every page becomes one capture of three records, a request, a response and a metadata record,
tied together by ``WARC-Concurrent-To``. Pages with equal payloads of at least ``MIN_REVISIT_BYTES``
share one response, that of the smallest ``page_id``; the others become revisit records that carry no
payload and refer to it. Pages are dealt evenly, those of a payload that very many share over salts, into files
of about ``FILE_BYTES`` of records. Spark's text writer puts the records into gzip files, so files are committed
whole and a lost task writes its file again.

Reading: Spark reads each archive file and hands it to a task as compressed bytes; it is inflated and parsed
piece by piece (plain, gzip as a whole or gzip by record), so a task holds one compressed file and one record.
Content-Length alone says where a record ends; payloads may hold anything.

Assembly: requests and metadata are joined to their response or revisit through concurrent-to
identifiers, in either direction, metadata also by way of a request. One nested row comes out for each
capture; a revisit's payload figures come from the response it refers to.

Defined cases: a null html is an empty payload; a null url is written as ``urn:tracegrid:none``; rows that
repeat page_id and html are written as often as they occur and come back as often; a null page_id comes
back null; an empty table gives an archive with no records. A cut-off last record is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.runtime import hot_keys, materialised, new_folder, salted_join

MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
FILE_BYTES = 64 << 20
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, warc_type string, concurrent_to array<string>, target_uri string, warc_date string, "
    "refers_to_id string, content_type string, headers map<string,string>, http_status int, fields map<string,string>, "
    "payload binary, payload_bytes long, payload_digest string"
)


# ---------------------------------------------------------------- writing


def _record_id(kind: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("digest")))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _record(kind: str, rid: Column, extra: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A whole record but for its closing two line ends, which the writer adds as its separator."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in extra]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload, digest, and ``is_revisit`` / ``original_id``: the smallest page_id with that payload."""
    base = pages.select(
        F.col("page_id"),
        F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("urn:tracegrid:none")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    copies = (
        base.filter(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND original_id IS NOT NULL")
    )
    copies = materialised(copies, "warc-copies")
    size = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-((size["bytes"] or 0) + 1024 * size["n"]) // FILE_BYTES))
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    joined = salted_join(base, copies.drop("n"), ["digest"], ["page_id"], hot_keys(copies, ["digest"], "n", size["n"]), "left", files)
    return joined.withColumn("is_revisit", revisit)


def capture_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One string column ``value``: three records for each page."""
    uri = [("WARC-Target-URI", F.col("url"))]
    response = _record_id("response")
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1), F.lit("")), F.lit("none"))
    asked = F.concat(F.lit(f"GET / HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    original = F.md5(F.concat_ws("|", F.lit("response"), F.col("original_id").cast("string"), F.col("digest")))
    part = lambda a, n: F.substring(original, a, n)
    refers = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    http = "application/http; msgtype="
    main = F.when(
        F.col("is_revisit"),
        _record("revisit", response, uri + digest + [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", refers)], http + "response", head),
    ).otherwise(_record("response", response, uri + digest, http + "response", F.concat(head, F.col("html"))))
    tied = [("WARC-Concurrent-To", response)]
    request = _record("request", _record_id("request"), uri + tied, http + "request", asked)
    note = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    by_request = [("WARC-Concurrent-To", _record_id("request"))]
    meta = _record("metadata", _record_id("metadata"), uri + by_request, "application/warc-fields", note)
    return with_originals(pages, min_bytes).select(F.explode(F.array(request, main, meta)).alias("value"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    (
        capture_records(pages, min_bytes)
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .text(path)
    )


# ---------------------------------------------------------------- reading


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece; other data come in one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, member = memoryview(data), None
    for at in range(0, len(view), PIECE):
        rest = view[at : at + PIECE]
        while len(rest):
            if member is None:
                if rest[0] != 0x1F:  # something else follows the last member
                    return
                member = zlib.decompressobj(31)
            yield member.decompress(rest, 4 * PIECE)
            rest = member.unused_data if member.eof else member.unconsumed_tail
            member = None if member.eof else member
    if member is not None:
        yield member.flush()


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            k, v = text.split(":", 1)
            out.append((k.strip().lower(), v.strip()))
    return out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record; leading junk before a version line is skipped, a cut-off last record dropped."""
    held, over = bytearray(), False

    def more() -> bool:
        nonlocal over
        piece = next(pieces, None)
        over = piece is None
        held.extend(piece or b"")
        return not over

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = _headers(bytes(held[at:end]).split(b"\r\n")[1:])
        length = next((v for k, v in head if k == "content-length"), "")
        if not length.isdigit():
            del held[: end + 4]
            continue
        stop = end + 4 + int(length)
        while len(held) < stop:
            if not more():
                return
        yield head, bytes(held[end + 4 : stop])
        del held[:stop]


def _parsed(head: list[tuple[str, str]], block: bytes, keep_payload: bool) -> dict:
    import hashlib

    h = dict(head)
    kind, content = h.get("warc-type", ""), h.get("content-type", "")
    status, fields, payload = None, None, block
    if content.startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        words = top.split(b"\r\n", 1)[0].split()
        if words[:1] and words[0].startswith(b"HTTP/") and len(words) > 1 and words[1].isdigit():
            status = int(words[1])
    elif content.startswith("application/warc-fields"):
        fields = _headers(block.split(b"\r\n"))
    whole = kind in ("response", "resource", "conversion")
    return {
        "record_id": h.get("warc-record-id"), "warc_type": kind, "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"],
        "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "refers_to_id": h.get("warc-refers-to"),
        "content_type": content, "headers": list(h.items()), "http_status": status, "fields": list(dict(fields).items()) if fields is not None else None,
        "payload": payload if keep_payload and whole else None,
        "payload_bytes": len(payload) if whole else None, "payload_digest": hashlib.sha256(payload).hexdigest() if whole else None,
    }


def read_records(spark: SparkSession, path: str, keep_payload: bool = True, batch: int = 500) -> DataFrame:
    """Every record of the archives at ``path``. Without ``keep_payload`` only its size and SHA-256 leave the task."""
    schema = spark.createDataFrame([], RECORD_SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for value in one.column(0):
                rows = []
                for head, block in records(inflated(value.as_py())):
                    rows.append(_parsed(head, block, keep_payload))
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    files = files if not path.endswith((".warc", ".warc.gz")) else spark.read.format("binaryFile")
    return files.load(path).select("content").mapInArrow(parse, schema)


# ---------------------------------------------------------------- assembly


def assemble(recs: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row for each response, revisit or resource: capture, request(s) and metadata."""
    main_types = ("response", "revisit", "resource")
    main = recs.filter(F.col("warc_type").isin(*main_types))
    rest = recs.filter(~F.col("warc_type").isin(*main_types)).drop("payload", "payload_bytes", "payload_digest", "http_status")
    ids = main.select(F.col("record_id").alias("main_id"))
    links = rest.select("record_id", "warc_type", F.explode("concurrent_to").alias("to"))
    back = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("main_id"))
    direct = links.join(ids.distinct(), F.col("to") == F.col("main_id")).select("record_id", "main_id").unionByName(back)
    by_request = (
        links.filter("warc_type <> 'request'")
        .select(F.col("record_id").alias("rid"), "to")
        .join(direct.select(F.col("record_id").alias("to"), "main_id"), "to")
        .select(F.col("rid").alias("record_id"), "main_id")
    )
    tied = direct.unionByName(by_request).distinct().join(rest.dropDuplicates(["record_id"]), "record_id")
    side = F.struct("record_id", "warc_type", "target_uri", "warc_date", "content_type", "headers", "fields")
    grouped = tied.groupBy("main_id").agg(
        F.collect_list(F.when(F.col("warc_type") == "request", side)).alias("requests"),
        F.collect_list(F.when(F.col("warc_type") == "metadata", side)).alias("metadata"),
    )
    kept = ["record_id", "warc_type", "target_uri", "warc_date", "refers_to_id", "content_type", "headers", "http_status", "payload_bytes", "payload_digest"]
    whole = main.select(F.struct(*kept, *(["payload"] if payload else [])).alias("capture"))
    return whole.join(grouped, F.col("capture.record_id") == F.col("main_id"), "left").drop("main_id")


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as an archive, read it back, and describe each page's capture."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archive(pages, path, min_bytes)
    page = F.nullif(F.col("metadata")[0]["fields"]["page_id"], F.lit("")).cast("long")
    found = assemble(materialised(read_records(spark, path, keep_payload=False), "warc-records"), payload=False)
    found = found.select(
        page.alias("page_id"),
        F.col("capture.record_id").alias("record_id"),
        F.col("capture.warc_type").alias("record_type"),
        F.col("capture.payload_bytes").alias("own_bytes"),
        F.col("capture.payload_digest").alias("own_digest"),
        F.col("capture.refers_to_id").alias("refers_to_id"),
        F.col("capture.target_uri").alias("target_uri"),
    )
    target = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("own_bytes").alias("their_bytes"), F.first("own_digest").alias("their_digest")
    )
    # only revisits refer to anything; what very many refer to is spread over tasks
    asking = found.filter("refers_to_id IS NOT NULL")
    counts = asking.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, ["refers_to_id"], "n", asking.count())
    told = salted_join(asking, target, ["refers_to_id"], ["record_id"], hot, "left")
    plain = found.filter("refers_to_id IS NULL").select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("their_bytes"), F.lit(None).cast("string").alias("their_digest"))
    return told.unionByName(plain).select(
        "page_id",
        F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "their_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "target_uri",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
o AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN o.first IS NOT NULL AND p.page_id <> o.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.first IS NOT NULL AND p.page_id <> o.first THEN o.first END AS refers_to,
       coalesce(p.url, 'urn:tracegrid:none') AS target_uri
FROM p LEFT JOIN o ON o.html = p.html
"""
