"""WARC: transaction assembly.

Writing: each page becomes a request, a response (or revisit) and a metadata record, tied by WARC-Concurrent-To. Spark's
text writer puts records into gzip files of a bounded number of records on any file system; its line separator is the
blank line that ends a record. Of pages with equal payloads of at least ``REVISIT`` bytes the largest id is the response,
the others are revisits that refer to it.

Reading: files come in whole through Spark's binary reader, are walked record by record by Content-Length, and payload
digests are computed from what is there. Records are then joined by record id: requests and metadata to the response or
revisit they are concurrent to, revisits to the response they refer to, and one nested row per capture comes out.

Defined results: null html counts as empty; rows that repeat id, url and html repeat their records, which share their ids:
they are one capture with so many ``copies``, and one row each in ``round_trip``; all rows of the largest id are responses;
a null id is the last choice for a response; very long payloads are kept whole; a capture nests the request and the metadata record with the smallest record id and counts
the others, which ``left_over`` returns, like records that belong to no capture; an empty table gives no rows. Columns
other than those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value
from cohortlens.session import scratch_path, stored

by_value(__name__)
col, lit = F.col, F.lit

REVISIT, RECORDS = 1000, 20_000
END = "\r\n\r\n"
SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, http string, digest string, payload binary, payload_bytes long, said_digest string, fields map<string,string>"


def _id(kind: str) -> Column:
    """Record id made from what a row is, so that it comes out the same wherever it is computed."""
    h = F.md5(F.concat_ws("\x1f", lit(kind), F.coalesce(col("page_id").cast("string"), lit("\x1e")), F.coalesce("url", lit("\x1e")), "digest"))
    return F.concat(lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines and block, without the blank line at the end; headers with a null value are left out."""
    known = [("WARC-Type", lit(kind) if kind else col("kind")), ("WARC-Record-ID", record_id), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *[F.concat(lit(f"{k}: "), v) for k, v in known]), lit(END), block)


def records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``value``: the text of every record to write."""
    p = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), F.coalesce(html_col, lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html")}).withColumn("rid", _id("response"))
    # The choice reads digests only; the payload itself is joined once.
    lead = p.where(col("n") >= REVISIT).groupBy("digest").agg(
        F.max(F.struct(col("page_id").isNotNull(), "page_id", "url", "rid")).alias("lead"), F.count(lit(1)).alias("c")).where(col("c") > 1).select(
        col("digest").alias("d"), "lead.rid", col("lead.url").alias("lead_url"), col("lead.page_id").alias("lead_id"))
    lead = lead.withColumnRenamed("rid", "lead_rid")
    p = p.join(lead, (p["digest"] == lead["d"]) & (p["n"] >= REVISIT), "left")
    p = p.withColumn("again", col("lead_rid").isNotNull() & ~col("lead_id").eqNullSafe(col("page_id"))).withColumn("kind", F.when(col("again"), "revisit").otherwise("response"))
    clean = F.regexp_replace(F.coalesce("url", lit("")), r"[\r\n]", " ")
    common = [("WARC-Date", lit(date)), ("WARC-Target-URI", clean)]
    here = F.when(col("again"), lit("")).otherwise(col("html"))
    http = F.concat(lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), col("n").cast("string"), lit(END), here)
    answer = _record("", col("rid"), [
        *common, ("WARC-Payload-Digest", F.concat(lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(col("again"), col("lead_rid"))), ("WARC-Refers-To-Target-URI", F.when(col("again"), F.regexp_replace(F.coalesce("lead_url", lit("")), r"[\r\n]", " "))),
        ("WARC-Profile", F.when(col("again"), lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", lit("application/http; msgtype=response"))], http)
    path = F.regexp_replace(clean, "^[a-zA-Z]+://[^/?#]*|#.*$", "")
    ask = _record("request", _id("request"), [*common, ("WARC-Concurrent-To", col("rid")), ("Content-Type", lit("application/http; msgtype=request"))],
                  F.concat(lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(lit("/"), path)), lit(" HTTP/1.1\r\nAccept: text/html" + END)))
    about = _record("metadata", _id("metadata"), [*common, ("WARC-Concurrent-To", col("rid")), ("Content-Type", lit("application/warc-fields"))],
                    F.concat_ws("\r\n", F.concat(lit("pageId: "), col("page_id").cast("string")), lit("via: crawl\r\n")))
    return p.select(F.explode(F.array(ask, answer, about)).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def walk(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, compressed as a whole, by record, or not at all."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            z = zlib.decompressobj(31)
            out.append(z.decompress(data))
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record (columns of ``SCHEMA``); without ``payload`` its bytes stay out, size and digest are there."""
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}[t])
                        for n, t in (x.strip().split(" ") for x in SCHEMA.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                rows: list[dict] = []
                for h, block in walk(data.as_py()):
                    one = lambda k: h.get(k, [None])[0]  # noqa: B023, E731
                    kind, http, body, fields = one("warc-type"), None, block, []
                    if (one("content-type") or "").startswith("application/http"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    elif kind == "metadata":
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                    rows.append({
                        "record_id": one("warc-record-id"), "type": kind, "concurrent_to": one("warc-concurrent-to"), "refers_to": one("warc-refers-to"),
                        "target_uri": one("warc-target-uri"), "date": one("warc-date"), "http": http, "digest": hashlib.sha1(body).hexdigest(),
                        "payload": body if payload else None, "payload_bytes": len(body),
                        "said_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "fields": list(dict(fields).items())})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # One file a batch: files are large rows.
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, SCHEMA)


def assemble(recs: DataFrame) -> DataFrame:
    """``capture_id, uri, date, type, payload_bytes, payload_digest, refers_to, intact, response, request, metadata, n_requests, n_metadata, copies``.

    ``refers_to`` is the capture a revisit refers to; its payload's size and digest are that one's. ``intact``: the digest
    in the headers is that of the payload found. The three nested records are structs (null if there is none).
    """
    whole = F.struct(*recs.columns)
    by = lambda kinds: recs.where(col("type").isin(*kinds))
    answers = by(("response", "revisit")).groupBy(col("record_id").alias("capture_id")).agg(F.any_value(whole).alias("response"), F.count(lit(1)).alias("copies"))

    def side(kind: str) -> DataFrame:
        return by((kind,)).groupBy(col("concurrent_to").alias("capture_id")).agg(
            F.min_by(whole, "record_id").alias(kind), F.count_distinct("record_id").alias(f"n_{kind}"))

    out = answers.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    # Only revisits look for another capture; the rest have no key to join by.
    again = col("response.type") == "revisit"
    target = by(("response",)).groupBy(col("record_id").alias("t")).agg(F.any_value("digest").alias("t_digest"), F.any_value("payload_bytes").alias("t_bytes"))
    revisits = out.where(again).withColumn("to", col("response.refers_to"))
    revisits = revisits.join(target, revisits["to"] == target["t"], "left").withColumns({"digest": col("t_digest"), "bytes": col("t_bytes"), "refers_to": col("t")})
    plain = out.where(~again).withColumns({"digest": col("response.digest"), "bytes": col("response.payload_bytes"), "refers_to": lit(None).cast("string")})
    cols = ["capture_id", "response", "request", "metadata", "n_request", "n_metadata", "copies", "digest", "bytes", "refers_to"]
    return revisits.select(*cols).unionByName(plain.select(*cols)).select(
        "capture_id", col("response.target_uri").alias("uri"), col("response.date").alias("date"), col("response.type").alias("type"),
        col("bytes").alias("payload_bytes"), col("digest").alias("payload_digest"), "refers_to", (col("digest") == col("response.said_digest")).alias("intact"),
        "response", "request", "metadata", F.coalesce("n_request", lit(0)).alias("n_requests"), F.coalesce("n_metadata", lit(0)).alias("n_metadata"), "copies")


def left_over(recs: DataFrame, captures: DataFrame) -> DataFrame:
    """Records that no capture nests."""
    used = captures.select(F.explode(F.array("capture_id", "request.record_id", "metadata.record_id")).alias("record_id"))
    return recs.join(used, "record_id", "left_anti")


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and assemble: ``page_id`` beside the capture's columns.

    One row for each row of ``pages``. ``page_id`` and ``refers_to_page`` come out of the archives' metadata records.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    # Archives are walked once, and captures put together once, as both are read several times below.
    captures = stored(assemble(stored(read_archives(spark, path, payload=False), "warc-records")), "warc-captures")
    kind = pages.schema[id_col].dataType
    ids = captures.withColumn("page_id", F.element_at("metadata.fields", "pageId").cast(kind))
    names = ids.where(col("type") == "response").select(col("capture_id").alias("refers_to"), col("page_id").alias("refers_to_page"))
    refer = col("refers_to").isNotNull()
    out = ids.where(refer).join(names, "refers_to", "left").unionByName(ids.where(~refer).withColumn("refers_to_page", lit(None).cast(kind)))
    return out.withColumn("copy", F.explode(F.sequence(lit(1), col("copies"))))
