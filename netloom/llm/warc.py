"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an earlier response with the same payload) and
the crawler's metadata. Request and metadata name their response by WARC-Concurrent-To. Records are UTF-8 texts that
end in two line breaks, so Spark's text writer with that separator writes archives, through its own commit protocol
and to any file system it knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, new_path, until_exit

CRLF = "\r\n"
#: Payloads of at least so many pages, and of at least the HOT_SHARE-th part of all, are joined by broadcast: HOT_SHARE rows at most.
HOT, HOT_SHARE = 1_000, 4_096
#: Captures in one archive file, and bytes of their payloads and addresses, at most; a single larger capture has a file of its own. An archive is one row of Spark's reader.
CAPTURES_PER_FILE, FILE_BYTES = 2_000, 64 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, offset long, type string, record_id string, concurrent_to string, refers_to long, target_uri string, page_id long, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def digests(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 100) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, refers_to) of every page: refers_to is the smallest id of an equal payload of at least ``least`` bytes, null where that's the page itself."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select("*", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    many = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(page_id).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    many = materialize(many, "payloads")
    often = F.col("n") >= max(HOT, pages.count() / HOT_SHARE)
    side = lambda where, name: many.where(where).select(F.col("payload_digest").alias(f"__{name}"), F.col("first_id").alias(f"__{name}_id"))
    joined = rows.join(F.broadcast(side(often, "hot")), F.col("payload_digest") == F.col("__hot"), "left")
    # Pages of a hot payload get keys that match nothing and differ, so the other join isn't skewed by them.
    joined = joined.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("payload_digest")).otherwise(F.concat_ws("#", "payload_digest", page_id)))
    joined = joined.join(side(~often, "cold"), F.col("__key") == F.col("__cold"), "left")
    first = F.when(F.col("payload_bytes") >= least, F.coalesce("__hot_id", "__cold_id"))
    return joined.withColumn("refers_to", F.when(first < F.col(page_id), first)).drop("__hot", "__hot_id", "__key", "__cold", "__cold_id")


def _record(headers: list, block: Column) -> Column:
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise(""))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _kind(url: Column, html: Column) -> Column:
    """0 for captures of which ``CAPTURES_PER_FILE`` keep within ``FILE_BYTES``, k for those 2^k times as large, at most."""
    size = F.octet_length(html) + 3 * F.octet_length(url)  # an address's control characters become three bytes
    return F.greatest(F.lit(0), F.ceil(F.log2(size * CAPTURES_PER_FILE / F.lit(float(FILE_BYTES))))).cast("int")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> None:
    """Writes request, response or revisit, and metadata records of ``pages`` to gzipped WARC files under ``path``.

    Captures that are too large for ``CAPTURES_PER_FILE`` of them to keep within ``FILE_BYTES`` are written by their
    size, each power of two apart and with fewer to a file.
    """
    rows = digests(pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.regexp_replace(url, r"[\x00-\x20]", "%20"), F.lit("urn:none")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")), least=least)
    rows = rows.withColumn("capture", F.uuid()).withColumn("kind", _kind(F.col("url"), F.col("html")))
    part = lambda kind: F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(f"#{kind}>"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers_to").isNotNull()
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("WARC-Page-ID", F.col("page_id"))]
    response = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", part("response")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), ("WARC-Refers-To-Page-ID", F.col("refers_to")),
         ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", part("request")), ("WARC-Concurrent-To", part("response")), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", part("metadata")), ("WARC-Concurrent-To", part("response")), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)))
    found = pages.select(_kind(F.coalesce(url, F.lit("urn:none")), F.coalesce(html, F.lit(""))).alias("kind")).distinct()
    for (kind,) in sorted(found.collect()) or [(0,)]:  # some thirty powers of two, at most
        records = rows.where(F.col("kind") == kind).select(F.explode(F.array(request, response, metadata)).alias("value"))
        captures = max(1, CAPTURES_PER_FILE >> kind)
        records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)


def parse(data: bytes, file: str = "", payloads: bool = True):
    """The records of an archive, gzipped or not, as tuples of `RECORD`, one at a time. Raises ValueError where it isn't one."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while first := source.readline():
        lines = [first]
        while lines[-1] and not (lines[-1] == b"\r\n" and lines[-2].endswith(b"\r\n")):
            lines.append(source.readline())
        if not lines[-1] or not first.startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at byte {at}")
        head = b"".join(lines)
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[:-4].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields["content-length"])
        block = source.read(size)
        if len(block) < size:
            raise ValueError(f"{file}: record at byte {at} is cut short")
        kind, digest, n, payload = fields.get("warc-type"), None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            n = len(payload)
            if kind == "response":
                digest = hashlib.sha256(payload).hexdigest()
                if (said := fields.get("warc-payload-digest")) and said != f"sha256:{digest}":
                    raise ValueError(f"{file}: record at byte {at} has another payload than its digest says")
            else:
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                found = regex.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", http)
                n = int(found[1]) if found else None
        whole = lambda k: int(fields[k]) if k in fields else None
        yield (file, at, kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), whole("warc-refers-to-page-id"), fields.get("warc-target-uri"), whole("warc-page-id"), digest, n, fields if payloads else None, payload if payloads else None)
        at += len(head) + size
        if source.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: record ending at byte {at} isn't closed")
        at += 4


def _pieces(records: Iterator[tuple], rows: int = 10_000, size: int = 16 << 20) -> Iterator[list[tuple]]:
    """Lists of records, up to so many rows or until their payloads have so many bytes."""
    piece, held = [], 0
    for r in records:
        piece.append(r)
        held += len(r[-1] or b"")
        if len(piece) >= rows or held >= size:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of every archive under ``path``; without ``payloads`` their contents are digested and left behind."""
    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]

    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                for found in _pieces(parse(bytes(data), file, payloads)):
                    yield pd.DataFrame(found, columns=names, dtype=object).astype({"refers_to": "Int64", "page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: nested request, response (or revisit) and metadata, brought together by the concurrent-to ids in one pass.

    Records of one id are one. A response without a request or metadata has null there; requests and metadata of no response are left out. Of
    several requests (or metadata) of one response, the one with the smallest record id is taken.
    """
    kept = ["record_id", "type", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "fields", "payload"]
    main = F.col("type").isin("response", "revisit")
    of = lambda which, fields: F.min_by(F.struct(*fields), F.when(which, F.col("record_id")))
    sides = [of(F.col("type") == kind, ("record_id", "target_uri", "fields")).alias(kind) for kind in ("request", "metadata")]
    rows = records.where(main | F.col("type").isin("request", "metadata")).withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    return rows.groupBy("capture").agg(of(main, kept).alias("response"), *sides).where("response is not null").select("capture", "request", "response", "metadata")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, complete (request and metadata found) of every page, written to archives and read back.

    Null html: an empty payload. Null url: urn:none. Rows of equal page_id are captures of their own; of those with the
    smallest id of a payload all are responses. A page without an id is always a response. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, page_id, url, html)
    until_exit(spark, path)
    r = transactions(read_records(spark, path, payloads=False))
    return r.select("response.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "response.refers_to", (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete"))
