"""Operator 5, WARC revisit resolution.

Payload digests and sizes of the records (headers, no payloads) are grouped by digest to find each payload's original, the
largest id; then every record gets fresh headers: a response with its payload, or a revisit that names the original. Revisits are
made of headers alone. Of the responses, only those whose payload may be shared are shuffled, by id and digest, so that a hot payload
spreads. The archives are WARC 1.1 in gzip, one member a file, of about ``FILE_BYTES`` at most, written by Spark into a shared folder, and read back record by record by their Content-Length;
revisits read there are joined to the responses read there.

A null payload is an empty one. Records below ``least`` bytes are all responses. Rows that tie on the largest id of a
payload are all responses (ids are expected to be unique); a null id sorts below all others. An empty table gives none. Only
the id, the URL and the payload are read of the columns.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_in

#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Payload bytes of an archive file, about.
FILE_BYTES = 64_000_000


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest: what the shuffle sees of a record."""
    p = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.octet_length(p).cast("long").alias("payload_bytes"), F.sha1(p.cast("binary")).alias("payload_digest"), p.alias("payload"))


def originals(heads: DataFrame, least: int = 1000) -> DataFrame:
    """payload_digest, refers_to: the original of each payload that more than one record may share."""
    return heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")


def records(heads: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record: the text of each WARC record without its end mark; heads: page_id, url, payload_bytes, payload_digest, payload, revisit, refers_to."""
    again = F.col("revisit")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\x00-\\x20\\x7F]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return heads.select(F.concat(head, body).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE_BYTES, **names: str) -> None:
    """Write one record for each row of pages to gzip archives under path."""
    heads = headers(pages, **names)
    narrow = cut(heads.drop("payload"), "heads")
    first = cut(originals(narrow, least), "originals")
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    again = cut(narrow.join(first, "payload_digest").where(other), "revisits").withColumn("revisit", F.lit(True)).withColumn("payload", F.lit(""))
    told = maybe_in(heads, "payload_digest", first, name="may").withColumn("revisit", F.lit(False)).withColumn("refers_to", F.lit(None).cast("long"))
    gone = again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"))
    shared = told.where("may").join(gone, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left_anti")
    whole = told.where("not may").unionByName(shared).drop("may").unionByName(again)
    n, size = narrow.agg(F.count("*"), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    rows = max(1, int(file_bytes * n / (size + 500 * n))) if n else 1
    records(whole).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


def parse(archive: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive, which comes in chunks."""
    held = io.BytesIO()

    def fill(at: int, n: int) -> bytes:
        """At least n bytes from at on, if there are so many."""
        held.seek(0, 2)
        while held.tell() < at + n and (more := next(archive, None)) is not None:
            held.write(more)
        return held.getbuffer()[at : at + n].tobytes()

    at = 0
    while True:
        ahead = 4096
        while (head := fill(at, ahead)) and (end := head.find(b"\r\n\r\n")) < 0:
            if len(head) < ahead:
                raise ValueError("a record's headers are cut off")
            ahead *= 2
        if not head:
            return
        first, *lines = head[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record where one must start")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block = fill(at + end + 4, n + 4)
        if block[n:] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield fields, block[:n]
        at += end + 8 + n
        if at > 8_000_000:
            held.seek(at)
            held, at = io.BytesIO(held.read()), 0


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, in chunks."""
    while data:
        z = zlib.decompressobj(31)
        rest = data
        while not z.eof:
            chunk = z.decompress(rest, step)
            rest = z.unconsumed_tail
            if chunk:
                yield chunk
            elif not rest and not z.eof:
                raise ValueError("the file is cut off")
        data = z.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the records under path; sizes and digests are of the full payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x == "none" else int(x)
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for fields, block in parse(inflate(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2]
                    own = fields["WARC-Type"] == "response"
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if own and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError("a payload does not have its digest")
                    to = fields.get("WARC-Refers-To")
                    rows.append((number(fields["WARC-Record-ID"][10:-1]), fields["WARC-Target-URI"], len(payload) if own else None, said, fields["WARC-Type"], to and number(to[10:-1])))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    read = cut(files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    own = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("full")).dropDuplicates(["refers_to", "payload_digest"])
    again = read.where("record_type = 'revisit'").join(cut(own, "responses"), ["refers_to", "payload_digest"], "left")
    return read.where("record_type = 'response'").unionByName(again.withColumn("payload_bytes", F.col("full")).drop("full"))
