"""WARC archives: index first, then coalesced byte-range reads.

Writing gives one gzip member per record and one index row (file, offset, length, URL,
digest). Reading takes any selection of index rows, sorts it by place, merges near
ranges into single reads and parses the records.

Of records with equal payloads of at least `least` bytes, the one with the largest
page_id is a response and the others are revisits of it; smaller payloads are always
responses.

Defined results: a null html is the empty payload; a null url is written as an empty
one; rows that repeat page_id and payload of the response are responses too; rows
without page_id are responses unless a row with one has the same payload; an empty
table gives no archive and no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import files, workers
from lamina.session import Scratch, small_batches

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def payload_classes(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """digest, size and keeper of each payload that occurs more than once; narrow rows, pre-aggregated before the shuffle."""
    keys = pages.select(F.sha1("body").alias("digest"), F.octet_length("body").alias("size"), "page_id").where(F.col("size") >= least)
    classes = keys.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    return scratch.table("classes", classes.select("digest", "size", "keeper"))


def record_bytes(page_id, url, body: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.0 record, before compression."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + body
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(body)}", *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names) and payload of one record; raises ValueError where digest or length disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.0" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != fields["warc-payload-digest"][5:] or len(payload) != int(fields["x-payload-length"])):
        raise ValueError("payload differs from its digest or length")
    return fields | {"payload": payload}


def _number(urn: str | None):
    return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None


def write_archives(pages: DataFrame, scratch: Scratch, least: int = LEAST, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write every row of pages(page_id, url, html) and return the index, itself written first to the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    classes = payload_classes(rows, scratch, least)
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body")}).join(classes, ["digest", "size"], "left")
    rows = rows.select("page_id", "url", "body", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    folder = scratch.path("archives")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri = stream = None
        at = 0
        try:
            for batch in batches:
                out = []
                for page_id, url, body, digest, refers_to in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                    if stream is None or at > archive_bytes:
                        if stream is not None:
                            stream.close()
                        uri, stream = files.create(folder, "pages", ".warc.gz")
                        at = 0
                    page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                    gzip = zlib.compressobj(1, wbits=31)
                    member = gzip.compress(record_bytes(page_id, url, body.encode(), digest, refers_to)) + gzip.flush()
                    stream.write(member)
                    out.append((page_id, url, digest, "response" if refers_to is None else "revisit", uri, at, len(member)))
                    at += len(member)
                frame = pd.DataFrame(out, columns=["page_id", "url", "digest", "record_type", "archive", "offset", "length"])
                yield frame.astype({"page_id": "Int64"})
        finally:
            if stream is not None:
                stream.close()

    return scratch.table("index", rows.mapInPandas(workers.task(write), INDEX))


def read_records(index: DataFrame, with_html: bool = False, span: int = 64 << 20) -> DataFrame:
    """Read the selected index rows back, in sorted, coalesced byte ranges. Revisits have no html."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("archive", "offset", "length").repartition(parts, "archive", F.floor(F.col("offset") / span)).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = files.Reader()
        for batch in batches:
            out = []
            for archive, own in batch.groupby("archive", sort=False):
                for start, end, members in files.coalesced(zip(own["offset"].astype(int), own["length"].astype(int), own.index, strict=True)):
                    block = source.read(archive, start, end - start)
                    for offset, length, _ in members:
                        r = parse_record(zlib.decompress(block[offset - start : offset - start + length], wbits=31))
                        html = r["payload"].decode() if with_html and r["warc-type"] == "response" else None
                        out.append((
                            _number(r["warc-record-id"]), r["warc-target-uri"], int(r["x-payload-length"]), r["warc-payload-digest"][5:],
                            r["warc-type"], _number(r.get("warc-refers-to")), html,
                        ))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        source.close()

    return placed.mapInPandas(workers.task(read), RECORD)


def warc_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to archives in the shared folder and return what reading them back gives."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, scratch, least))
