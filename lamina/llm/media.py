"""Media columns: content-addressed payloads in tar shards, header-only reads for metadata, whole reads for features.

Each text becomes a grey 8-bit PNG whose samples are the UTF-8 bytes padded with 255
to a positive multiple of 576 (one row of the image per 576 bytes). Tasks append the
images to tar shards in the shared folder under the SHA-256 of the stored form; a
payload met again in the same shard is not written twice. Rows carry only shard,
digest, offset and length, so no payload is shuffled.

Defined results: a null text is the empty text (one row of 255s); repeated rows and
repeated ids give one output row each, with equal values for equal texts; an empty
table gives an empty result; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import files, workers
from lamina.session import Scratch, small_batches

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"
METADATA = "media_format string, width int, height int, bit_depth int"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    f"media_sha256 string, feature string, shard string, offset long, {METADATA}"
)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, unit: int = UNIT, level: int = 1) -> bytes:
    """Grey 8-bit PNG, one row per `unit` bytes, filter 0 on every row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, unit)
    lines = np.zeros((len(rows), unit + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", unit, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    width, height, _ = png_header(stored)
    at, data = 8, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data += stored[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean and deviation of the samples in thousandths and a 16-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(x >> 4, minlength=16)
    return f"mean={int(x.mean() * 1000)};std={int(x.std() * 1000)};hist={','.join(map(str, histogram))}"


def write_shards(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = 256 << 20) -> DataFrame:
    """Store every text; returns doc_id, n_bytes, shard, digest, offset, length (lazy: write it out before reading back)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri = stream = None
        at, seen = 0, {}
        try:
            for batch in batches:
                rows = []
                for key, text in zip(batch["k"], batch["t"], strict=True):
                    raw = text.encode() if isinstance(text, str) else b""
                    stored = encode_png(pad(raw))
                    digest = hashlib.sha256(stored).hexdigest()
                    if stream is None or at > shard_bytes:
                        if stream is not None:
                            stream.write(b"\0" * 1024)
                            stream.close()
                        uri, stream = files.create(folder, "shard", ".tar")
                        at, seen = 0, {}
                    if digest not in seen:
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(stored)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        stream.write(head + stored + b"\0" * (-len(stored) % 512))
                        seen[digest] = at + len(head)
                        at += len(head) + len(stored) + -len(stored) % 512
                    rows.append((key, len(raw), uri, digest, seen[digest], len(stored)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        finally:
            if stream is not None:
                stream.write(b"\0" * 1024)
                stream.close()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInPandas(workers.task(write), INDEX)


def _by_place(index: DataFrame, span: int = 64 << 20) -> DataFrame:
    """Rows of neighbouring bytes in one task, in file order."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "shard", F.floor(F.col("offset") / span)).sortWithinPartitions("shard", "offset")


HEADER = 33


def read_metadata(placed: DataFrame, gap: int = 4 << 10) -> DataFrame:
    """Fill format, width, height and bit depth from reads of the headers alone; payloads longer than `gap` stay where they are.

    placed: index rows as _by_place deals them.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = files.Reader()
        for batch in batches:
            heads: dict[int, tuple[int, int, int]] = {}
            for shard, of_shard in batch.groupby("shard", sort=False):
                ranges = ((int(o), HEADER, i) for o, i in zip(of_shard["offset"], of_shard.index, strict=True))
                for start, end, members in files.coalesced(ranges, gap):
                    block = source.read(shard, start, end - start)
                    heads |= {i: png_header(block[offset - start : offset - start + HEADER]) for offset, _, i in members}
            yield batch.assign(media_format="png", **{c: [heads[i][n] for i in batch.index] for n, c in enumerate(("width", "height", "bit_depth"))})
        source.close()

    return placed.mapInPandas(workers.task(read), f"{INDEX}, {METADATA}")


def read_features(described: DataFrame) -> DataFrame:
    """Checks and features of the payloads, read back in coalesced ranges, beside the metadata that is there; in the order of `described`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = files.Reader()
        last, values = None, None
        for batch in batches:
            rows = []
            known = batch[["media_format", "width", "height", "bit_depth"]].to_dict("index")
            for shard, of_shard in batch.groupby("shard", sort=False):
                ranges = zip(of_shard["offset"].astype(int), of_shard["length"].astype(int), of_shard.index, strict=True)
                for start, end, members in files.coalesced(ranges):
                    block = source.read(shard, start, end - start)
                    for offset, length, i in members:
                        if last != (shard, offset):
                            stored = block[offset - start : offset - start + length]
                            payload = decode_png(stored)
                            values = (
                                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), length,
                                hashlib.sha256(stored).hexdigest(), describe(payload), shard, offset,
                            )
                            if values[4] != batch.at[i, "digest"] or len(payload) != known[i]["width"] * known[i]["height"]:
                                raise ValueError(f"{shard} at {offset}: stored bytes differ from their address or header")
                            last = (shard, offset)
                        rows.append((batch.at[i, "doc_id"], batch.at[i, "n_bytes"], *values, *known[i].values()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])
        source.close()

    return described.mapInPandas(workers.task(read), FEATURES)


def media_columns(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store all texts in shards of the shared folder and return the columns that reading them back gives."""
    scratch = Scratch(docs.sparkSession, "media")
    small_batches(docs.sparkSession)
    index = scratch.table("index", write_shards(docs, scratch.path("shards"), text_col, id_col))
    return read_features(read_metadata(_by_place(index)))


def members(shard: bytes) -> dict[str, bytes]:
    """All files of one tar shard (for tests)."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
