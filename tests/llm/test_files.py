import hashlib
import zlib

import pytest
from pyarrow import fs

from lamina.llm import files, media, queries, warc
from lamina.session import Scratch
from tests.oracle import assert_same, connection

PAGES = "page_id long, url string, html string, digest string, size string, keeper string, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, *"abcd") for i, u, h in rows], PAGES)


def test_warc_query_matches_sql(spark, small_dir):
    assert_same(queries.op5_warc(spark, small_dir), connection(small_dir), queries.ORACLES["op5_warc"])


def test_warc_edges(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [
        (1, "http://a/\r\n x", big), (5, None, big), (3, "http://b", big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other),
        (8, "u", other), (9, "u", "x" * 999), (10, "u", "x" * 999), (None, "u", "z" * 2000), (11, "u", "z" * 2000), (None, "u", "lone" * 500), (12, "u", "<html>\r\n\r\nWARC/1.0\r\n\r\n" + "q" * 2000),
    ]
    got = warc.warc_round_trip(pages(spark, rows)).collect()
    keep = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            keep[raw] = max(keep.get(raw, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        target = keep.get(raw)
        revisit = target is not None and target != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_selected_records_come_back_whole(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 40)) for i in range(60)]
    scratch = Scratch(spark, "w")
    index = warc.write_archives(pages(spark, rows), scratch)
    got = warc.read_records(index.where("page_id % 7 = 0"), with_html=True).collect()
    assert sorted((r["page_id"], r["html"]) for r in got) == [(i, h) for i, _, h in rows if i % 7 == 0]
    # an archive is a chain of gzip members with a record each
    system, path = fs.FileSystem.from_uri(index.first()["archive"])
    raw, n = system.open_input_file(path).read(), 0
    while raw:
        d = zlib.decompressobj(wbits=31)
        warc.parse_record(d.decompress(raw))
        raw, n = d.unused_data, n + 1
    assert n == index.where(index.archive == index.first()["archive"]).count()


def test_damaged_record_is_refused():
    raw = warc.record_bytes(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def test_coalesced_ranges():
    ranges = [(0, 10, "a"), (10, 5, "b"), (100, 5, "c"), (1000, 1, "d")]
    assert [(s, e, [m[2] for m in ms]) for s, e, ms in files.coalesced(ranges, gap=90)] == [(0, 105, ["a", "b", "c"]), (1000, 1001, ["d"])]
    assert list(files.coalesced([])) == []


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000])
def test_png_round_trip(size):
    raw = bytes(i * 7 % 256 for i in range(size))
    padded = media.pad(raw)
    assert len(padded) % 576 == 0 and len(padded) >= 576 and padded[: len(raw)] == raw and set(padded[len(raw) :]) <= {255}
    stored = media.encode_png(padded)
    assert media.decode_png(stored) == padded
    assert media.png_header(stored[:33]) == (576, len(padded) // 576, 8)


def test_media_columns(spark, edges, edge_rows, nothing):
    got = media.media_columns(edges).collect()
    assert len(got) == len(edge_rows)
    want = []
    for i, t in edge_rows:
        raw = (t or "").encode()
        padded = media.pad(raw)
        want.append(str((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), hashlib.sha256(media.encode_png(padded)).hexdigest())))
    assert sorted(want) == sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"])) for r in got)
    assert media.media_columns(nothing).count() == 0


def test_features_and_header_columns(spark, edges, edge_rows):
    texts = {t or "" for _, t in edge_rows}
    found = {}
    for t in texts:
        x = list(media.pad(t.encode()))
        mean = sum(x) / len(x)
        bins = [0] * 16
        for v in x:
            bins[v // 16] += 1
        found[hashlib.sha256(bytes(x)).hexdigest()] = (int(mean * 1000), int((sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5 * 1000), bins, len(x) // 576)
    for r in media.media_columns(edges).collect():
        mean, std, bins, height = found[r["payload_sha256"]]
        assert r["feature"] == f"mean={mean};std={std};hist={','.join(map(str, bins))}" and (r["media_format"], r["width"], r["height"], r["bit_depth"]) == ("png", 576, height, 8)


def test_shards_are_tar_files_addressed_by_content(spark, edges):
    scratch = Scratch(spark, "m")
    index = scratch.table("index", media.write_shards(edges.coalesce(1), scratch.path("shards")))
    rows = index.collect()
    assert len({r["shard"] for r in rows}) == 1
    system, path = fs.FileSystem.from_uri(rows[0]["shard"])
    raw = system.open_input_file(path).read()
    held = media.members(raw)
    assert {f"{r['digest']}.png" for r in rows} == set(held) and len(held) < len(rows)
    assert all(held[f"{r['digest']}.png"] == raw[r["offset"] : r["offset"] + r["length"]] for r in rows)
    heads = media.read_metadata(media._by_place(index)).collect()
    assert all((r["media_format"], r["width"], r["bit_depth"]) == ("png", 576, 8) for r in heads)
