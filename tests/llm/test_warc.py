"""Operator 7: archives written and read back."""

import base64
import hashlib
import struct

import pytest
import zstandard

from shelfspark.llm import warc
from shelfspark.llm.common import scratch, table

PAGES = "page_id long, url string, html string"


def rows():
    same = "<p>same page</p>" * 30
    many = [(100 + i, f"https://a.example/{i}", same) for i in range(60)]
    own = [(i, f"https://b.example/{i} x\r\nEvil: 1", f"<html><body>page number {i} é中 {'lorem ipsum ' * (i % 7)}</body></html>") for i in range(40)]
    return many + own + [(500, None, None), (501, "u", ""), (502, "big", "z" * 3_000_000), (40, "https://c.example", same), (None, "n", same), (600, "r", "twice"), (600, "r", "twice"), (None, "only", "alone")]


def test_round_trip(spark, tables):
    given = rows()
    got = warc.op7_warc_zstd(spark, tables(pages=(given, PAGES))).collect()
    first = {}
    for i, _, h in given:
        h = h or ""
        first[h] = min((x for x in (first.get(h), i) if x is not None), default=None)
    want = sorted((repr((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] in (None, i) else "revisit", None if first[h or ""] in (None, i) else first[h or ""])) for i, _, h in given))
    assert sorted(repr(tuple(r)) for r in got) == want


def test_archive_layout(spark, tables):
    folder = scratch(spark, "w")
    archives = warc.write_archives(table(spark, tables(pages=(rows(), PAGES)), "pages"), folder).collect()
    assert sum(a.records for a in archives) == len(rows())
    data = open(archives[0].path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20))
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: ") and one.eof
    records = [r for a in archives for r in warc.read_archive(a.path, chunk=97)]
    assert all("\r" not in v for r in records for v in r.headers.values()) and "evil" not in {k for r in records for k in r.headers}


def test_smaller_payloads_are_all_responses(spark, tables):
    given = [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "long enough"), (4, "d", "long enough")]
    pages = table(spark, tables(pages=(given, PAGES)), "pages")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, scratch(spark, "w"), min_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def damaged(tmp_path, change):
    record = warc.record(1, "https://a.example", b"<p>hello</p>", None, False)
    path = tmp_path / "x.warc.zst"
    path.write_bytes(change(record))
    return list(warc.read_archive(str(path)))


PACK = zstandard.ZstdCompressor().compress


def test_reader_validates(tmp_path):
    assert damaged(tmp_path, PACK)[0].kind == "response"
    for change in (
        lambda r: PACK(r)[:-3],
        lambda r: PACK(r.replace(b"hello", b"hellx")),
        lambda r: PACK(r.replace(b"WARC/1.1", b"WARC/9.9")),
        lambda r: PACK(r.replace(b"WARC-Date", b"WARC-Dote")),
        lambda r: PACK(r[:-4]),
        lambda r: PACK(r.replace(b"Content-Length: 1", b"Content-Length: x")),
        lambda r: PACK(r) + b"garbage",
        lambda r: PACK(r.replace(b"WARC-Date:", b"WARC-Date ")),
    ):
        with pytest.raises(warc.BadArchive):
            damaged(tmp_path, change)


def test_empty_table(spark, tables):
    assert warc.op7_warc_zstd(spark, tables(pages=([], PAGES))).count() == 0
