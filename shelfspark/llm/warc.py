"""Operator 7: WARC archives compressed with Zstandard and a dictionary, written and read back.

An archive starts with a skippable frame that holds the dictionary (itself compressed);
then each record is a frame of its own.  Records of a payload that an earlier page has
are revisits and carry no payload.  The reader takes the dictionary from the leading
frame, decodes one frame at a time and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, join_uri, put_file, scratch, slices, table, tidy

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many pages of the lowest hashes, on the first bytes of each, up to a size.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 300, 1 << 15, 1 << 15
#: A hot digest's pages are spread over so many join keys.
SALTS = 16
ARCHIVE_BYTES = 1 << 30


class BadArchive(ValueError):
    """An archive breaks a rule of the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; empty where there are too few."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a URL's spaces, controls and non-ASCII characters are percent-encoded."""
    target = re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{page_id}").encode("utf-8")).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _page(value: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(null|-?\d+)>", value)
    if not m:
        raise BadArchive(f"not a page's id: {value[:80]}")
    return None if m[1] == "null" else int(m[1])


def parse_record(data: bytes) -> Record:
    """Check a decoded frame: version, header lines, the length, the end, the block's digest."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("a frame doesn't start with a WARC version and headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"not a header line: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive("the block's length isn't the Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise BadArchive("the block's digest differs")
    return Record(headers, block)


def read_archive(uri: str, chunk: int = 1 << 20) -> Iterator[Record]:
    """Records of an archive, one frame at a time; memory holds one record and one chunk."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as source:
        left, dictionary = source.read(8), None
        if len(left) == 8 and struct.unpack("<I", left[:4])[0] == SKIPPABLE:
            size = struct.unpack("<I", left[4:])[0]
            raw = source.read(size)
            if len(raw) != size:
                raise BadArchive("the dictionary is cut off")
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
            dictionary, left = zstandard.ZstdCompressionDict(raw), b""
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while left or (left := source.read(chunk)):
            frame, parts = decoder.decompressobj(), []
            while True:
                try:
                    parts.append(frame.decompress(left))
                except zstandard.ZstdError as e:
                    raise BadArchive(f"a frame can't be decoded: {e}") from e
                left = frame.unused_data
                if frame.eof:
                    break
                if not (left := source.read(chunk)):
                    raise BadArchive("the last frame is cut off")
            yield parse_record(b"".join(parts))


def payload_facts(r: Record) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, record type and the page that a revisit refers to, all checked."""
    head, sep, payload = r.block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.I)
    if not sep or not size or not head.startswith(b"HTTP/"):
        raise BadArchive("the block isn't an HTTP response with a length")
    digest = r.headers.get("warc-payload-digest", "")
    if r.kind == "response":
        if len(payload) != int(size[1]) or digest != f"sha1:{base32_sha1(payload)}":
            raise BadArchive("the payload's length or digest differs")
    elif r.kind != "revisit" or payload or "warc-refers-to" not in r.headers or r.headers.get("warc-profile") != PROFILE:
        raise BadArchive(f"not a proper {r.kind} record")
    return _page(r.headers["warc-record-id"]), int(size[1]), digest.removeprefix("sha1:"), r.kind, _page(r.headers["warc-refers-to"]) if r.kind == "revisit" else None


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and `original`: the smallest page_id of an equal payload that another page has, else null.

    Digests are counted before anything is joined; only those of several pages come back, spread over salts,
    so that a digest of a third of all pages meets no single task.
    """
    facts = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    raw = F.encode("html", "utf-8")
    facts = facts.withColumns({"digest": F.sha1(raw), "size": F.octet_length(raw), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    several = facts.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    several = several.select("digest", "size", "original", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return facts.join(several, ["digest", "size", "salt"], "left").select("page_id", "url", "html", "original")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page; returns the manifest, a row per archive (path, records, bytes), in the shared folder."""
    spark = pages.sparkSession
    sample = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_BYTES).alias("html"), F.xxhash64("page_id", "url").alias("h")).orderBy("h").limit(SAMPLE_PAGES)
    sample = cut(sample, "dictionary-pages")  # merged by a task: the driver gets SAMPLE_PAGES rows, not as many of each task
    dictionary = train_dictionary([record(i, None, r.html.encode(), None, False) for i, r in enumerate(sample.orderBy("h").collect())])
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICT_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}))
        rows = (row for b in slices(batches, "html") for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "original")), strict=True))
        n = 0

        def frames() -> Iterator[bytes]:
            nonlocal n
            yield dictionary_frame(shared.value)
            size = 0
            while size < ARCHIVE_BYTES and (row := next(rows, None)):
                page_id, url, html, original = row
                frame = packer.compress(record(page_id, url, html.encode("utf-8"), original, original is not None and original != page_id))
                size, n = size + len(frame), n + 1
                yield frame

        k = 0
        while True:
            n, name = 0, f"pages-{task.partitionId():06d}-{k:04d}.warc.zst"
            size = put_file(folder, name, frames(), str(task.taskAttemptId()))
            yield pa.RecordBatch.from_pydict({"path": [join_uri(folder, name)], "records": [n], "bytes": [size]})
            k += 1
            if n == 0 or size < ARCHIVE_BYTES:
                break

    return cut(with_originals(pages, min_bytes).mapInArrow(tidy(write), "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives, each checked against its headers; the records must be as many as were written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                for r in read_archive(path):
                    rows.append(payload_facts(r))
                    n += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                if n != expected:
                    raise BadArchive(f"{path} has {n} records of {expected}")

    return archives.select("path", "records").repartition(max(1, min(archives.count(), 4096))).mapInArrow(tidy(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a record, read the archives back; a row per page.

    A null html is an empty payload; a null url becomes the page's own URN. Rows that repeat a page_id with the
    same payload are responses all, since none can refer to itself. A null page_id never is an original unless
    no other page has the payload. An empty table gives archives without records and no row. Further columns take no
    part. Memory: some copies of one page, however long, and a slice of shorter ones.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages, scratch(spark, "warc")))
