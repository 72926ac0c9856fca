"""WARC archives of one Zstandard frame per record, with the dictionary in a leading skippable frame.

Written and read as streams, one file per task and at most so many bytes of payload; the folder is the shared one.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_name, filesystem, materialise, new_path, small_batches

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of Zstandard frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of a dictionary, and payload bytes at the head of an archive that it is taken from.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
#: Payload bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


NO_PAGE = "<urn:no-page>"


def record_name(page_id) -> str:
    return NO_PAGE if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    """The page id that a record's name holds, as string; none if it names no page."""
    return None if name == NO_PAGE else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


# -- writing --------------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, revisit_of=None) -> bytes:
    """A response record with the payload, or a revisit record with the payload's HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit_of is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisit_of is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
    ]
    if revisit_of is not None:
        lines += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: {record_name(revisit_of)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, sink):
        self.sink, self.held, self.size, self.compressor = sink, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor:
            self.sink.write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            self._open()

    def _open(self) -> None:
        # a content dictionary from the records held: their heads, which carry what pages have in common
        share = max(256, DICTIONARY_BYTES // max(1, len(self.held)))
        raw = b"".join(r[:share] for r in self.held)[-DICTIONARY_BYTES:]
        raw = raw.ljust(8, b" ")
        if len(self.held) >= 64:
            try:
                raw = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:4096] for r in self.held]).as_bytes()
            except zstandard.ZstdError:  # too little to learn from
                pass
        self.sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
        held, self.held = self.held, []
        for data in held:
            self.sink.write(self.compressor.compress(data))

    def close(self) -> None:
        if not self.compressor:
            self._open()
        self.sink.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """``path, records`` of each archive. ``pages``: ``page_id, url, payload`` (binary), ``refers_to``.

    File names are new on every attempt, and only those of attempts that succeed are returned, so a task that is run
    again leaves no half file in the result.
    """
    small_batches(pages.sparkSession, 64)

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        writer, name, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, other in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                if writer is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    writer = ArchiveWriter(fs.open_output_stream(f"{root}/{name}"))
                writer.add(record(page_id, url, payload, other))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    writer.close()
                    writer = None
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})
        if writer:
            writer.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    wide = pages.select(as_name(pages, "page_id").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", as_name(pages, "refers_to").alias("refers_to"))
    return wide.mapInPandas(run, "path string, records bigint")


# -- reading --------------------------------------------------------------------------------------


class Stream:
    """Bytes from ``source`` with what was read too far kept for the next call."""

    def __init__(self, source):
        self.source, self.left = source, b""

    def some(self) -> bytes:
        data, self.left = self.left or self.source.read(READ_BYTES), b""
        return data

    def exactly(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n and (data := self.some()):
            parts.append(data)
            have += len(data)
        data = b"".join(parts)
        if have < n:
            raise ValueError("archive ends inside a frame")
        self.left = data[n:] + self.left
        return data[:n]

    def at_end(self) -> bool:
        if not self.left:
            self.left = self.source.read(READ_BYTES)
        return not self.left


def frames(source) -> Iterator[bytes]:
    """The content of each frame after the dictionary, one at a time."""
    stream = Stream(source)
    magic, size = struct.unpack("<II", stream.exactly(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("archive has no leading dictionary frame")
    raw = stream.exactly(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while not stream.at_end():
        frame, out = engine.decompressobj(), io.BytesIO()
        while not frame.eof:
            data = stream.some()
            if not data:
                raise ValueError("archive ends inside a frame")
            out.write(frame.decompress(data))
        stream.left = frame.unused_data + stream.left
        yield out.getvalue()


def parse_headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    return first, fields


def parse_record(data: bytes) -> dict:
    """Validated fields of a record: version, lengths of block and payload, digests of both."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, fields = parse_headers(head)
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    if fields["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError("block digest does not match")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, http_fields = parse_headers(http)
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("block is not an HTTP message")
    size, digest, kind = int(http_fields["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("payload does not match its headers")
    if kind == "revisit" and (payload or fields.get("warc-profile") != SAME):
        raise ValueError("bad revisit record")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind!r}")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None,
    }


FIELDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True, parts: int | None = None, id_type: T.DataType | str = "string") -> DataFrame:
    """A row per record of the archives in ``path``; null payload for revisits, or everywhere without ``payloads``.

    A task reads an archive as a stream and holds one record at a time. A broken archive is an error.
    """
    columns = [c.split()[0] for c in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                fs, name = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(name) as source:
                    for data in frames(source):
                        row = parse_record(data)
                        row["payload"] = row["payload"] if payloads else None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > READ_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    paths = archives.select("path")
    out = (paths.repartition(parts) if parts else paths).mapInPandas(run, FIELDS)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


# -- pages to archives and back -------------------------------------------------------------------


#: Pages that refer to another up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_REVISITS = 200_000


def with_references(pages: DataFrame, payload: Column) -> DataFrame:
    """``page_id, url, payload, refers_to``: the largest page id of an equal payload, null for that page itself.

    Who refers to whom is found on ids and digests alone. The payloads stay where they are read, unless so many
    pages are copies that the table of references has to be joined by a shuffle.
    """
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"))
    light = materialise(base.select("page_id", F.sha1("payload").alias("sha")), "digests")
    # only payloads found twice or more have anything to refer to; copies are counted where they lie
    last = light.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").select("sha", "last")
    revisits = light.join(last, "sha").where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("last").alias("refers_to"))
    revisits = materialise(revisits.distinct(), "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    return base.join(revisits, base["page_id"].eqNullSafe(revisits["_id"]) & (F.sha1("payload") == revisits["_sha"]), "left").select("page_id", "url", "payload", "refers_to")


def archive_pages(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id, url, html``; null html: empty) and reads them all back.

    Of rows with equal payloads that with the largest ``page_id`` is the response and the others revisit it; rows
    that tie on it are responses all. Null ids are less than any other, and a group of null ids alone is made of
    responses; ids are of any ordered type that its string form casts back to; null urls are written as
    ``about:blank``. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    records = with_references(pages, F.coalesce(F.col("html").cast("string"), F.lit("")))
    written = write_archives(records, folder)
    manifest = new_path(spark, "archives")
    written.write.parquet(manifest)
    archives = spark.read.schema("path string, records bigint").parquet(manifest)
    return read_archives(archives, payloads, max(1, archives.count()), pages.schema["page_id"].dataType)
