"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

Archives go to a folder all executors share. A task writes archives of about ``ROLL`` payload bytes under names of its own
attempt and hands back their names; only archives of attempts that Spark accepted are ever read, so lost or repeated
tasks leave no trace in the result. Reading streams frame by frame and holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, file_system, shared_folder, stage

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
# Parameters.
ROLL = 128 << 20  # payload bytes per archive
SAMPLE, DICTIONARY = 2 << 20, 64 << 10  # bytes of leading records that an archive's dictionary is made from; its size
LEAST = 1000  # bytes of a payload worth a revisit
READ = 1 << 20

_LENGTH = re.compile(rb"\A[0-9]+\Z")
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


class BadArchive(ValueError):
    """A frame, header or length that does not hold."""


def record_uri(page_id) -> str:
    return f"urn:page:{'unnamed' if page_id is None else page_id}"


def _clean(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: a response holds the payload; a revisit holds only the HTTP header, whose length field still tells it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE),
        *([("WARC-Target-URI", _clean(url))] if url else []), ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:60]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _length(fields: dict) -> int:
    value = fields.get("content-length", "").encode()
    if not _LENGTH.match(value):
        raise BadArchive("no valid Content-Length")
    return int(value)


def decode_record(data: bytes) -> tuple:
    """A row of ``RECORD_SCHEMA``; raises ``BadArchive`` if a header, a length or a response's digest does not hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive("no WARC header")
    fields = _fields(lines[1:])
    kind, size = fields.get("warc-type"), _length(fields)
    if kind not in ("response", "revisit") or "warc-record-id" not in fields or "warc-date" not in fields:
        raise BadArchive("a mandatory header is missing")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive("the block is not as long as its header says")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("no HTTP header")
    told = _length(_fields(http.split(b"\r\n")[1:]))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (told != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadArchive("the payload does not match its length or digest")
    refers = fields.get("warc-refers-to", "").strip("<>") or None
    if kind == "revisit" and (payload or not refers):
        raise BadArchive("a revisit with a payload or without a reference")
    return fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), told, digest, refers, payload


def make_dictionary(samples: list[bytes]):
    """A trained dictionary, or the leading bytes as they are where there is too little to train on."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY, samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY].ljust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Keeps records until there is enough for a dictionary, then writes a frame per record."""

    def __init__(self, sink):
        self.sink, self.held, self.held_bytes, self.encoder = sink, [], 0, None

    def add(self, record: bytes) -> None:
        if self.encoder is not None:
            self.sink.write(self.encoder.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE:
            self._start()

    def _start(self) -> None:
        import zstandard as zstd

        dictionary = make_dictionary(self.held)
        packed = zstd.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.encoder = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.held:
            self.sink.write(self.encoder.compress(record))
        self.held = []

    def close(self) -> None:
        if self.encoder is None:
            self._start()
        self.sink.close()


def _exactly(source, size: int) -> bytes:
    data = b""
    while len(data) < size:
        more = source.read(size - len(data))
        if not more:
            raise BadArchive("the archive ends early")
        data += more
    return data


def read_archive(source):
    """Records (bytes) of an open archive, one frame each. The dictionary frame may be packed or plain."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", _exactly(source, 8))
    if magic != SKIPPABLE:
        raise BadArchive("no leading dictionary frame")
    packed = _exactly(source, size)
    plain = zstd.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(plain))
    rest = b""
    while True:
        rest = rest or source.read(READ)
        if not rest:
            return
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstd.ZstdError as e:
                raise BadArchive(f"a frame cannot be decoded: {e}") from e
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(READ)
            if not rest:
                raise BadArchive("the last frame is cut")
        yield b"".join(parts)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null where not stored), payload_bytes, payload_digest, refers_to.

    Of equal payloads of ``least`` bytes or more, the largest page_id is the response. Only ids and digests are grouped,
    combined before they move; pages are looked up by digest in a plain join, whose hot digests Spark splits.
    """
    payload = binary("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    copies = (
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL")
    )
    joined = rows.join(copies, "payload_digest", "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, F.col("holder")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write ``with_revisits`` rows as archives below ``folder``; returns the stored (archive, n_records) table."""

    def of_part(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        writer, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if writer is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    writer = ArchiveWriter(system.open_output_stream(f"{base}/{name}"))
                writer.add(encode_record(record_uri(page_id), url, payload, digest, None if refers is None else record_uri(refers)))
                count, size = count + 1, size + len(payload)
                if size >= roll:
                    writer.close()
                    done.append((name, count))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "n_records"])

    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return stage(rows.mapInArrow(of_part, "archive string, n_records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives as ``RECORD_SCHEMA``; an archive that does not hold fails the job."""

    def of_part(batches):
        system, base = file_system(folder)
        names = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name, expected in zip(*(batch.column(i).to_pylist() for i in range(2))):
                rows, size, count = [], 0, 0
                with system.open_input_stream(f"{base}/{name}") as source:
                    for data in read_archive(source):
                        rows.append(decode_record(data))
                        size, count = size + len(data), count + 1
                        if size >= READ:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)
                if count != expected:
                    raise BadArchive(f"{name} holds {count} records, not {expected}")

    count = max(1, archives.count())
    return archives.select("archive", "n_records").repartition(count).mapInArrow(of_part, RECORD_SCHEMA)


def round_trip(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: ``RECORD_SCHEMA``.

    Null html is an empty payload, a null url has no target, a null page_id is never referred to. Rows of the largest
    page_id that repeat are all responses. An empty table writes no archive and gives no rows; other columns are ignored.
    """
    folder = f"{shared_folder(pages.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_revisits(pages), folder), folder)
