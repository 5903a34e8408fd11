"""WARC archives compressed record by record with Zstandard, dictionary first.

An archive begins with a skippable frame that holds the dictionary; then every record is one frame.  Each task writes
archives of its own rows into the shared folder and reports their paths, so a repeated task leaves an unused file and
nothing else; a reader takes one archive a task and holds one record at a time.

Payloads move once, dealt by the digest where that digest repeats and at random elsewhere.  Digests that repeat very often are
too few to matter and go to every task, so that one popular payload is not one task.

Of rows with equal payloads (by SHA-1) of at least ``REVISIT_BYTES``, the one with the largest id becomes a response and the others revisit it.
A null payload is empty.  Rows that repeat the largest id are responses too, as are all rows of a group without
ids.  A null url leaves the target header out.  An empty table gives no archive and an empty result.
A record that breaks the format is reported in ``error`` with what could be read of it; the rest of its archive follows
where frames can still be told apart.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_ROWS = 200
"""The dictionary is trained on so many rows at most, ``DICTIONARY_CHARS`` of each."""
DICTIONARY_CHARS = 8192
HOT_SHARE = 10_000
"""A digest of more than this part of all repeated rows is hot; there are fewer than ``HOT_SHARE`` of them, which bounds what is broadcast."""
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
_CHUNK = 1 << 20


def trained_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads; empty when they are too few to train on."""
    import zstandard

    rows = pages.select(F.substring(F.col(payload), 1, DICTIONARY_CHARS)).filter(F.col(payload).isNotNull()).limit(DICTIONARY_ROWS).collect()
    samples = [r[0].encode() for r in rows if r[0]]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_record_types(pages: DataFrame, page_id: str = "page_id", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
    """page_id, url, payload (string), digest, record_type and refers_to of each row."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), "url", F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = rows.filter(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    groups = written(slim.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1"), "warc-groups")
    hot_rows = (groups.agg(F.sum("n")).first()[0] or 0) // hot_share
    hot = groups.filter(F.col("n") > hot_rows).select(F.col("digest").alias("hot_digest"), F.col("target").alias("hot_target"))
    rest = groups.filter(F.col("n") <= hot_rows).select(F.col("digest").alias("key"), "target")
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    dealt = F.col("hot_digest").isNull() & (F.octet_length("payload") >= revisit_bytes)
    key = F.when(dealt, F.col("digest")).otherwise(F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")))
    found = marked.withColumn("key", key).join(rest, "key", "left").withColumn("target", F.coalesce("hot_target", "target"))
    refers: Column = F.when(F.col("page_id").eqNullSafe(F.col("target")), None).otherwise(F.col("target"))
    return found.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but not the payload."""
    from urllib.parse import quote

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_record_types`` below ``folder``; returns the written manifest (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=3, dict_data=trained).compress
        out, path, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [count], "n_bytes": [size]})

        for part in batches:
            for page_id, url, payload, digest, refers_to in zip(*[part.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                if out is None:
                    path, size, count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
                frame = compress(record_bytes(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), refers_to.as_py()))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    found = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, n_records long, n_bytes long")
    return written(found, "warc-manifest")


def frames(stream, chunk: int = _CHUNK) -> Iterator[tuple[bytes | None, str | None]]:
    """(content, error) of every frame of an archive after its dictionary."""
    import zstandard

    data = stream.read(chunk)
    trained = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size and (more := stream.read(chunk)):
            data += more
        if len(data) < 8 + size:
            yield None, "the dictionary's frame is cut short"
            return
        raw, data = data[8 : 8 + size], data[8 + size :]
        if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        trained = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=trained)
    while True:
        if not data and not (data := stream.read(chunk)):
            return
        one, parts = decoder.decompressobj(), []
        try:
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    data = one.unused_data
                    break
                if not (data := stream.read(chunk)):
                    yield b"".join(parts), "the last frame is cut short"
                    return
        except zstandard.ZstdError as e:
            yield None, f"not a frame: {e}"
            return
        yield b"".join(parts), None


def _headers(block: bytes) -> dict[str, str]:
    pairs = [line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _id(value: str | None) -> int | None:
    number = (value or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(record: bytes) -> dict:
    """The fields of one record; ``error`` says which check failed first."""
    row = dict.fromkeys(("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "error"))
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return row | {"error": "no WARC header"}
    h = _headers(head.partition(b"\r\n")[2])
    row |= {"page_id": _id(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "refers_to": _id(h.get("warc-refers-to"))}
    row["payload_digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        return row | {"error": "missing " + ", ".join(missing)}
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return row | {"error": "Content-Length does not fit the frame"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = _headers(http).get("content-length", "")
    if not gap or not length.isdigit():
        return row | {"error": "no HTTP header with a length"}
    row["payload_bytes"] = int(length)
    if row["record_type"] == "revisit":
        return row | ({"error": "a revisit with a payload"} if payload else {})
    row["payload"] = payload
    if len(payload) != int(length):
        return row | {"error": "the payload's length is not the HTTP header's"}
    if hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
        return row | {"error": "the payload's digest is not the header's"}
    return row


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in column ``path``: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, error."""
    schema = _SCHEMA if with_payload else _SCHEMA.remove(_SCHEMA.get_field_index("payload"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows, size = [], 0
        for part in batches:
            for path in part.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for content, error in frames(stream):
                        row = parsed(content or b"")
                        rows.append(row | {"error": error} if error else row)
                        size += 300 + len(row["payload"] or b"") * with_payload
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return paths.select("path").mapInArrow(read, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def round_trip(spark: SparkSession, pages: DataFrame, payload: str = "html", with_payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, one archive a task."""
    manifest = write_archives(with_record_types(pages, payload=payload), new_path(spark, "warc"), trained_dictionary(pages, payload))
    return read_archives(manifest.repartition(max(1, min(10_000, manifest.count()))), with_payload)
