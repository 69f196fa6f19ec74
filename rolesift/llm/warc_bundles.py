"""WARC archives as seekable Zstandard bundles.

A task packs its records into frames of about ``FRAME_BYTES`` that decompress on
their own, writes them one after another to a bundle, and ends the bundle with the
seek table of the seekable format (a skippable frame of compressed and plain sizes).
The index maps each record to its bundle, frame and offset within the plain frame,
so one record costs the seek table and one frame. Bundles have unique names and
count only by the index of the task attempt that succeeded, so lost executors leave
orphans at worst. They lie in a shared folder.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes that with the
largest id is a response; the others are revisits of it, without the payload. Rows
that repeat that id are responses too, and so are rows without an id when all of
their group have none. A null payload counts as empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import table
from rolesift.session import broadcast_if_small, materialize, shared_folder

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
MIN_REVISIT = 1000
# fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, bundle string, frame int, at int, size int"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block ends with the HTTP header."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "urn:x-unknown" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: {digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's digest and length are those of the bytes read."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = block[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    number = lambda urn: None if urn is None or ":none>" in urn else int(urn[len("<urn:x-page:") : -1])
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":", 1)[1]).hex()
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"],
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame with the (compressed, plain) size of each frame."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(file, size: int) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the seek table at a bundle's end."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", file.read(8 * n))[::2]
    places, at = [], 0
    for length in sizes:
        places.append((at, length))
        at += length
    return places


def _writer(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = FileSystem.from_uri(folder)
        pack = zstandard.ZstdCompressor(level=3)
        out = name = None
        frames: list[tuple[int, int]] = []
        plain: list[bytes] = []
        waiting: list[tuple] = []
        held = done = 0

        def flush():
            nonlocal held, done
            data = pack.compress(b"".join(plain))
            out.write(data)
            frames.append((len(data), held))
            done += len(data)
            rows = [(i, name, len(frames) - 1, at, n) for i, at, n in waiting]
            plain.clear()
            waiting.clear()
            held = 0
            columns = zip(*rows)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            names = ("page_id", "bundle", "frame", "at", "size")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                page_id, text = page_id.as_py(), html.as_py()
                data = record(page_id, url.as_py(), (text or "").encode(), refers_to.as_py())
                waiting.append((page_id, held, len(data)))
                plain.append(data)
                held += len(data)
                if held >= FRAME_BYTES:
                    yield flush()
                if done >= BUNDLE_BYTES:
                    out.write(seek_table(frames))
                    out.close()
                    out, frames, done = None, [], 0
        if out is not None:
            if waiting:
                yield flush()
            out.write(seek_table(frames))
            out.close()

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): which response each revisit stands for.

    Only ids and digests of large payloads are grouped, combined on the map side;
    payloads stay where they are unless repeated digests outgrow a broadcast.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    digests = pages.filter(large).select("page_id", F.sha1(data).alias("_digest"))
    repeated = (
        digests.groupBy("_digest").agg(F.max("page_id").alias("_keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    rows = pages.select("page_id", "url", "html", F.when(large, F.sha1(data)).alias("_digest"))
    joined = rows.join(broadcast_if_small(materialize(repeated)), "_digest", "left")
    return joined.select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep")).alias("refers_to")
    )


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write all records below ``folder`` (a URI every executor reaches) and return the index."""
    files, root = FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    return materialize(with_revisits(pages).mapInArrow(_writer(folder), _INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the indexed records back, frame by frame, and parse them."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        bundle = frame = file = None
        places: list[tuple[int, int]] = []
        plain = b""
        for batch in batches:
            found = []
            for name, number, at, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "size"))):
                if name != bundle:
                    if file is not None:
                        file.close()
                    file = files.open_input_file(f"{root}/{name}")
                    places = frame_places(file, file.size())
                    bundle, frame = name, None
                if number != frame:
                    offset, length = places[number]
                    file.seek(offset)
                    plain, frame = unpack.decompress(file.read(length)), number
                found.append(parse(plain[at : at + size]))
            yield pa.RecordBatch.from_pylist(found, schema=kind)
        if file is not None:
            file.close()

    kind = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    )
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    # a frame's records are read together; frames are many and about equal
    near = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return near.mapInArrow(read, schema)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    folder = f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/warc-{uuid.uuid4().hex}"
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).drop("url")


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN keep IS NOT NULL AND keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes >= 1000
"""

QUERIES = {"op3_warc_bundles": (op3_warc_bundles, _SQL)}
