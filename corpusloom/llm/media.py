"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A text's UTF-8 bytes, padded with blanks to a positive multiple of the row length, are the samples of an
8-bit greyscale PNG image; images are kept in tar shards of the shared folder under their SHA-256. A task
stores a payload once however often it meets it, and of copies that several tasks stored every row refers to
the first by (file, offset). Nothing but (digest, place) rows is shuffled: payloads never move between tasks.

Metadata columns (width, height, bit depth) come from range reads of the first HEADER bytes and of nothing else:
headers are only read together if they lie closer than HEADER_GAP. Features come from a second pass, which reads and
decodes each stored image once and holds it against its header's columns.

Defined cases: null and empty texts are one row of blanks; equal texts share one stored image; repeated rows and
other ties give repeated rows; a very long text is one image in memory; an empty table gives no shard; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blobs import Archive, read_ranges, striped
from corpusloom.llm.common import fresh_dir, stored, table, whole_text

ROW = 192
HEADER = 33  # signature and header chunk
HEADER_GAP = 256
#: Fixed value: the signature of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SHARD_BYTES = 1 << 30
SEEN = 50_000


def padded(data: bytes, row: int = ROW) -> bytes:
    return data + b" " * (-len(data) % row or (row if not data else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: bytes, row: int = ROW, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of rows of `row` samples, without filters."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, row)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", row, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("no PNG at this offset")
    return struct.unpack(">IIB", data[16:25])


def png_samples(data: bytes) -> bytes:
    """The samples of an image that png() made."""
    width, height, _ = png_header(data)
    at, body = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image is damaged")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples."""
    values = np.frombuffer(samples, np.uint8)
    bins = np.bincount(values >> 4, minlength=16)
    return f"{values.mean():.4f}:{values.std():.4f}:" + ",".join(map(str, bins.tolist()))


def store_media(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; one row per document: doc_id, n_bytes, digest (of the stored image), file, offset, length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text().alias("text"))
    names = ["doc_id", "n_bytes", "digest", "file", "offset", "length"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Archive(folder, ".tar", shard_bytes, tail=bytes(1024))
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            found = []
            for value in batch.column(1):
                data = value.as_py().encode("utf-8", "surrogatepass")
                key = hashlib.sha256(padded(data)).digest()
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    image = png(padded(data))
                    digest = hashlib.sha256(image).digest()
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    name, at = shard.append(head + image + bytes(-len(image) % 512))
                    seen[key] = (digest, name, at + len(head), len(image))
                found.append((len(data), *seen[key]))
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)
        shard.close()

    return stored(rows.mapInArrow(write, f"doc_id {kind}, n_bytes long, digest binary, file string, offset long, length long"), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """One place per digest: digest, file, offset, length."""
    first = F.min(F.struct("file", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(first).select("digest", "at.file", "at.offset", "at.length")


#: Columns of an image's header and of its content: name, Arrow type, SQL type.
HEADER_COLUMNS = [(n, pa.int32(), "int") for n in ("width", "height", "depth")]
CONTENT_COLUMNS = [("payload_bytes", pa.int64(), "long"), ("payload_sha", pa.binary(), "binary"), ("tail_crc32", pa.int64(), "long"), ("feature", pa.string(), "string")]


def _header(row: dict, data: bytes) -> dict:
    return dict(zip(("width", "height", "depth"), png_header(data), strict=True))


def _content(row: dict, data: bytes) -> dict:
    if hashlib.sha256(data).digest() != row["digest"]:
        raise ValueError(f"the stored image {row['digest'].hex()} is damaged")
    if png_header(data) != (row["width"], row["height"], row["depth"]):
        raise ValueError(f"the header of {row['digest'].hex()} is not the stored image's")
    samples = png_samples(data)
    return {"payload_bytes": len(samples), "payload_sha": hashlib.sha256(samples).digest(), "tail_crc32": zlib.crc32(samples[-16:]), "feature": feature(samples)}


def _read(index: DataFrame, folder: str, columns: list[tuple], *, whole: bool) -> DataFrame:
    """The index's rows with the columns that range reads of their images give: of headers only, or of the whole."""
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields] + [f"{n} {t}" for n, _, t in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*batch.schema, *(pa.field(n, t) for n, t, _ in columns)])
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000).to_pylist()
                if whole:
                    for row, data in read_ranges(folder, rows):
                        row.update(_content(row, data))
                else:
                    for row in rows:
                        row["__head"] = min(HEADER, row["length"])
                    for row, data in read_ranges(folder, rows, length="__head", gap=HEADER_GAP):
                        row.update(_header(row, data))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return striped(index).mapInArrow(read, ddl)


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """The (stored) index with width, height and depth, read from the first bytes of each image only."""
    return _read(index, folder, HEADER_COLUMNS, whole=False)


def media_features(index: DataFrame, folder: str) -> DataFrame:
    """The rows of header_columns() (stored) with what the images hold; one that disagrees with its digest or header is an
    error."""
    return _read(index, folder, CONTENT_COLUMNS, whole=True)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Every document with its stored image's columns, read back: all headers, then each image once, in the order of the shards."""
    folder = fresh_dir(docs.sparkSession, "media")
    rows = store_media(docs, folder)
    headed = stored(header_columns(stored(places(rows), "media-places"), folder), "media-headers")
    found = media_features(headed, folder).drop("file", "offset")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("digest").alias("media_sha256"), "feature", "width", "height", "depth"
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents"))
