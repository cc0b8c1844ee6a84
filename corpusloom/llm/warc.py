"""WARC archives written and read by tasks, index first.

Writing: each task appends gzip members, one a record, to archives in the shared folder and returns one index
row per record (file, offset, length, page_id, url, digest, type), which Spark commits as a table. Reading:
the index rows that are wanted are sorted by file and offset, and neighbouring records are fetched by one
range read.

Of pages with equal payloads (by SHA-1 and size) of at least `min_revisit` bytes, that with the smallest
page_id is a response and the others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url gives a record without a target; line breaks in a
url are percent-encoded; rows that share the smallest page_id of a group are all responses; a null page_id
comes after all others; pages below the size are all responses; repeated rows and other ties give records of their
own; a very long page is one record in memory; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blobs import Archive, in_batches, read_ranges, rows_of, striped
from corpusloom.llm.common import cut, fresh_dir, joined_small, stored, table

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 1 << 30


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str, date: str = DATE) -> bytes:
    """A WARC/1.1 record with its HTTP block; a revisit has no payload."""
    name = lambda i: f"<{PAGE}{'' if i is None else i}>"
    body = b"" if kind == "revisit" else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii") + body
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + digest32(payload))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Type, page, url, digest, refers_to and payload (None for a revisit) of one record.

    A response's payload must agree with its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
    if payload is not None and digest32(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    page = lambda v: int(v) if (v := v.strip("<>").removeprefix(PAGE)) else None
    refers = fields.get("warc-refers-to")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "refers_to": page(refers) if refers else None, "payload": payload}


def _decided(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, refers_to, record_type. Only groups of several pages are joined back."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    groups = rows.filter(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1").drop("n"))
    rows = joined_small(rows, groups, ["sha", "size"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("record_type"))


def write_warc(pages: DataFrame, folder: str, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives into the folder; the index: file, offset, length, page_id, url, digest, record_type."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, ".warc.gz", archive_bytes)

        def rows() -> Iterator[dict]:
            for r in rows_of(batches):
                payload = r["html"].encode("utf-8", "surrogatepass")
                member = gzip.compress(record(r["page_id"], r["url"], payload, r["refers_to"], r["record_type"]), 6, mtime=0)
                name, offset = archive.append(member)
                yield {"file": name, "offset": offset, "length": len(member), "page_id": r["page_id"], "url": r["url"], "digest": digest32(payload), "record_type": r["record_type"]}

        yield from in_batches(rows(), schema)
        archive.close()

    return stored(_decided(pages, min_revisit).mapInArrow(write, "file string, offset long, length long, page_id long, url string, digest string, record_type string"), "warc-index")


def read_warc(index: DataFrame, folder: str, html: bool = True) -> DataFrame:
    """The records of the index rows: page_id, url, record_type, payload_digest, refers_to, payload_bytes (null for
    revisits) and, if asked for, html."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    schema = pa.schema(fields + [("html", pa.string())] * html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, data in read_ranges(folder, rows_of(batches)):
                found = parsed(gzip.decompress(data))
                payload = found.pop("payload")
                found["payload_bytes"] = None if payload is None else len(payload)
                if html:
                    found["html"] = None if payload is None else payload.decode("utf-8", "surrogatepass")
                yield found

        yield from in_batches(rows(), schema)

    ddl = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long" + ", html string" * html
    return striped(index.select("file", "offset", "length")).mapInArrow(read, ddl)


def resolved(records: DataFrame) -> DataFrame:
    """The records with a revisit's payload size (and html) taken from the response it refers to."""
    carried = [c for c in ("payload_bytes", "html") if c in records.columns]
    responses = records.filter("record_type = 'response'")
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sources = responses.join(wanted, ["page_id", "payload_digest"], "left_semi").dropDuplicates(["page_id", "payload_digest"])
    sources = sources.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), *(F.col(c).alias(f"__{c}") for c in carried))
    # checkpointed, so that the revisits of one very common page can be split
    joined = joined_small(records, cut(sources), (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in carried else F.col(c) for c in records.columns))


def warc_round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record, read back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    index = write_warc(pages, folder, min_revisit)
    records = stored(read_warc(index, folder, html=False), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))
