"""Files that tasks write to and read from the shared folder by byte ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of one file that lie closer than GAP are read at once, up to SPAN bytes.
GAP = 1 << 16
SPAN = 8 << 20
#: One task reads about this much at most.
STRIPE = 64 << 20


class Archive:
    """An append-only file of the shared folder that starts anew beyond `most` bytes.

    Names are unique to the attempt: what a lost or repeated attempt wrote is in no index and is ignored.
    """

    def __init__(self, folder: str, suffix: str, most: int, tail: bytes = b""):
        self.folder, self.suffix, self.most, self.tail = folder, suffix, most, tail
        self.out, self.name, self.at = None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        """Writes data; the file's name and the offset it got."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            system, path = fs.FileSystem.from_uri(self.folder)
            system.create_dir(path, recursive=True)
            self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        offset = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.tail)
            self.out.close()
            self.out = None


def striped(index: DataFrame, stripe: int | None = None) -> DataFrame:
    """The index dealt out by stripes of the files, in offset order inside each task.

    The number of tasks comes from the bytes that the (stored) index refers to: adaptive execution would go by the
    index's own size, and leave whole archives to a few tasks. A stripe has STRIPE bytes, or less where that would
    leave cores without work."""
    there = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if stripe is None:
        stripe = max(1 << 20, min(STRIPE, there // (4 * index.sparkSession.sparkContext.defaultParallelism)))
    rows = index.selectExpr("*", f"offset div {stripe} as stripe")
    return rows.repartition(max(1, -(-there // stripe)), "file", "stripe").sortWithinPartitions("file", "offset").drop("stripe")


def read_ranges(folder: str, rows: Iterable[dict], start: str = "offset", length: str = "length", gap: int = GAP) -> Iterator[tuple[dict, bytes]]:
    """Each row with its bytes; ranges of sorted rows that lie closer than `gap` are coalesced into one read."""
    system, path = fs.FileSystem.from_uri(folder)
    opened, name = None, None
    held: list[dict] = []

    def flush() -> Iterator[tuple[dict, bytes]]:
        nonlocal opened, name
        if not held:
            return
        if held[0]["file"] != name:
            if opened is not None:
                opened.close()
            name = held[0]["file"]
            opened = system.open_input_file(f"{path}/{name}")
        first = held[0][start]
        data = opened.read_at(max(r[start] + r[length] for r in held) - first, first)
        for r in held:
            yield r, data[r[start] - first : r[start] - first + r[length]]
        held.clear()

    for row in rows:
        if held and (row["file"] != held[0]["file"] or row[start] > held[-1][start] + held[-1][length] + gap or row[start] + row[length] - held[0][start] > SPAN):
            yield from flush()
        held.append(row)
    yield from flush()
    if opened is not None:
        opened.close()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, by number and by the size of their strings and bytes."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
