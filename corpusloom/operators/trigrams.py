"""Substring search by postings of three-character strings.

Every act that holds a string holds all of its trigrams. The store keeps blocks (trigram, batch of acts, their places in the
batch) in buckets by trigram, sorted, so a search opens the buckets of its own trigrams, and of these the row groups that
may hold them; acts that have all of them are candidates, which are looked up and read for the string itself. Strings of
one or two characters have no trigram: for them all acts are read.

A batch is some CHUNK characters of acts that one task reads together, so an exchange moves a row for each trigram of a
batch and two bytes a posting, not a row for each trigram of an act."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.shipping import ship
from corpusloom.sources.tables import discard

#: Postings of a bucket, about.
PER_BUCKET = 2_000_000
#: Characters and acts of a batch.
CHUNK, MOST = 2_000_000, 32_000
PAIRS = "gram string, batch string, at array<smallint>, urns array<string>"
POSTINGS = "gram string, batch string, at array<smallint>, bucket int"
BATCHES = "batch string, urns array<string>"


@dataclass
class Trigrams:
    """The stored acts, their postings and the batches that these name."""

    index: search.Acts
    postings: DataFrame
    batches: DataFrame
    buckets: int

    def candidates(self, low: str) -> DataFrame:
        """urn of the acts that have every trigram of a lower-case string of three characters or more."""
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        here = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
        rows = self.postings.filter(F.col("bucket").isin(here) & F.col("gram").isin(grams)).select("batch", F.explode("at").alias("at"))
        found = rows.groupBy("batch", "at").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        return found.join(self.batches, "batch").select(F.get("urns", F.col("at")).alias("urn"))


def _codes(pieces: list[tuple[int, str]]) -> np.ndarray:
    """Distinct (trigram's code, act's place) of pieces of text (place, text), as an array of two columns."""
    points = np.frombuffer("".join(text for _, text in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(text) for _, text in pieces])
    if len(points) < 3:
        return np.empty((0, 2), np.int64)
    places = np.repeat(np.array([at for at, _ in pieces], np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters to the piece's end
    begin = left[:-2] >= 3
    codes, which = np.unique((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[begin], return_inverse=True)
    both = np.unique(which * MOST + places[:-2][begin])
    return np.stack([codes[both // MOST], both % MOST], 1)


def _blocks(parts: list[np.ndarray], urns: list[str]) -> pa.RecordBatch:
    """A batch's rows: one for each trigram, and one with the urns of its acts."""
    rows = np.concatenate([*parts, np.empty((0, 2), np.int64)])
    if len(parts) > 1:
        rows = np.unique(rows, axis=0)
    codes, begins = np.unique(rows[:, 0], return_index=True)
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype(np.uint32)
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    n = len(codes)
    grams = pa.array([whole[i : i + 3] for i in range(0, 3 * n, 3)] + [None], pa.string())
    at = pa.ListArray.from_arrays(pa.array([*begins, len(rows), len(rows)], pa.int32()), pa.array(rows[:, 1].astype(np.int16)))
    named = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(urns)], pa.int32()), pa.array(urns, pa.string()))
    return pa.RecordBatch.from_arrays([grams, pa.array([uuid.uuid4().hex] * (n + 1), pa.string()), at, named], names=["gram", "batch", "at", "urns"])


def _batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS of acts (urn, title, text), both in lower case."""
    parts, pieces, urns, size = [], [], [], 0
    for frame in frames:
        for urn, title, text in zip(*(frame.column(c) for c in ("urn", "title", "text")), strict=True):
            at = len(urns)
            urns.append(urn.as_py())
            for field in (title.as_py(), text.as_py()):
                for begin in range(0, max(len(field) - 2, 0), CHUNK):  # pieces of a long text share two characters
                    piece = field[begin : begin + CHUNK + 2]
                    pieces.append((at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        parts.append(_codes(pieces))
                        pieces, size = [], 0
            if parts or len(urns) == MOST:
                yield _blocks([*parts, _codes(pieces)] if pieces else parts, urns)
                parts, pieces, urns, size = [], [], [], 0
    if urns:
        yield _blocks([_codes(pieces)], urns)


def build_trigrams(index: search.Acts, path: str, buckets: int | None = None) -> Trigrams:
    """Stores the trigrams of titles and texts. The number of buckets follows that of the postings."""
    spark = index.acts.sparkSession
    ship(spark)
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))).alias(c)
    index.acts.select("urn", low("title"), low("text")).mapInArrow(_batches, PAIRS).write.option("compression", "zstd").parquet(f"{path}/pairs")
    pairs = spark.read.schema(PAIRS).parquet(f"{path}/pairs")
    pairs.filter("gram is null").select("batch", "urns").write.parquet(f"{path}/batches")
    blocks = pairs.filter("gram is not null").select("gram", "batch", "at")
    buckets = buckets or max(1, min(4096, -(-(blocks.agg(F.sum(F.size("at"))).first()[0] or 0) // PER_BUCKET)))
    dealt = blocks.withColumn("bucket", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "gram", "batch").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(buckets,)], "buckets int").write.json(f"{path}/shape")
    discard(spark, f"{path}/pairs")
    return open_trigrams(spark, index, path)


def open_trigrams(spark: SparkSession, index: search.Acts, path: str) -> Trigrams:
    buckets = spark.read.schema("buckets int").json(f"{path}/shape").first()["buckets"]
    return Trigrams(index, spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(BATCHES).parquet(f"{path}/batches"), buckets)


def search_like(grams: Trigrams, query: str, k: int = 50) -> DataFrame:
    """search.search_like over the candidates: acts whose title or text holds the query, in any case, by importance."""
    low = query.lower()
    if len(low) < 3:
        return search.search_like(grams.index.acts, query, k)
    found = grams.candidates(low)
    some = [r["urn"] for r in found.limit(search.LOOKUP + 1).collect()]  # at most LOOKUP and one
    acts = grams.index.lookup(some) if len(some) <= search.LOOKUP else grams.index.acts.join(found, "urn", "left_semi")
    return search.search_like(acts, query, k)
