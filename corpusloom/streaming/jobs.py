"""Structured Streaming jobs. Each has a batch twin on the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.changes import dedupe_last, merge_with_log
from corpusloom.sources.tables import checkpointed


@dataclass
class Versions:
    """A table that grows by micro-batches, in buckets by a key's hash: a batch rewrites only the buckets it touches.

    Bucket b of batch v lies in v=<v>/bucket=<b>, and the manifest names each batch's buckets. A repeated batch overwrites
    what it wrote before, and readers of an earlier batch are not disturbed."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 16

    def bucket(self):
        hashed = F.pmod(F.crc32(F.encode(F.col(self.key).cast("string"), "UTF-8")), F.lit(self.buckets)).cast("int")
        return F.coalesce(hashed, F.lit(0))  # a null key lies in the first

    def _paths(self, before: int | None, touched: DataFrame | None) -> list[str]:
        try:
            rows = self.spark.read.schema("batch long, bucket int").json(f"{self.path}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # no batch yet
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        rows = rows if touched is None else rows.join(F.broadcast(touched.select(self.bucket().alias("bucket")).distinct()), "bucket", "left_semi")
        # at most `buckets` rows
        return [f"{self.path}/v={r['batch']}/bucket={r['bucket']}" for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]

    def read(self, schema, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The latest rows (before a batch; in the buckets of some keys)."""
        paths = self._paths(before, touched)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """The whole rows of the buckets that a batch touches."""
        keyed = rows.withColumn("bucket", self.bucket())
        keyed.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={batch}")
        there = keyed.select(F.lit(batch).cast("long").alias("batch"), "bucket").distinct()
        there.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={batch}")


def ingest(new_files: DataFrame, base_path: str, log_path: str, checkpoint: str, buckets: int = 16):
    """Incremental ingest: each batch of new rows (urn, ...) is merged into the base (see ingested) and logged.

    Only the base's buckets with urns of the batch are read and written. Runs until the new files are done; finished
    files are skipped on the next run."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        base = Versions(batch.sparkSession, base_path, "urn", buckets)
        delta = checkpointed(dedupe_last(batch, tuple(c for c in ("ts", "text_length") if c in batch.columns) or ("urn",)))
        merged, log = merge_with_log(base.read(batch.schema, before=batch_id, touched=delta), delta)
        base.write(merged, batch_id)
        log.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return new_files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, base_path: str, schema, buckets: int = 16) -> DataFrame:
    """The base after the last batch."""
    return Versions(spark, base_path, "urn", buckets).read(schema)


def append_new(new_files: DataFrame, out: str, checkpoint: str):
    """Appends the rows of files that no earlier run has finished, and stops."""
    return new_files.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Sequence numbers of one window of a key: a key of a third of all rows is many windows.
SPAN = 100_000
CHANGES = "key string, `from` string, `to` string, seq long, is_new boolean"


def _changes(rows: DataFrame, before: DataFrame | None, tags: bool, span: int) -> DataFrame:
    """Changes (key, from, to, seq, is_new) in rows of (key, value, seq), after the keys' values `before` (key, value).

    A key's rows are dealt into ranges of `span` sequence numbers. Inside a range each row looks at the one before it,
    and a range's first row at the last value of the range before, of which there is one row a range. With `tags`,
    nulls are passed over and a key's first value is new; else null counts as empty and a first value is no change."""
    rows = rows.select("key", "value", F.col("seq").cast("long").alias("seq"))
    rows = rows.filter("value is not null") if tags else rows.withColumn("value", F.coalesce("value", F.lit("")))
    rows = rows.withColumn("range", F.floor(F.col("seq") / span))
    here = Window.partitionBy("key", "range").orderBy("seq", "value")
    rows = rows.withColumn("from", F.lag("value").over(here))
    lasts = rows.groupBy("key", "range").agg(F.max(F.struct("seq", "value")).alias("last"))
    carried = lasts.select(F.col("key").alias("k"), F.col("range").alias("r"), F.lag("last.value").over(Window.partitionBy("key").orderBy("range")).alias("carried"))
    if before is not None:
        carried = carried.join(before.select(F.col("key").alias("b"), F.col("value").alias("held")), F.col("k").eqNullSafe(F.col("b")), "left")
        carried = carried.select("k", "r", F.coalesce("carried", "held").alias("carried"))
    rows = rows.join(carried, F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")), "left")
    # values are never null here, so a null is a range's first row
    rows = rows.withColumn("from", F.coalesce("from", "carried"))
    changed = F.col("from") != F.col("value")
    return rows.filter(F.col("from").isNull() | changed if tags else changed).select("key", "from", F.col("value").alias("to"), "seq", F.col("from").isNull().alias("is_new"))


def _watch(stream: DataFrame, path: str, checkpoint: str, tags: bool, span: int):
    def step(batch: DataFrame, batch_id: int) -> None:
        held = Versions(batch.sparkSession, f"{path}/held", "key")
        rows = checkpointed(batch.select("key", "value", "seq"))
        before = checkpointed(held.read("key string, value string, seq long", before=batch_id, touched=rows))
        firsts = rows.groupBy(F.col("key").alias("k")).agg(F.min("seq").alias("first"))
        late = before.join(firsts, F.col("key").eqNullSafe(F.col("k"))).filter("first < seq").select("key", "first", "seq").first()
        if late:
            raise ValueError(f"batch {batch_id} has seq {late['first']} of {late['key']!r} after {late['seq']}: use keyed.changes for rows out of order")
        found = _changes(rows, before.select("key", "value"), tags, span)
        found.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        seen = rows.filter("value is not null") if tags else rows.withColumn("value", F.coalesce("value", F.lit("")))
        latest = before.unionByName(seen).groupBy("key").agg(F.max(F.struct("seq", "value")).alias("last")).select("key", "last.value", "last.seq")
        held.write(latest, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_changes(stream: DataFrame, path: str, checkpoint: str, span: int = SPAN):
    """Changes of each key's value in a stream of (key, value, seq), such as the statuses of acts, below path/changes.

    Batches must come in the order of seq of each key; one that does not is an error (keyed.changes takes any order within a
    delay). What is held between batches is one value a key, in buckets by key."""
    return _watch(stream, path, checkpoint, False, span)


def tag_changes(stream: DataFrame, path: str, checkpoint: str, span: int = SPAN):
    """New and changed version tags of collections in a stream of (key, value, seq), below path/changes."""
    return _watch(stream, path, checkpoint, True, span)


def seen_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes that the batches found."""
    return spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{path}/changes")


def value_changes_batch(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """The batch twin of value_changes."""
    return _changes(rows, None, False, span).drop("is_new")


def tag_changes_batch(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """The batch twin of tag_changes."""
    return _changes(rows, None, True, span)


def activity(stream: DataFrame, window: str = "1 day", late: str = "2 hours", by: str = "action") -> DataFrame:
    """Counts by event-time window and action; events later than the watermark are dropped."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return rows.groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
