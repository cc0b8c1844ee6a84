"""Change streams with keyed state: right for rows in any order within a delay.

A row is held in its key's list state until the watermark has passed its event time; an event-time timer then takes the
key's rows up to the watermark in order, compares each with the value state (the key's last value) and emits the
transitions. State is one value a key and the rows of the delay; batches of any size and order give the same changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "key string, `from` string, `to` string, seq long, ts timestamp, is_new boolean"
HELD = "value string, seq long, at long"
#: Rows that are sent to the state together.
SOME = 10_000


def transitions(tags: bool) -> StatefulProcessor:
    """The processor of one key's rows. With `tags` a first value is a change, too.

    Its class is made here, so that it travels by value: the driver's Python process that prepares the state does not
    have the session's files."""
    from array import array
    from itertools import islice

    import numpy as np

    some = SOME

    class Transitions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "value string")
            self.early = handle.getListState("early", HELD)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            first, rows = None, iter(rows)
            while held := [(r.value, r.seq, r.at) for r in islice(rows, some)]:
                self.early.appendList(held)
                least = min(h[2] for h in held)
                first = least if first is None else min(first, least)
            if first is not None:
                self.handle.registerTimer(first // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
            # rows that are due are held as numbers: their times, seqs and the places of their values
            at, seq, value, place, rest = array("q"), array("q"), array("q"), {}, []
            none = array("b")
            for v, s, t in self.early.get() if self.early.exists() else ():
                if t <= passed:
                    at.append(t)
                    seq.append(s or 0)
                    none.append(s is None)
                    value.append(place.setdefault(v, len(place)))
                else:
                    rest.append((v, s, t))
            if rest:
                self.early.put(rest[:some])
                for begin in range(some, len(rest), some):
                    self.early.appendList(rest[begin : begin + some])
                self.handle.registerTimer(min(h[2] for h in rest) // 1000)
            else:
                self.early.clear()
            if not at:
                return iter(())
            known = self.last.get()[0] if self.last.exists() else None
            values = list(place)
            rank = np.empty(len(values), np.int64)
            rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
            at, seq, none, value = (np.array(x) for x in (at, seq, none, value))
            order = np.lexsort((rank[value], seq, 1 - none, at))
            at, seq, none, value = at[order], seq[order], none[order], value[order]
            before = np.concatenate([[place.get(known, -1)], value[:-1]])
            if values[value[-1]] != known:
                self.last.update((values[value[-1]],))

            def found() -> Iterator[Row]:
                for i in np.flatnonzero(value != before).tolist():
                    was = known if i == 0 else values[before[i]]
                    if tags or was is not None:
                        yield Row(key=key[0], was=was, to=values[value[i]], seq=None if none[i] else int(seq[i]), at=int(at[i]), is_new=was is None)

            return found()

        def close(self) -> None:
            pass

    return Transitions()


def changes(stream: DataFrame, late: str = "2 hours", tags: bool = False) -> DataFrame:
    """key, from, to, seq, ts, is_new: changes of each key's value in a stream of (key, value, seq, ts).

    Rows later than the watermark (the latest ts less `late`) are dropped, and rows after it wait. Rows without a ts
    take no part. With `tags` null values are passed over and a key's first value is new; else null counts as empty
    and a first value is no change. Rows of one ts are taken by seq (null first), then value."""
    rows = stream.filter("ts is not null").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.filter("value is not null") if tags else rows.withColumn("value", F.coalesce("value", F.lit("")))
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    found = rows.groupBy("key").transformWithState(transitions(tags), "key string, was string, to string, seq long, at long, is_new boolean", "Append", "EventTime")
    return found.select("key", F.col("was").alias("from"), "to", "seq", F.timestamp_micros("at").alias("ts"), "is_new")


def run(found: DataFrame, path: str, checkpoint: str):
    """Appends the changes to a table until the stream's present files are done; the next run goes on from there."""
    spark: SparkSession = found.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state needs it; a query keeps the provider it starts with
    try:
        query = found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(PROVIDER, before)


def seen(spark: SparkSession, path: str) -> DataFrame:
    """All changes that were emitted."""
    return spark.read.schema(CHANGES).parquet(path)
