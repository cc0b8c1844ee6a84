"""Change streams with keyed state against their batch twins, whatever the order of files."""

import random
from datetime import datetime, timedelta

import pytest

from corpusloom.shipping import ship
from corpusloom.streaming import jobs, keyed

SCHEMA = "key string, value string, seq long, ts timestamp"
START = datetime(2024, 1, 1)


def events(n=240):
    """A third of all rows has one key; nulls among keys and values."""
    rng = random.Random(3)
    keys = ["hot", "hot", "a", "b", "c", None]
    return [(rng.choice(keys), rng.choice(["x", "y", "z", None]), i, START + timedelta(minutes=i, microseconds=rng.randrange(10**6))) for i in range(n)]



def streamed(spark, tmp_path, batches, late, tags):
    """One run a folder, so that batches come in the order given; the state goes on from run to run."""
    query = None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        query = keyed.run(keyed.changes(stream, late, tags), str(tmp_path / "out"), str(tmp_path / "state"))
    return keyed.seen(spark, str(tmp_path / "out")), query


def four(df):
    return sorted((tuple(r[c] for c in ("key", "from", "to", "seq")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tags", [False, True])
@pytest.mark.parametrize("order", ["reversed", "shuffled"])
def test_any_order_equals_the_batch(spark, tmp_path, order, tags):
    ship(spark)
    rows = events()
    mixed = rows[::-1] if order == "reversed" else random.Random(8).sample(rows, len(rows))
    closing = [("end", "v", 10**6, START + timedelta(days=9))]  # moves the watermark past all rows
    found, query = streamed(spark, tmp_path, [mixed[:100], mixed[100:180], mixed[180:], closing], "1 day", tags)
    batch = jobs.tag_changes_batch if tags else jobs.value_changes_batch
    want = four(batch(spark.createDataFrame(rows, SCHEMA)))
    assert [r for r in four(found) if r[0] != "end"] == want
    # what is left: a value a key, the closing row, and their timers
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12


def test_late_rows_are_dropped_and_early_ones_wait(spark, tmp_path):
    ship(spark)
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [("k", "a", 1, at(0)), ("k", "b", 3, at(20)), ("k", "c", 4, at(200))]
    late = [("k", "zz", 2, at(10)), ("k", "d", 5, at(190))]  # the first is before the watermark, 140 minutes
    found, _ = streamed(spark, tmp_path, [first, late, [("end", "v", 9, at(1000))]], "60 minutes", False)
    assert four(found) == [("k", "a", "b", 3), ("k", "b", "d", 5), ("k", "d", "c", 4)]


def test_batches_out_of_order_are_refused_without_state(spark, tmp_path):
    for seq in (2, 1):
        spark.createDataFrame([("k", str(seq), seq, START)], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        query = jobs.value_changes(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        if seq == 2:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="out of order"):
                query.awaitTermination()
