"""As-of and interval joins against plain loops; one scan a citation query."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import intervals, mining

START = datetime(2024, 1, 1)


def test_as_of(spark):
    """A key with a third of all rows over many ranges, ties in time, nulls, points before the first state."""
    rng = random.Random(1)
    keys = ["hot", "hot", "hot", "a", "b", "c", None]
    when = lambda: START + timedelta(hours=rng.randrange(2000)) if rng.random() > 0.05 else None
    history = [(rng.choice(keys), when(), rng.choice(["x", "y", None]), i) for i in range(300)] + [("a", START, "p", 1), ("a", START, "q", 0)]
    points = [(rng.choice([*keys, "none"]), when(), i) for i in range(400)] + [("a", START, 1000), ("a", START - timedelta(days=1), 1001)]
    h = spark.createDataFrame(history, "key string, since timestamp, value string, n int")
    p = spark.createDataFrame(points, "key string, at timestamp, value int")
    want = []
    for key, at, i in points:
        held = [(since, (v is not None, v or "", n), v, n) for k, since, v, n in history if key is not None and k == key and since is not None and at is not None and since <= at]
        best = max(held, key=lambda x: x[:2]) if held else (None, None, None, None)
        want.append((key, at, i, best[2], best[3]))
    for span in (3600, 86_400 * 7, 86_400 * 3650):
        found = intervals.as_of(p.withColumnRenamed("value", "i"), h, "key", "at", "since", ["value", "n"], span)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert intervals.as_of(p.limit(0).drop("value"), h, "key", "at", "since", ["value"]).count() == 0
    assert intervals.as_of(p.drop("value"), h.limit(0), "key", "at", "since", ["value"]).filter("value is not null").count() == 0


def test_state_at(spark):
    rows = [("a", START + timedelta(days=d), str(d)) for d in range(9)] + [("b", START + timedelta(days=20), "later"), ("c", None, "never")]
    h = spark.createDataFrame(rows, "key string, since timestamp, value string")
    found = intervals.state_at(h, "key", "since", F.lit(START + timedelta(days=4, hours=5)), ["value"])
    assert [tuple(r) for r in found.collect()] == [("a", START + timedelta(days=4), "4")]


def test_period_of(spark):
    """Overlapping, touching, open and empty periods; the order of the list decides."""
    rng = random.Random(2)
    periods = [(f"p{i}", a, None if i % 9 == 0 else a + rng.randrange(0, 40), i) for i, a in enumerate(rng.randrange(-50, 300) for _ in range(40))]
    rng.shuffle(periods)
    points = [(i, None if i % 11 == 0 else 7 if i % 3 == 0 else rng.randrange(-80, 400)) for i in range(300)]
    want = []
    for i, v in points:
        held = sorted((rank, name) for name, a, b, rank in periods if v is not None and a <= v and (b is None or v < b))
        want.append((i, v, held[0][1] if held else None))
    table = spark.createDataFrame(periods, "name string, first int, after int, rank int")
    frame = spark.createDataFrame(points, "i int, v int")
    for width in (1, 10, 1000):
        assert sorted(map(tuple, intervals.period_of(frame, "v", table, width).collect()), key=repr) == sorted(want, key=repr)
    assert intervals.period_of(frame.limit(0), "v", table).count() == 0
    assert intervals.period_of(frame, "v", table.limit(0)).filter("period is null").count() == 300


def test_citations_take_one_scan(spark, tmp_path):
    laws = [("u1", "legge 12/1990", "art. 3 della legge 241/1990 e decreto 5/1999; legge 7 agosto 1990, n. 241"), ("u2", None, None), ("u3", "t", "L. n. 4 del 1950, d.lgs. 3/2001")]
    spark.createDataFrame(laws, "urn string, title string, text string").write.parquet(str(tmp_path / "laws"))
    df = spark.read.parquet(str(tmp_path / "laws"))
    for extract in (mining.extract_citations, mining.extract_typed_citations, mining.extract_raw_citations):
        out = extract(df)
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1 and out.count() > 0
