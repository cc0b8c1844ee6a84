"""Joins by time: the state in force at a moment, and the period that holds a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, history: DataFrame, key: str, at: str, since: str, carry: list[str], span: int = 86_400 * 30) -> DataFrame:
    """Each row of `points` with the columns `carry` of the latest row of `history` with its key and since <= at.

    Both sides are laid on one line and the latest history row is carried forward: inside ranges of `span` seconds by
    a window over (key, range), and from range to range over one row each, so a key of a third of all rows is many
    windows. Where several rows of history share key and time the one that is greatest by the carried columns counts
    (nulls least). Points without a key or a time, and those before the first row, get nulls. Times are timestamps or
    dates."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    state = F.struct(*(F.col(c).alias(c) for c in carry))
    known = history.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("__key"), micros(since).alias("__at"), state.alias("__state"))
    known = known.groupBy("__key", "__at").agg(F.max("__state").alias("__state")).withColumn("__row", F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType))
    asked = points.select(F.col(key).alias("__key"), micros(at).alias("__at"), F.lit(None).cast(known.schema["__state"].dataType).alias("__state"), F.struct("*").alias("__row"))
    line = known.unionByName(asked.filter("__key is not null and __at is not null")).withColumn("__range", F.expr(f"__at div {span * 1_000_000}"))
    here = Window.partitionBy("__key", "__range").orderBy("__at", F.col("__row").isNotNull())
    line = line.withColumn("__found", F.last("__state", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    ends = line.groupBy("__key", "__range").agg(F.max_by("__state", F.when(F.col("__state").isNotNull(), F.col("__at"))).alias("end"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__key").alias("k"), F.col("__range").alias("r"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = line.filter("__row is not null").join(ends, (F.col("__key") == F.col("k")) & (F.col("__range") == F.col("r")))
    found = found.select("__row", F.coalesce("__found", "carried").alias("state"))
    without = asked.filter("__key is null or __at is null").select("__row", F.col("__state").alias("state"))
    return found.unionByName(without).select("__row.*", *(F.col(f"state.{c}").alias(c) for c in carry))


def state_at(history: DataFrame, key: str, since: str, at: Column, carry: list[str]) -> DataFrame:
    """The latest row of each key at one moment: key, since, carried columns; keys that begin later are left out.

    One aggregation with partial results, whatever the rows of a key."""
    latest = F.max(F.struct(F.col(since).alias(since), *(F.col(c).alias(c) for c in carry))).alias("s")
    return history.filter(F.col(since) <= at).groupBy(key).agg(latest).select(key, f"s.{since}", *(f"s.{c}" for c in carry))


def period_of(points: DataFrame, value: str, periods: DataFrame, width: int = 10) -> DataFrame:
    """Each row of `points` with `period`: the name of the first period, by `rank`, that holds its value.

    `periods` has name, first, after (the first value after it; null: open) and rank; they may overlap, and touch.
    Distinct values meet the periods in bins of `width` values, so a period joins the values near it only, and rows
    look their value's name up: a value of a third of all rows is one row in the search. Values without a period, and
    nulls, get null."""
    wanted = points.select(F.col(value).cast("long").alias("__v")).filter("__v is not null").distinct()
    bounds = wanted.agg(F.min("__v").alias("least"), F.max("__v").alias("most"))  # one row
    clipped = periods.select("name", F.col("first").cast("long").alias("first"), F.col("after").cast("long").alias("after"), "rank").join(F.broadcast(bounds))
    clipped = clipped.withColumn("lo", F.greatest("first", "least")).withColumn("hi", F.least(F.coalesce(F.col("after") - 1, "most"), "most")).filter("lo <= hi")
    bins = clipped.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hits = wanted.withColumn("bin", F.floor(F.col("__v") / width)).join(bins, "bin").filter("lo <= __v and __v <= hi")
    named = hits.groupBy("__v").agg(F.min_by("name", F.struct("rank", "name")).alias("period"))
    return points.join(named, F.col(value).cast("long") == F.col("__v"), "left").drop("__v")
