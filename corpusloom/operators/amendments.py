"""Amendments, chains and activity over time. `now` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx


def upsert_amendments(base: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (urn, amending_urn, action): the last by (new after base, order)."""
    rows = base.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("urn", "amending_urn", "action").orderBy(F.desc("__new"), F.desc(order))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def _titles(laws: DataFrame, key: str, name: str) -> DataFrame:
    return laws.select(F.col("urn").alias(key), F.col("title").alias(name))


def timeline(am: DataFrame, laws: DataFrame, urn: str, descending: bool = False) -> DataFrame:
    """Amendments of an act by effective date, with the amending act's title."""
    rows = am.filter(F.col("urn") == urn).join(_titles(laws, "amending_urn", "amending_title"), "amending_urn", "left")
    date = F.desc_nulls_last("date_effective") if descending else F.asc_nulls_last("date_effective")
    return rows.select("date_effective", "amending_urn", "action", "amending_title", "seq").orderBy(date, "amending_urn", "action", "seq")


def most_amended(am: DataFrame, laws: DataFrame, k: int = 30) -> DataFrame:
    """Acts by number of amendments, with the first and last date."""
    rows = am.groupBy("urn").agg(F.count("*").alias("amendments"), F.min("date_effective").alias("first_date"), F.max("date_effective").alias("last_date"))
    return rows.join(laws.select("urn", "title"), "urn").orderBy(F.desc("amendments"), "urn").limit(k)


def since(column: str, now: dt.datetime, **span: int) -> Column:
    return F.col(column) >= F.lit(now - dt.timedelta(**span))


def recent_amendments(am: DataFrame, laws: DataFrame, now: dt.datetime, days: int = 30, k: int = 50) -> DataFrame:
    """Amendments detected in the last days, newest first, with both titles."""
    rows = am.filter(since("detected_at", now, days=days)).orderBy(F.desc("detected_at"), "seq").limit(k)
    rows = rows.join(_titles(laws, "urn", "title"), "urn", "left").join(_titles(laws, "amending_urn", "amending_title"), "amending_urn", "left")
    return rows.select("seq", "urn", "title", "amending_urn", "amending_title", "action", "detected_at")


def recent_log(log: DataFrame, now: dt.datetime, hours: int = 24, column: str = "detected_at") -> DataFrame:
    """Log entries of the last hours."""
    return log.filter(since(column, now, hours=hours))


def modified_ids(one: Column, many: Column) -> Column:
    """The modified ids as an array, given as one string or as a list."""
    return F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def amendment_chains(laws: DataFrame, modifies: str = "modifies") -> DataFrame:
    """original and its amenders, an array of struct (date, law_id, type, title) by date (undated first) and id."""
    each = laws.select(F.explode(modifies).alias("original"), F.struct("date", F.col("urn").alias("law_id"), "type", "title").alias("by"))
    return each.groupBy("original").agg(F.sort_array(F.collect_list("by")).alias("chain"))


def amendment_parts(laws: DataFrame, modifies: str = "modifies", part: int = 1000) -> DataFrame:
    """original, part (from 0) and chain: amendment_chains with at most `part` amenders a row, for acts with very many.

    Places come from two levels, inside a year and over the years' counts, so the amenders of one act are sorted in
    many tasks."""
    each = laws.select(F.explode(modifies).alias("original"), F.struct("date", F.col("urn").alias("law_id"), "type", "title").alias("by"))
    each = each.withColumn("year", F.coalesce(F.left("by.date", F.lit(4)), F.lit("")))
    inside = Window.partitionBy("original", "year").orderBy("by")
    earlier = Window.partitionBy("original").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = each.groupBy("original", "year").agg(F.count("*").alias("n")).select("original", "year", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = each.withColumn("within", F.row_number().over(inside) - 1).join(years, ["original", "year"])
    placed = placed.withColumn("part", F.expr(f"(before + within) div {part}"))
    return placed.groupBy("original", "part").agg(F.sort_array(F.collect_list("by")).alias("chain"))


def with_amendments(laws: DataFrame, modifies: str = "modifies") -> DataFrame:
    """Acts with the chain of their amenders; empty where there is none."""
    chains = amendment_chains(laws, modifies)
    empty = F.array().cast(chains.schema["chain"].dataType)
    return laws.join(chains.withColumnRenamed("original", "urn"), "urn", "left").withColumn("chain", F.coalesce("chain", empty))


def chain_stats(chains: DataFrame) -> DataFrame:
    """Acts amended, amendments, mean length of a chain."""
    return chains.agg(F.count("*").alias("acts_amended"), F.coalesce(F.sum(F.size("chain")), F.lit(0)).alias("amendments"), F.round(F.avg(F.size("chain")), 6).alias("mean_length"))


def validity(laws: DataFrame, valid_from: str, valid_to: str, published: str, current: str) -> DataFrame:
    """urn, valid_from, valid_to, published_date, is_current (false where unknown)."""
    date = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return laws.select("urn", date(valid_from).alias("valid_from"), date(valid_to).alias("valid_to"), date(published).alias("published_date"), F.coalesce(current, F.lit(False)).alias("is_current"))


def amendment_stats(laws: DataFrame, chain: str = "chain", modifies: str = "modifies") -> DataFrame:
    """Acts amended, acts that modify others, amendments in all, mean per amended act, most."""
    n = F.size(chain)
    return laws.agg(
        F.count_if(n > 0).alias("acts_amended"), F.count_if(F.size(modifies) > 0).alias("acts_modifying"), F.sum(n).alias("amendments"), F.round(F.avg(F.when(n > 0, n)), 6).alias("mean"), F.max(n).alias("most")
    )


def legislature_trends(laws: DataFrame) -> DataFrame:
    """Per term: years (sorted), acts, and the cabinet of the first year that has one."""
    rows = laws.filter("year is not null").select("year", fx.legislature(F.col("year")).alias("legislature"), fx.cabinet(F.col("year")).alias("government"))
    first = F.min(F.when(F.col("government").isNotNull(), F.struct("year", "government")))
    rows = rows.groupBy("legislature").agg(F.sort_array(F.collect_set("year")).alias("years"), F.count("*").alias("acts"), first.alias("first"))
    return rows.select("legislature", "years", "acts", F.col("first.government").alias("government"))


def by_legislature(laws: DataFrame) -> DataFrame:
    return laws.groupBy(fx.legislature(F.col("year")).alias("legislature")).agg(F.count("*").alias("acts"))
