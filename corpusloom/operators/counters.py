"""Counters that are kept a batch at a time and merged when read.

Each batch leaves one small row a group: counts, sums, least and greatest values, and an HLL sketch for each column whose
distinct values are asked for. Reading adds and merges these rows; no batch is read again. Counts and sums are exact,
distinct counts estimates, whose relative error is about 1.04 / sqrt(2^lg_k): 0.8 % with the default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14


def batch_counters(batch: DataFrame, by: list[str], sums: list[str], distinct: list[str], lg_k: int = LG_K) -> DataFrame:
    """One row a group: by, n, and for each column its sum and number of values (sums), or a sketch (distinct)."""
    parts = [F.count("*").alias("n")]
    for c in sums:
        parts += [F.sum(F.col(c).cast("decimal(38,6)")).cast("decimal(38,6)").alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    parts += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"{c}_sketch") for c in distinct]
    return batch.groupBy(*by).agg(*parts)


def add_batch(batch: DataFrame, path: str, name: str, by: list[str], sums: list[str], distinct: list[str]) -> None:
    """Stores a batch's counters under its name; a repeated batch takes its own place."""
    batch_counters(batch, by, sums, distinct).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={name}")


def stored_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def merged(counters: DataFrame, by: list[str], sums: list[str], distinct: list[str]) -> DataFrame:
    """by, n, and for each column sum, mean, min, max, or about_distinct."""
    parts = [F.sum("n").alias("n")]
    for c in sums:
        mean = (F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0))).cast("double")
        parts += [F.sum(f"{c}_sum").cast("double").alias(f"{c}_sum"), mean.alias(f"{c}_mean"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
    parts += [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_about_distinct") for c in distinct]
    return counters.groupBy(*by).agg(*parts)
