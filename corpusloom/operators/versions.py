"""Versions of a table with digests, so that a comparison opens only what differs.

A version lies in buckets by a key's hash, and keeps for each bucket the number of rows and two order-free sums of row
hashes (128 bits together), made by the same aggregation in partial and final steps. Buckets of equal digests hold the
same rows, whatever their order or files, and are not opened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import changes

#: Rows of a bucket, about.
PER_BUCKET = 100_000
DIGESTS = "bucket int, n long, a decimal(38,0), b decimal(38,0)"


@dataclass
class Version:
    """A stored version: its rows with their bucket, the digests, and the number of buckets."""

    rows: DataFrame
    digests: DataFrame
    buckets: int
    key: str

    def opened(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other file is read."""
        return self.rows.filter(F.col("bucket").isin(buckets)).drop("bucket")


def _bucket(key: str, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"), F.lit(0))


def store_version(df: DataFrame, path: str, key: str = "urn", buckets: int | None = None) -> Version:
    """Stores a version below the path. Versions that are to be compared need one number of buckets: by default it
    follows the rows; give that of the version before."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(1, min(4096, -(-df.count() // PER_BUCKET)))
    dealt = df.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/rows")
    rows = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    # nulls are told from values: a row's hash skips them
    marked = [x for c in df.columns for x in (F.col(c), F.isnull(c))]
    halves = [F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(20,0)")).cast("decimal(38,0)").alias(seed) for seed in ("a", "b")]
    rows.groupBy("bucket").agg(F.count("*").alias("n"), *halves).write.parquet(f"{path}/digests")
    spark.createDataFrame([(buckets, key)], "buckets int, key string").write.json(f"{path}/shape")
    return open_version(spark, path, dealt.schema)


def open_version(spark: SparkSession, path: str, schema) -> Version:
    shape = spark.read.schema("buckets int, key string").json(f"{path}/shape").first()
    return Version(spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.schema(DIGESTS).parquet(f"{path}/digests"), shape["buckets"], shape["key"])


def differing(old: Version, new: Version) -> list[int]:
    """The buckets whose digests differ or that one version lacks: a number a bucket, at most."""
    if (old.buckets, old.key) != (new.buckets, new.key):
        raise ValueError("versions of different buckets cannot be compared by digests")
    one, two = (v.digests.select("bucket", F.struct("n", "a", "b").alias(name)) for v, name in ((old, "x"), (new, "y")))
    pairs = one.join(two, "bucket", "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    return sorted(r["bucket"] for r in pairs.select("bucket").collect())


def new_or_changed(new: Version, old: Version, columns: tuple[str, ...] = ("text_length", "article_count")) -> DataFrame:
    """changes.new_or_changed over the buckets that differ."""
    here = differing(old, new)
    return changes.new_or_changed(new.opened(here), old.opened(here), columns)


def removed(new: Version, old: Version) -> DataFrame:
    """Rows of the old version whose key the new one lacks, from the buckets that differ."""
    here = differing(old, new)
    return old.opened(here).join(new.opened(here).select(new.key), new.key, "left_anti")
