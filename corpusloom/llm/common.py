"""What the training-data operators share: tables, the shared folder, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shipping import ship
from corpusloom.sources.tables import discard, shared_dir

#: A word is a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to so many bytes.
BROADCAST = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_made: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], str]]:
    """Deletes the folders made inside it on leaving, but for those given to the yielded function.

    For work whose result is written inside: results are lazy, and read the folders of their operators."""
    begin, kept = len(_made), set()

    def keep(path: str) -> str:
        kept.add(path)
        return path

    try:
        yield keep
    finally:
        made = _made[begin:]
        del _made[begin:]
        for path in made:
            if path not in kept:
                discard(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint: they are computed once and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: smaller than a checkpoint for many rows."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """Join with a side that is usually small: broadcast if its bytes, which are counted first, are at most `most`.

    Else both sides are shuffled, and each partition of `right`, whose keys are unique, becomes a hash table, so the
    rows of `left` are not sorted. `right` must be cheap to count (checkpointed)."""
    varied = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in right.dtypes if kind in ("string", "binary")]
    counted = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(varied, F.lit(0))), F.lit(0)).alias("bytes")).first()
    small = counted["n"] * 16 * len(right.columns) + counted["bytes"] <= most
    return left.join(F.broadcast(right) if small else right.hint("shuffle_hash"), on, how)
