"""Counters merged from batches against counts over all rows."""

import random
import shutil
from pathlib import Path

from corpusloom.operators import counters

SCHEMA = "kind string, size double, user string"
SHAPE = (["kind"], ["size"], ["user"])


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), None if i % 9 == 0 else float(rng.randrange(100)), None if i % 7 == 0 else f"u{rng.randrange(3000)}") for i in range(n)]


def summary(spark, path):
    return {r["kind"]: r for r in counters.merged(counters.stored_counters(spark, path), *SHAPE).collect()}


def test_merged_equals_whole(spark, tmp_path):
    path, every = str(tmp_path / "c"), []
    for k in range(3):
        batch = rows(4000, k)
        every += batch
        counters.add_batch(spark.createDataFrame(batch, SCHEMA), path, str(k), *SHAPE)
        if k == 1:  # repeated batches count once
            counters.add_batch(spark.createDataFrame(batch, SCHEMA), path, "1", *SHAPE)
    found = summary(spark, path)
    for kind in ("a", "b", None):
        mine = [r for r in every if r[0] == kind]
        sizes, users = [r[1] for r in mine if r[1] is not None], {r[2] for r in mine if r[2]}
        got = found[kind]
        assert (got["n"], got["size_sum"], got["size_min"], got["size_max"]) == (len(mine), sum(sizes), min(sizes), max(sizes))
        assert abs(got["size_mean"] - sum(sizes) / len(sizes)) < 1e-4
        assert abs(got["user_about_distinct"] - len(users)) <= 0.03 * len(users)


def test_a_batch_is_added_without_the_others_rows(spark, tmp_path):
    """The input of earlier batches is gone when a new one is added; the counters go on."""
    source, path = tmp_path / "in", str(tmp_path / "c")
    for k in range(3):
        spark.createDataFrame(rows(100, k), SCHEMA).write.parquet(str(source / str(k)))
        counters.add_batch(spark.read.parquet(str(source / str(k))), path, str(k), *SHAPE)
        shutil.rmtree(Path(source) / str(k))
    assert sum(r["n"] for r in summary(spark, path).values()) == 300
    counters.add_batch(spark.createDataFrame([], SCHEMA), path, "none", *SHAPE)
    assert sum(r["n"] for r in summary(spark, path).values()) == 300
