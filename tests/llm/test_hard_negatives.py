"""Hard negatives against brute force: nulls, ties, repeated rows, uneven lengths, huge components, many blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn
from tests.llm.helpers import with_clashes

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(x):
    return math.floor(min(max(256 * x, -(2.0**62)), 2.0**62))


def brute(rows, every=100, positives=5, k=10, low=30, high=90):
    good = [(i, label, [whole(x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    by = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for at, (i, label, v) in enumerate(good):
        if i is None or i % every:
            continue
        score = lambda w, v=v: max(-hn.MOST, min(hn.MOST, sum(a * b for a, b in zip(v, w, strict=False))))
        near = sorted(((score(w), j) for b, (j, m, w) in enumerate(good) if b != at and m == label), key=by)[:positives]
        rest = sorted(((score(w), j) for j, m, w in good if m != label), key=by)
        for p, j in near:
            fits = [(s, n) for s, n in rest if low * p <= 100 * s <= high * p][:k]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return sorted(out, key=repr)


def found(spark, rows, parts=3, **options):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(parts)
    out = hn.hard_negatives(df, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


def vectors(n=420, seed=3, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(5, rows[7][1], 1), rows[100], rows[100], rows[33], (None, [0.7] * dims, 0), (None, [0.6] * dims, 2)]
    rows += [(1000, None, 1), (1100, [0.1] * dims, None), (1200, [0.1, None] + [0.1] * (dims - 2), 1), (1300, [float("nan")] * dims, 1), (1400, [float("inf")] * dims, 2)]
    rows += [(1500, [], 1), (1600, [0.9, 0.8], 2), (1601, [0.9] * (dims + 3), 2), (-100, [0.5] * dims, 1), (1700, [0.3] * dims, 77), (1800, [-0.5] * dims, 2)]
    return rows


def test_against_brute_force(spark):
    rows = vectors()
    assert found(spark, rows) == brute(rows)


def test_parameters(spark):
    rows = vectors(seed=8)
    options = {"every": 7, "positives": 3, "k": 4, "low": 0, "high": 100}
    assert found(spark, rows, 5, **options) == brute(rows, **options)
    with pytest.raises(ValueError):
        found(spark, rows, low=50, high=50)


def test_hot_label_and_copies(spark):
    """One label and one vector with a third of all rows: ties go by id."""
    rng = random.Random(1)
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [rng.random(), rng.random()], 0 if i % 3 == 0 else rng.randrange(4)) for i in range(600)]
    assert found(spark, rows, 7) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    """Blocks of few rows and anchors, and one anchor block held at a time: the same rows."""
    for name, value in (("ROWS", 64), ("ANCHORS", 8), ("TILE", 3), ("HELD", 1)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(hn.blocks, "__defaults__", (64,))
    rows = vectors(seed=11)
    assert found(spark, rows, 4, every=9) == brute(rows, every=9)


def test_shuffled_anchor_blocks(spark, monkeypatch):
    """Beyond the bound of a broadcast the anchor blocks are shuffled."""
    import functools

    monkeypatch.setattr(hn, "joined_small", functools.partial(hn.joined_small, most=0))
    rows = vectors(seed=12)
    assert found(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(100 * i, [s * 2.0**e, 1.0], i % 2) for i, (s, e) in enumerate([(1, 20), (1, 21), (-1, 30), (1, 40), (1, 300), (1, 1020), (1, 3), (1, 2), (1, 19), (1, 18)])]
    assert found(spark, rows) == brute(rows)


def test_products_are_exact():
    rng = np.random.default_rng(4)
    a, b = (np.floor(rng.normal(size=(5, 9)) * 2.0**25) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert hn.products(a, b, float(np.abs(a).max() * np.abs(b).max())).tolist() == want


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 0), (2, [0.5], 1)]) == []  # no anchor
    assert found(spark, [(100, [0.5], 0), (101, [0.5], 1)]) == []  # no positive


def test_query_is_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, hn.op13(spark, sf).collect()), key=repr) == brute(rows)
    assert dict(hn.op13(spark, sf).dtypes)["rank"] == "int"
    assert hn.op13(spark, sf).filter(F.col("rank") > 10).count() == 0
