"""Version comparison by digests: the same rows as comparing everything, and equal buckets stay shut."""

import shutil
from pathlib import Path

import pytest

from corpusloom.operators import changes, search, versions

SCHEMA = "urn string, text_length long, article_count int, title string"


def acts(n=400):
    return [(f"u{i}" if i else None, i % 50 if i % 7 else None, i % 9, f"t{i}") for i in range(n)] + [("u5", 1, 1, "twice")]


def keys(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_versions_differ_nowhere(spark, tmp_path):
    """Another order, other files and repeated rows: the digests are those of the rows."""
    one = versions.store_version(spark.createDataFrame(acts(), SCHEMA).repartition(5), str(tmp_path / "a"), buckets=8)
    two = versions.store_version(spark.createDataFrame(acts()[::-1], SCHEMA).coalesce(1), str(tmp_path / "b"), buckets=8)
    assert versions.differing(one, two) == []
    assert keys(versions.new_or_changed(two, one)) == keys(versions.removed(two, one)) == []
    third = versions.store_version(spark.createDataFrame([*acts(), acts()[9]], SCHEMA), str(tmp_path / "c"), buckets=8)
    assert len(versions.differing(one, third)) == 1


def test_nulls_are_values(spark, tmp_path):
    """A null that moves from one column to the next changes the digest."""
    schema = "urn string, x string, y string"
    one = versions.store_version(spark.createDataFrame([("a", None, "v")], schema), str(tmp_path / "a"), buckets=2)
    two = versions.store_version(spark.createDataFrame([("a", "v", None)], schema), str(tmp_path / "b"), buckets=2)
    assert len(versions.differing(one, two)) == 1


def test_only_differing_buckets_are_opened(spark, tmp_path):
    rows = acts()
    new = [(u, (n or 0) + 1, a, t) if u in ("u17", "u230") else (u, n, a, t) for u, n, a, t in rows if u != "u99"] + [("brand new", 1, 1, "t")]
    frames = [spark.createDataFrame(r, SCHEMA) for r in (rows, new)]
    old, cur = (versions.store_version(f, str(tmp_path / str(i)), buckets=64) for i, f in enumerate(frames))
    here = versions.differing(old, cur)
    assert 0 < len(here) <= 4
    for folder in [*Path(tmp_path).glob("0/rows/bucket=*"), *Path(tmp_path).glob("1/rows/bucket=*")]:
        if int(folder.name.removeprefix("bucket=")) not in here:
            shutil.rmtree(folder)
    assert {r["urn"] for r in versions.new_or_changed(cur, old).collect()} - {"u5", None} == {r["urn"] for r in changes.new_or_changed(frames[1], frames[0]).collect()} - {"u5", None} == {"u17", "u230", "brand new"}
    assert [r["urn"] for r in versions.removed(cur, old).collect()] == ["u99"]


def test_shapes_must_agree(spark, tmp_path):
    df = spark.createDataFrame(acts(), SCHEMA)
    one, two = versions.store_version(df, str(tmp_path / "a"), buckets=2), versions.store_version(df, str(tmp_path / "b"))
    assert two.buckets == 1
    with pytest.raises(ValueError):
        versions.differing(one, two)


def test_earliest_change_is_recorded(spark):
    rows = [(i % 3, "c", "a", "b", 100 - i) for i in range(30)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id int, collection string, old_etag string, new_etag string, detected_at int").repartition(parts)
        assert [tuple(r) for r in changes.record_changes(df.limit(0), df).collect()] == [(2, "c", "a", "b", 71)]


def test_long_snippets(spark):
    """The window of a very long text is found from its matches, not from all its words."""
    import time

    text = " ".join("needle" if i in (70_000, 70_010, 70_015, 30_000) else f"w{i}" for i in range(100_000))
    hits = spark.createDataFrame([("u", text), ("v", "no match here"), ("w", None)], "urn string, text string")
    search.snippet(hits.limit(1), ["w5"]).collect()
    began = time.monotonic()
    found = {r["urn"]: r["snippet"] for r in search.snippet(hits, ["needle"]).collect()}
    assert time.monotonic() - began < 10
    assert found["u"].count("<b>needle</b>") == 3 and found["u"].startswith("...w69976 ") and found["v"] == "no match here" and found["w"] == ""
