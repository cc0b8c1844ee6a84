"""Properties that hold whatever the data."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import changes, graph, search
from corpusloom.sources import files
from corpusloom.streaming import jobs

SMALL = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ids = st.integers(0, 8).map(lambda i: f"u{i}")


@SMALL
@given(st.lists(st.tuples(ids, ids), min_size=1, max_size=20, unique=True))
def test_importance_has_a_floor(spark, edges):
    cit = spark.createDataFrame(edges, "citing_urn string, cited_urn string")
    laws = spark.createDataFrame([(f"u{i}",) for i in range(8)], "urn string")
    scores = graph.importance(laws, cit, iterations=3, cut_every=2).collect()
    n = len(scores)
    assert all(r["pagerank"] >= 0.15 / n - 1e-8 for r in scores)
    assert not scores or max(r["importance_score"] for r in scores) == 100


@SMALL
@given(st.lists(st.tuples(ids, st.integers(0, 3)), max_size=15))
def test_dedup_and_merge(spark, rows):
    df = spark.createDataFrame(rows, "urn string, n int")
    once = changes.dedupe_first(df, ("n",))
    assert sorted(map(tuple, changes.dedupe_first(once, ("n",)).collect())) == sorted(map(tuple, once.collect()))
    merged = changes.merge_latest(once, once.filter("false"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, once.collect()))


def slow_changes(rows, tags):
    last, out = {}, []
    for key, value, seq in sorted(rows, key=lambda r: r[2]):
        if tags and value is None:
            continue
        value = value or ""
        if (key in last and last[key] != value) or (tags and key not in last):
            out.append((key, last.get(key), value, seq))
        last[key] = value
    return sorted(out, key=repr)


def test_streams_equal_their_batches(spark, tmp_path):
    """Three batches, keys that go on in later ones, and windows smaller than a key."""
    rows = [(str(i % 3) if i % 7 else None, ["a", "b", None][(i * 7) % 5 % 3], i) for i in range(60)]
    schema = "key string, value string, seq long"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for tags, job, batch in ((False, jobs.value_changes, jobs.value_changes_batch), (True, jobs.tag_changes, jobs.tag_changes_batch)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        job(stream, str(tmp_path / f"out{tags}"), str(tmp_path / f"state{tags}"), span=4).awaitTermination()
        four = lambda df: sorted((tuple(r[c] for c in ("key", "from", "to", "seq")) for r in df.collect()), key=repr)
        want = slow_changes(rows, tags)
        assert four(jobs.seen_changes(spark, str(tmp_path / f"out{tags}"))) == want
        assert four(batch(spark.createDataFrame(rows, schema))) == four(batch(spark.createDataFrame(rows, schema), span=4)) == want


def test_ingest_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "urn string, ts long, status string"
    for n in range(3):
        some = [(f"u{i}", 10 * n, f"s{n}") for i in range(40) if n == 0 or i == n]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    base, log = str(tmp_path / "base"), str(tmp_path / "log")
    jobs.ingest(stream, base, log, str(tmp_path / "state"), buckets=8).awaitTermination()
    found = {r["urn"]: r["status"] for r in jobs.ingested(spark, base, schema, buckets=8).collect()}
    assert len(found) == 40 and sum(v == "s0" for v in found.values()) == 38
    assert [len(list((tmp_path / "base" / f"v={v}").glob("bucket=*"))) for v in range(3)] == [8, 1, 1]
    assert spark.read.parquet(f"{log}/batch=2").collect()[0]["action"] == "updated"


def test_large_zip_members_are_dealt_out(spark, tmp_path):
    entries = spark.createDataFrame([(f"{i}.xml", bytes([65 + i % 26]) * 5000 + str(i).encode()) for i in range(60)], "entry string, content binary").repartition(2)
    made = files.write_zips(entries, str(tmp_path / "zips"), most=300).collect()
    assert sum(r["entries"] for r in made) == 60 and len(made) > 2
    back = {r["entry"]: bytes(r["content"]) for r in files.read_zip_entries(spark, str(tmp_path / "zips")).collect()}
    assert back == {r["entry"]: bytes(r["content"]) for r in entries.collect()}


def test_adjacency_in_parts(spark):
    cit = spark.createDataFrame([(f"a{i}", "hub") for i in range(50)] + [("hub", "x"), ("hub", "x")], "citing_urn string, cited_urn string")
    found = graph.adjacency_parts(cit, part=10).collect()
    hub = [r for r in found if r["urn"] == "hub" and r["side"] == "incoming"]
    assert len(hub) > 2 and sorted(i for r in hub for i in r["ids"]) == sorted(f"a{i}" for i in range(50))
    assert [(r["side"], r["ids"]) for r in found if r["urn"] == "x"] == [("incoming", ["hub"])]


def test_search_index_and_cut(spark, tmp_path):
    laws = spark.createDataFrame([("a", "Perché no", "x", "uno due perche"), ("b", "t", "x", "due " * 30 + "raro"), ("c", None, None, None)], "urn string, title string, type string, text string")
    index = search.build_index(laws, str(tmp_path / "index"), buckets=3)
    for source in (index, laws):
        assert [r["urn"] for r in search.search(source, "raro").collect()] == ["b"]
        assert [r["urn"] for r in search.search(source, "perche").collect()] == ["a"]
        assert search.search(source, "perche raro").count() == 0 == search.search(source, "!").count()
        assert sorted(r["urn"] for r in search.ranked(source, "due").collect()) == ["a", "b"]
    assert search.search(laws, "raro", cut=20).count() == 0
    assert search.search(search.build_index(laws, str(tmp_path / "cut"), cut=20), "raro").count() == 0
    assert [(r["urn"], r["snippet"][-11:]) for r in search.search_snippets(index, "raro", width=5).collect()] == [("b", "<b>raro</b>")]
    a, b = (search.scores(s, "due").orderBy("urn").collect() for s in (index, laws))
    assert a == b


def test_activity_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=3 * i), "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, action string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = jobs.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, jobs.activity(df).collect()))
    assert sorted(map(tuple, spark.table("activity").collect())) == want


def test_empty_query_matches_nothing(spark):
    laws = spark.createDataFrame([("a", "t", "x", "text")], "urn string, title string, type string, text string")
    assert search.search(laws, " ! ").count() == 0
    assert search.search(laws, "text").select(F.col("urn")).collect()[0][0] == "a"
