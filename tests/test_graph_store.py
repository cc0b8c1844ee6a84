"""The stored adjacency opens only the buckets it needs; a round of PageRank has one exchange."""

import random
import shutil
import zlib
from pathlib import Path

import pytest

from corpusloom.operators import adjacency, graph
from corpusloom.sources import tables


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    acts = [(f"u{i}", f"title {i}", "law", 1990 + i % 9, float(i % 17)) for i in range(300)]
    edges = {(f"u{rng.randrange(330)}", f"u{rng.randrange(330)}") for _ in range(2500)}
    edges |= {(f"u{i}", "u5") for i in range(0, 300, 2)} | {("u5", f"u{i}") for i in range(150)}  # a hub both ways
    laws = spark.createDataFrame(acts, "urn string, title string, type string, year int, importance_score double")
    cit = spark.createDataFrame([(a, b, 1 + len(a) % 3) for a, b in sorted(edges)] + [(None, "u1", 1), ("u1", None, 1)], "citing_urn string, cited_urn string, cnt long")
    return laws, cit


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_look_ups_equal_scans(spark, corpus, tmp_path):
    laws, cit = corpus
    store = adjacency.build_adjacency(laws, cit, str(tmp_path / "graph"), buckets=7)
    for urn in ("u5", "u17", "u320", "nothing"):
        known = cit.filter("citing_urn is not null and cited_urn is not null")
        assert rows(adjacency.outgoing(store, urn)) == rows(graph.outgoing(known, laws, urn))
        assert rows(adjacency.incoming(store, urn, 9)) == rows(graph.incoming(known, laws, urn, 9))
        assert rows(adjacency.related(store, urn)) == rows(graph.related(known, laws, urn))
        assert rows(adjacency.citing_by_importance(store, urn)) == rows(graph.citing_by_importance(known, laws, urn))
        for depth, most in ((1, 100), (2, 60), (3, 100)):
            assert rows(adjacency.neighborhood(store, urn, depth, most, 8)) == rows(graph.neighborhood(known, laws, urn, depth, most, 8))


def test_only_needed_buckets_are_read(spark, corpus, tmp_path):
    """With the files of all other buckets gone, the look-ups of an act still work."""
    laws, cit = corpus
    path = tmp_path / "graph"
    store = adjacency.build_adjacency(laws, cit, str(path), buckets=16)
    want = rows(adjacency.outgoing(store, "u17")), rows(adjacency.incoming(store, "u17")), rows(adjacency.citing_by_importance(store, "u17"))
    keep = f"bucket={zlib.crc32(b'u17') % 16}"
    for folder in [*Path(path).glob("out/bucket=*"), *Path(path).glob("in/bucket=*")]:
        if folder.name != keep:
            shutil.rmtree(folder)
    assert (rows(adjacency.outgoing(store, "u17")), rows(adjacency.incoming(store, "u17")), rows(adjacency.citing_by_importance(store, "u17"))) == want
    plan = store.cited_by(["u17"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(urn,u17)" in plan


def test_buckets_follow_the_edges(spark, corpus, tmp_path, monkeypatch):
    laws, cit = corpus
    monkeypatch.setattr(adjacency, "PER_BUCKET", 100)
    store = adjacency.build_adjacency(laws, cit, str(tmp_path / "graph"))
    assert store.buckets == cit.filter("citing_urn is not null and cited_urn is not null").count() // 100
    assert adjacency.open_adjacency(spark, str(tmp_path / "graph")).buckets == store.buckets
    empty = adjacency.build_adjacency(laws.limit(0), cit.limit(0), str(tmp_path / "empty"))
    assert rows(adjacency.outgoing(empty, "u1")) == rows(adjacency.neighborhood(empty, "u1", 2)) == []


def test_reachable_equals_a_search(spark, corpus):
    _, cit = corpus
    near = {}
    for a, b in ((r["citing_urn"], r["cited_urn"]) for r in cit.collect()):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, seen = {"u17"}, {"u17": 0}
    for depth in (1, 2):
        level = {b for a in level for b in near[a] if b is not None and b not in seen}
        seen |= dict.fromkeys(level, depth)
    assert {r["urn"]: r["depth"] for r in adjacency.reachable(cit.dropna(), "u17", 2).collect()} == seen


def slow_ranks(laws, cit, rounds=20):
    known = {r["urn"] for r in laws.collect()}
    edges = [(r[0], r[1]) for r in cit.collect()]
    nodes = {x for e in edges for x in e} & known
    out = {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in edges:
            if a in nodes and b in nodes:
                new[b] += 0.85 * rank[a] / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("hub", [10**6, 20])
def test_importance(spark, corpus, hub):
    laws, cit = corpus
    cit = cit.dropna()
    want = slow_ranks(laws, cit, 6)
    found = {r["urn"]: r["pagerank"] for r in graph.importance(laws, cit, 6, hub=hub).collect()}
    assert found.keys() == want.keys() and all(found[u] == pytest.approx(want[u], abs=2e-8) for u in want)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("corpusloom_")] == []


def test_one_exchange_a_round(spark, corpus, monkeypatch):
    laws, cit = corpus
    plans = []
    true = tables.checkpointed

    def noted(df):
        out = true(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(tables, "checkpointed", noted)
    graph.importance(laws, cit.dropna(), 4, cut_every=10)
    final = plans[-1].split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 4 and "BroadcastExchange" not in final


def test_empty_graph(spark, corpus):
    laws, cit = corpus
    assert graph.importance(laws, cit.limit(0)).count() == 0
