"""Stores are narrow, follow their input, and are built from the tables as they are."""

import shutil

from corpusloom import catalog
from corpusloom.operators import adjacency, search


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stored_edges_are_ids_and_counts(spark, tmp_path):
    laws = spark.createDataFrame([("a", "title a", "law", 1990, 1.0), ("b", None, "law", 1991, 2.0)], "urn string, title string, type string, year int, importance_score double")
    cit = spark.createDataFrame([("a", "b", 2), ("a", "x", 3), ("b", "a", 1)], "citing_urn string, cited_urn string, cnt long")
    store = adjacency.build_adjacency(laws, cit, str(tmp_path / "graph"))
    assert sorted(store.out.columns) == sorted(store.into.columns) == ["bucket", "cnt", "other", "urn"]
    assert not (tmp_path / "graph" / "edges").exists()
    shown = store.shown(store.out, few=False)
    assert rows(shown.select("urn", "other", "known", "title", "year")) == [("a", "b", True, None, 1991), ("a", "x", False, None, None), ("b", "a", True, "title a", 1990)]
    assert rows(store.degrees.select("urn", "citations_in", "citations_out")) == [("a", 1, 2), ("b", 1, 1), ("x", 1, None)]


def test_look_ups_of_many_others(spark, tmp_path, monkeypatch):
    laws = spark.createDataFrame([(f"u{i}", f"t{i}", "law", 1990, float(i)) for i in range(40)], "urn string, title string, type string, year int, importance_score double")
    cit = spark.createDataFrame([("u0", f"u{i}", i) for i in range(1, 50)], "citing_urn string, cited_urn string, cnt long")
    store = adjacency.build_adjacency(laws, cit, str(tmp_path / "graph"), buckets=3)
    few = rows(adjacency.outgoing(store, "u0"))
    monkeypatch.setattr(adjacency, "LOOKUP", 5)
    assert rows(adjacency.outgoing(store, "u0")) == few and len(few) == 49


def test_postings_are_counted_in_place(spark, tmp_path, monkeypatch):
    data = [("a", "Perché no", "x", "uno due perche due"), ("b", None, None, None), ("c", "", "", " - "), ("d", "É é e", "x", "1 2 ½ 2")]
    laws = spark.createDataFrame(data, "urn string, title string, type string, text string")
    assert rows(search._counted(laws, None)) == rows(search.postings(laws).select("urn", "length", "term", "tf"))
    assert "Exchange" not in search._counted(laws, None)._jdf.queryExecution().executedPlan().toString()
    # of a urn that is there twice the rows count together, as in postings()
    doubled = search.build_index(laws.union(laws), str(tmp_path / "doubled"))
    assert rows(doubled.terms(["due"])) == [("a", 7, "due", 4)]
    monkeypatch.setattr(search, "PER_BUCKET", 2)
    monkeypatch.setattr(search, "LEAST", 1)
    assert search.build_index(laws, str(tmp_path / "index")).buckets == 2


def test_queries_see_the_tables_as_they_are(spark, tmp_path):
    """A second call after the tables changed does not answer from what the first one stored."""
    found = []
    for n, word in ((12, "der die thwhst"), (13, "der die thwhst der")):
        for name in ("documents", "lineitem"):
            shutil.rmtree(tmp_path / f"{name}.parquet", ignore_errors=True)
        texts = spark.range(n).selectExpr("id as doc_id", f"concat('{word} ', id) as text", "'de' as lang", "'s' as source", "cast(20 as bigint) as n_chars")
        texts.write.parquet(str(tmp_path / "documents.parquet"))
        spark.range(n * 9).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "'A' as l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
        spark.catalog.clearCache()
        found.append([len(rows(catalog.queries()[q](spark, str(tmp_path)))) for q in ("q02_search", "q04_by_trigrams", "g03_incoming")])
    assert found[0][:2] == [12, 12] and found[1][:2] == [13, 13]
