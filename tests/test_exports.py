"""Sinks read back: graph with its stats, tracks in their order."""

from corpusloom.operators import graph
from corpusloom.sources import files


def test_graph_export(spark, tmp_path):
    laws = spark.createDataFrame([(f"u{i}", f"t{i}", "law", 1990) for i in range(6)], "urn string, title string, type string, year int")
    cit = spark.createDataFrame([("u0", "u1", 3), ("u2", "u1", 1), ("u1", "u2", 2), ("u3", "u2", 5), ("u4", "u5", 1), ("x", "u5", 1), ("u0", "gone", 9)], "citing_urn string, cited_urn string, cnt long")
    nodes = graph.graph_nodes(laws, cit, 2)
    files.export_graph(nodes, graph.graph_edges(nodes, cit), str(tmp_path / "g"), 2)
    found = [sorted(map(tuple, df.collect())) for df in files.read_graph(spark, str(tmp_path / "g"))]
    assert [r[0] for r in found[0]] == ["u1", "u2", "u5"]
    assert found[1] == [("u1", "u2", 2), ("u2", "u1", 1)] and found[2] == [(3, 2, 2)]


def test_tracks_are_written_in_order(spark, tmp_path):
    rows = [(f"u{i:03d}", None if i % 13 == 0 else 1900 + i * 37 % 120, "vigente" if i % 3 else "abrogated") for i in range(200)]
    separated = spark.createDataFrame(rows, "urn string, year int, track string").repartition(5)
    files.write_tracks(separated, str(tmp_path / "t"))
    for track in ("vigente", "abrogated"):
        want = sorted(((str(y or ""), u) for u, y, t in rows if t == track), reverse=True)
        found = files.read_track(spark, str(tmp_path / "t"), track, "urn string, year int").orderBy("place").collect()
        assert [(str(r["year"] or ""), r["urn"]) for r in found] == want and [r["place"] for r in found] == list(range(len(want)))
