"""Substring search by trigrams: the rows of a scan, from the buckets of its own trigrams."""

import random
import shutil
import zlib
from pathlib import Path

from corpusloom.operators import search, trigrams


def acts(n=200):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 40)))
    rows = [(f"u{i}", word(), None if i % 17 == 0 else (word() + "\n") * 3, float(i % 23)) for i in range(n)]
    return rows + [("odd", "100% a_b Ö😀x", "", 1.0), ("empty", None, None, 2.0)]


def test_same_rows_as_a_scan(spark, tmp_path, monkeypatch):
    laws = spark.createDataFrame(acts(), "urn string, title string, text string, importance_score double").selectExpr("*", "'law' as type")
    index = search.build_index(laws, str(tmp_path / "index"), buckets=4)
    grams = trigrams.build_trigrams(index, str(tmp_path / "grams"), buckets=8)
    assert trigrams.open_trigrams(spark, index, str(tmp_path / "grams")).buckets == 8
    rows = laws.collect()
    for lookup in (1000, 1):
        monkeypatch.setattr(search, "LOOKUP", lookup)
        for query in ("abc", "ABCA", "é a", "a\nb", "% a_", "ö😀X", "zzz", "ab", "a", "aaaaaaaa", "e\n"):
            low = query.lower()
            held = [r for r in rows if low in (r["title"] or "").lower() or low in (r["text"] or "").lower()]
            want = [(r["urn"], r["title"], r["importance_score"]) for r in sorted(held, key=lambda r: (-r["importance_score"], r["urn"]))[:50]]
            assert [tuple(r) for r in trigrams.search_like(grams, query).collect()] == want, query


def test_only_needed_buckets_are_read(spark, tmp_path):
    laws = spark.createDataFrame(acts(), "urn string, title string, text string, importance_score double").selectExpr("*", "'law' as type")
    index = search.build_index(laws, str(tmp_path / "index"), buckets=4)
    grams = trigrams.build_trigrams(index, str(tmp_path / "grams"), buckets=32)
    want = sorted(r["urn"] for r in grams.candidates("abcd").collect())
    keep = {f"bucket={zlib.crc32(g) % 32}" for g in (b"abc", b"bcd")}
    for folder in Path(tmp_path).glob("grams/postings/bucket=*"):
        if folder.name not in keep:
            shutil.rmtree(folder)
    assert sorted(r["urn"] for r in grams.candidates("abcd").collect()) == want != []
