"""Rows that differ only beside id and text, and very long texts through the operators that had no such test."""

import hashlib
import itertools

from corpusloom.llm import exact_dedup, media, mixing, simhash, warc
from tests.llm.helpers import frame, words

LONG = "word " * 300_000 + "x" * 200_000


def test_near_dedup_keeps_the_same_of_equal_rows(spark):
    """Three sources under one id and text: whatever the order and number of partitions, one row stays."""
    rows = [(1, "one two three four five six", "en", s, n) for s, n in (("x", 3), ("y", 1), ("z", 2))]
    found = set()
    for order in itertools.permutations(rows):
        for parts in (1, 3):
            docs = frame(spark, [*order, (2, "something else entirely here now", "en", "q", 1)], parts)
            left = simhash.one_of_each_component(docs).filter("doc_id = 1").collect()
            assert len(left) == 1
            found.add(tuple(left[0]))
    assert len(found) == 1


def test_very_long_texts(spark):
    rows = [(1, LONG, "en", "a", 1), (2, LONG + " ", "en", "b", 1), (3, "short", "en", "a", 1)]
    docs = frame(spark, rows, 2)
    sizes = {r["doc_id"]: r["size"] for r in mixing.words_taken(docs).collect()}
    assert sizes == {1: 300_001, 2: 300_001, 3: 1}
    found = {r["doc_id"]: r for r in media.media_round_trip(docs).collect()}
    assert found[1]["n_bytes"] == len(LONG) and found[1]["payload_sha256"] == hashlib.sha256(media.padded(LONG.encode())).hexdigest()
    kept = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
    assert len(words(LONG)) == 300_001


def test_very_long_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG), (2, "u", LONG), (3, None, "x")], "page_id long, url string, html string")
    found = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect())
    assert found == [(1, len(LONG), "response", None), (2, len(LONG), "revisit", 1), (2, len(LONG), "revisit", 1), (3, 1, "response", None)]
