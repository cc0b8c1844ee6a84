"""The pipeline's stages on the small tables and on awkward rows."""

from collections import Counter

import corpus_pipeline
from corpusloom.llm import bpe, common, exact_dedup, mixing, quality, simhash
from corpusloom.llm.common import stored
from tests.llm.helpers import awkward, frame, with_clashes, words
from tests.llm.test_text_ops import brute_components, brute_fingerprint
from tests.oracle import connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), f"test-{name}"))
    assert all(df.columns == columns for df in seen[:-1])
    ids = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in seen]
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert ids[1] == sorted(good)
    assert ids[2] == sorted(r["doc_id"] for r in exact_dedup.exact_dedup(seen[1]).filter("kept").collect())
    assert ids[3] == sorted({r["component_id"] for r in simhash.near_duplicates(seen[2]).collect()})
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    want = bpe.encode_documents(seen[4], ids=False).select("doc_id", "ids_sha256")
    assert Counter(map(tuple, want.collect())) == Counter(map(tuple, seen[5].select("doc_id", "ids_sha256").collect()))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == ids[5]


def strip(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_on_awkward_rows(spark):
    """Every stage's rows, each against what its own input says."""
    rows = awkward()
    docs = with_clashes(frame(spark, rows))
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    # quality: all rows of texts that the model takes, and no others
    model = quality.fit(docs, labels)
    good = {t: s >= 0.7 for t, s in zip([r[1] for r in rows], model.scores([r[1] or "" for r in rows]), strict=True)}
    assert texts(stages["quality"](spark, docs, SF)) == Counter((r[0], r[1]) for r in rows if good[r[1]])
    # exact: of each text the longest, then the smallest id, once
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0, r[1] or "")):
        best.setdefault(strip(r[1]), r)
    exact = stored(stages["exact_dedup"](spark, docs, SF), "awkward-exact")
    assert Counter((i, t or "") for i, t in texts(exact).elements()) == Counter((r[0], r[1] or "") for r in best.values())
    # near: one row a component, the smallest id of it
    near = stored(stages["near_dedup"](spark, exact, SF), "awkward-near")
    kept, given = near.collect(), exact.collect()
    groups = brute_components({brute_fingerprint(r["text"]) for r in given})
    of = {}
    for r in given:
        of.setdefault(min(groups[brute_fingerprint(r["text"])]), []).append(r["doc_id"])
    assert Counter(min(groups[brute_fingerprint(r["text"])]) for r in kept) == Counter(of.keys())
    assert {min(groups[brute_fingerprint(r["text"])]): r["doc_id"] for r in kept} == {k: min((i for i in v if i is not None), default=None) for k, v in of.items()}
    # mixing: kept rows only, each as often as words_taken's words have it
    mixed = stored(stages["mixing"](spark, near, SF), "awkward-mixed")
    assert mixed.columns == docs.columns and set(texts(mixed)) <= set(texts(near)) and max(texts(mixed).values()) <= 2
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.words_taken(near).collect()}
    for (doc_id, text), n in texts(mixed).items():
        size = len(words(text))
        assert n == 1 if size == 0 else abs(n * size - taken[doc_id, size]) <= size
    # encoding: one row a play
    assert Counter(r["doc_id"] for r in stages["encoding"](spark, mixed, SF).collect()) == Counter(i for i, _ in texts(mixed).elements())
    empty = with_clashes(frame(spark, []))
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), f"empty-{name}")
    assert empty.count() == 0


def test_run_leaves_one_folder(spark):
    """Of what the stages store, the rows that the last one reads are left."""

    def folders():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/*")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return {str(s.getPath().getName()) for s in found}

    before = folders()
    made = len(common._made)
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {n for n in folders() - before if "-" in n and n.split("-")[0] in ("pipeline", "fingerprints", "measured")}
    assert len(left) == 1 and left.pop().startswith("pipeline-mixing-") and len(common._made) == made


def test_queries_with_sql(spark):
    from corpusloom.llm import registry

    con = connect(SF)
    for name, sql in registry.oracle_sql().items():
        assert rows_of_spark(registry.queries()[name](spark, SF)) == rows_of_duck(con, sql), name
