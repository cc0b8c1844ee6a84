"""A training corpus from documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns
of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again, so a lost
executor costs a stage's own tasks only. What a stage kept there besides is deleted when its rows are written, and its
rows when the next stage's are.

Defined cases, in every stage: a null text counts as empty, and empty texts are judged by the classifier's bias; of
repeated rows and of ties one row stays, by doc_id (null last), then text; documents without an id are told apart by
their texts; very long texts are taken whole; an empty table gives no rows, and columns beyond those of documents are
carried along, whatever their names.

1. quality: documents that the classifier rejects (score under 0.7) go. Labels of held-out rows are not read.
2. exact_dedup: of texts equal up to white space, one stays.
3. near_dedup: of each component of near-duplicates (SimHash of 4-word shingles within 4 bits), the row with the
   smallest doc_id stays.
4. mixing: documents repeat or go as the mix of sources plays them.
5. encoding: doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of what is left, one row a play.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, exact_dedup, mixing, quality, simhash
from corpusloom.llm.common import discard, fresh_dir, scratch, table
from corpusloom.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL has no classifier, SimHash or BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            done = stage(spark, docs, sf_dir)
            path = keep(fresh_dir(spark, f"pipeline-{name}"))
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
