"""Exact duplicates up to ASCII white space, with DataFrame functions only.

1. One scan measures every row: MD5 (128 bits) and SHA-256 of the normalised text, and the length of the original.
2. Rows are grouped by the 128-bit hash alone. Most groups are one row, and their texts are never shuffled.
3. Of groups of two rows or more the bytes are compared: their rows, and no others, are grouped by hash and text, so
   equal hashes of different bytes fall apart. The group-by collapses copies within each map task before anything is
   shuffled: a text that makes up a third of the corpus costs one row per map task.

The hashes of the large groups are broadcast if their bytes are few; else the rows are shuffled to them.

Defined cases: a null text counts as empty; empty texts form one group; a null doc_id is chosen last;
rows equal in doc_id, text and length are all marked as kept if one of them is, and drop_exact_duplicates keeps one
of them, the first by text and then by its columns as JSON; very long texts are hashed and compared whole; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, cut, joined_small, stored, whole_text


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _hash128(docs: DataFrame) -> DataFrame:
    """The rows with norm (the normalised text) and hash128."""
    return docs.withColumn("norm", without_spaces(whole_text())).withColumn("hash128", F.unhex(F.md5("norm")))


def _repeated(hashes: DataFrame) -> DataFrame:
    """The hashes of two rows or more."""
    return cut(hashes.groupBy("hash128").agg(F.count("*").alias("n")).filter("n > 1").select("hash128"))


def duplicate_groups(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per distinct normalised text of the repeated hashes: hash128, text_sha256, keep_id, keep_chars, group_size.

    The row that stays has the most code points in its original text, then the smallest doc_id. `rows` has doc_id,
    n_chars, norm and hash128."""
    by_text = joined_small(rows, repeated, "hash128", "left_semi").groupBy("hash128", "norm", "n_chars").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    narrow = by_text.select("hash128", F.sha2("norm", 256).alias("text_sha256"), "n_chars", "first_id", "n")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("first_id").isNull().alias("absent"), F.col("first_id").alias("id")))
    return (
        narrow.groupBy("hash128", "text_sha256")
        .agg(best.alias("best"), F.sum("n").alias("group_size"))
        .select("hash128", "text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _hash128(docs.select("doc_id", whole_text().alias("text"))).withColumn("n_chars", F.length("text").cast("long"))
    measured = stored(rows.select("doc_id", "n_chars", "hash128", F.sha2("norm", 256).alias("text_sha256")), "measured")
    groups = cut(duplicate_groups(rows, _repeated(measured)))
    one = F.col("group_size").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return joined_small(measured, groups, ["hash128", "text_sha256"], "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (one | stays).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Rows of other texts pass; those of repeated hashes are grouped by hash and text, and the best of each stays."""
    rows = _hash128(docs.select(F.struct(*docs.columns).alias("row"), "text")).select("row", "norm", "hash128")
    repeated = _repeated(rows)
    text, doc_id = F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.col("row.doc_id")
    order = F.struct((-F.length(text)).alias("less"), doc_id.isNull().alias("absent"), doc_id.alias("id"), text.alias("text"), F.to_json("row").alias("row"))
    shared = joined_small(rows, repeated, "hash128", "left_semi").groupBy("hash128", "norm").agg(F.min_by("row", order).alias("row"))
    return joined_small(rows, repeated, "hash128", "left_anti").select("row.*").unionByName(shared.select("row.*"))


OP7_SQL = r"""
with r as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as n_chars, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') as norm from r),
k as (select doc_id, norm, n_chars,
  first_value(doc_id) over (partition by norm order by n_chars desc, doc_id nulls last) as keep_id,
  first_value(n_chars) over (partition by norm order by n_chars desc, doc_id nulls last) as keep_chars,
  count(*) over (partition by norm) as group_size from n)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id and n_chars = keep_chars) as kept,
  sha256(norm) as text_sha256 from k
"""
