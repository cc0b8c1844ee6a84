"""Checks of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import orphan_rows


def dup_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def _empty(column: str):
    return F.coalesce(column, F.lit("")) == ""


def empty_count(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose column is null or empty, per column."""
    return df.agg(*(F.count_if(_empty(c)).alias(f"empty_{c}") for c in columns))


def bad_years(laws: DataFrame, first: int = 1800, last: int = 2030) -> DataFrame:
    return laws.agg(F.count_if((F.col("year") < first) | (F.col("year") > last)).alias("bad_years"))


def validate(laws: DataFrame, cit: DataFrame) -> DataFrame:
    """One row: totals, each check, issue texts in a fixed order, orphans, passed."""
    dups = dup_keys(laws, "urn").agg(F.count("*").alias("n")).select("n").scalar()
    orphans = orphan_rows(cit, laws).agg(F.count("*").alias("n")).select("n").scalar()
    edges = cit.agg(F.count("*").alias("n")).select("n").scalar()
    rows = laws.agg(
        F.count("*").alias("total_laws"), F.count_if(_empty("title")).alias("empty_titles"), F.count_if(_empty("text")).alias("missing_text"), F.count_if((F.col("year") < 1800) | (F.col("year") > 2030)).alias("bad_years")
    )
    rows = rows.withColumn("duplicates", dups).withColumn("orphans", orphans).withColumn("total_citations", edges)
    checks = {"duplicates": "duplicate URNs", "empty_titles": "empty titles", "bad_years": "years out of range", "missing_text": "acts without text"}
    rows = rows.withColumns({f"no_{name}": F.col(name) == 0 for name in checks})
    issues = F.filter(F.array(*(F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(" " + what))) for name, what in checks.items())), lambda x: x.isNotNull())
    return rows.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def extra_checks(laws: DataFrame, cit: DataFrame, meta: DataFrame) -> DataFrame:
    """check and value."""
    orphan_edges = cit.join(laws.select(F.col("urn").alias("cited_urn")), "cited_urn", "left_anti").agg(F.count("*").alias("n")).select("n").scalar()
    count = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    rows = laws.agg(
        F.count_if(F.col("urn").isNull()).alias("no urn"), F.count_if(_empty("title")).alias("no title"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) < 10).alias("no text"), F.count_if(F.col("year").isNull()).alias("no year")
    )
    rows = rows.withColumns({"orphan citations": orphan_edges, "citations": count(cit), "metadata rows": count(meta)})
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("value")) for c in rows.columns))).alias("x")).select("x.*")


def short_texts(laws: DataFrame, least: int = 10) -> DataFrame:
    return laws.filter(F.coalesce(F.length("text"), F.lit(0)) < least).select("urn", "title", F.coalesce(F.length("text"), F.lit(0)).alias("length"))


def presence(laws: DataFrame, expected: list[str]) -> DataFrame:
    """Expected urns and whether the corpus has them."""
    wanted = laws.sparkSession.createDataFrame([(u,) for u in expected], "urn string")
    found = laws.join(F.broadcast(wanted), "urn", "left_semi").select("urn", F.lit(True).alias("present")).distinct()
    return wanted.join(found, "urn", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def state_counters(laws: DataFrame, cit: DataFrame, meta: DataFrame) -> DataFrame:
    count = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    rows = meta.agg(
        F.count("*").alias("metadata_rows"), F.count_if(F.col("pagerank") > 0).alias("with_pagerank"), F.count_if(~_empty("domain_cluster")).alias("with_domain"), F.count_if(F.col("citation_count_incoming") > 0).alias("with_citations_in")
    )
    return rows.withColumn("acts", count(laws)).withColumn("edges", count(cit))
