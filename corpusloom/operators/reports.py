"""Statistics and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dims
from corpusloom.functions import text as fx


def one_row(spark, **counts: DataFrame) -> DataFrame:
    """The number of rows of each table, in one row."""
    return spark.range(1).select(*(df.agg(F.count("*").alias("n")).select("n").scalar().alias(name) for name, df in counts.items()))


def by_type(laws: DataFrame, k: int | None = None, missing: str = "unknown") -> DataFrame:
    rows = laws.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit(missing)).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")
    return rows.limit(k) if k else rows


def by_year(laws: DataFrame, last: int | None = None) -> DataFrame:
    """Acts by year above 0, ascending; or the last years, descending."""
    rows = laws.filter("year > 0").groupBy("year").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("year")).limit(last) if last else rows.orderBy("year")


def temporal_distribution(laws: DataFrame, *dates: str) -> DataFrame:
    """level (decade or all), decade, acts, earliest and latest year; the year of the first date given."""
    year = fx.year_of(F.coalesce(*(F.nullif(d, F.lit("")) for d in dates)))
    rows = laws.select(year.alias("y")).filter("y is not null").withColumn("decade", (F.floor(F.col("y") / 10) * 10).cast("int"))
    rows = rows.groupingSets([["decade"], []], "decade").agg(F.count("*").alias("acts"), F.min("y").alias("earliest"), F.max("y").alias("latest"), F.grouping("decade").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise("decade").alias("level"), "decade", "acts", "earliest", "latest")


def by_domain(meta: DataFrame) -> DataFrame:
    return meta.filter("domain_cluster <> ''").groupBy("domain_cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain_cluster")


def text_stats(laws: DataFrame) -> DataFrame:
    return laws.agg(
        F.round(F.coalesce(F.avg("text_length"), F.lit(0.0))).alias("avg_length"),
        F.coalesce(F.sum("text_length"), F.lit(0)).alias("total_length"),
        F.round(F.coalesce(F.avg("article_count"), F.lit(0.0)), 1).alias("avg_articles"),
        F.coalesce(F.sum("article_count"), F.lit(0)).alias("total_articles"),
    )


def length_stats(laws: DataFrame, columns: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """field, n, least, most, mean and upper median of the lengths of non-empty values.

    The median is found from the counts of each length, so only distinct lengths are ordered."""
    stacked = laws.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.length(c).alias("length")) for c in columns))).alias("x")).select("x.*").filter("length > 0")
    counts = stacked.groupBy("field", "length").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("field")
    counts = counts.withColumn("upto", F.sum("c").over(whole.orderBy("length"))).withColumn("n", F.sum("c").over(whole))
    median = F.min(F.when(F.expr("upto > n div 2"), F.col("length")))
    return counts.groupBy("field").agg(
        F.max("n").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"), F.round(F.sum(F.col("length") * F.col("c")) / F.max("n"), 6).alias("mean"), median.alias("median")
    )


def coverage(laws: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n and percent (2 decimals) of the rows that meet it."""
    counts = laws.agg(F.count("*").alias("all"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))).alias("x")
    return counts.select("all", pairs).select("x.rule", "x.n", F.round(F.col("x.n") * 100 / F.nullif("all", F.lit(0)), 2).alias("percent"))


def serialized_mb(df: DataFrame) -> DataFrame:
    """Size of the rows as JSON lines, in MB."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) + 1)
    return df.agg(F.round(F.coalesce(size, F.lit(0)) / 2**20, 6).alias("mb"))


def counted(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Rows by a column, most first."""
    rows = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key))
    return rows.limit(k) if k else rows


def dashboard(laws: DataFrame) -> DataFrame:
    known = fx.normalized_status(F.col("status"))
    return laws.agg(
        F.count("*").alias("acts"),
        F.count_distinct("type").alias("types"),
        F.min(F.when(F.col("year") > 0, F.col("year"))).alias("min_year"),
        F.max(F.when(F.col("year") > 0, F.col("year"))).alias("max_year"),
        F.coalesce(F.sum("article_count"), F.lit(0)).alias("articles"),
        F.count_if(known == "in_force").alias("in_force"),
        F.count_if(known == "abrogated").alias("abrogated"),
        F.count_if(F.col("importance_score") > 0).alias("scored"),
    )


def label_by_status(reg: DataFrame) -> DataFrame:
    return reg.groupBy("label", "status").agg(F.count("*").alias("n"))


def label_registry(reg: DataFrame) -> DataFrame:
    rows = reg.groupBy("label").agg(F.count_distinct("urn").alias("acts"), F.count("*").alias("mentions"))
    return rows.orderBy(F.desc("acts"), F.desc("mentions"), "label")


def registry_overview(reg: DataFrame) -> DataFrame:
    return reg.agg(F.count("*").alias("rows"), F.count_distinct("urn").alias("acts"), F.count_distinct("label").alias("labels"))


def registry_view(reg: DataFrame, label: str | None = None, status: str | None = None) -> DataFrame:
    if label:
        reg = reg.filter(F.col("label") == label)
    if status:
        reg = reg.filter(F.col("status") == status)
    return reg.select("urn", "title", "year", "label", "status").orderBy(F.desc_nulls_last("year"), "title", "urn")


def label_notes(reg: DataFrame, notes: dict[str, str], default: str = "No note.") -> DataFrame:
    table = reg.sparkSession.createDataFrame(list(notes.items()), "label string, note string")
    return reg.select("label").distinct().join(F.broadcast(table), "label", "left").select("label", F.coalesce("note", F.lit(default)).alias("note"))


def track_counts(laws: DataFrame) -> DataFrame:
    return laws.groupBy(fx.dataset_track(F.col("source_collection"), F.col("status")).alias("track")).agg(F.count("*").alias("n"))


def track_view(laws: DataFrame, track: str, k: int = 200) -> DataFrame:
    rows = laws.filter(fx.dataset_track(F.col("source_collection"), F.col("status")) == track)
    return rows.select("urn", "title", "year").orderBy(F.desc_nulls_last("year"), "urn").limit(k)


def catalogue_track(name: Column, variant: Column) -> Column:
    v = F.upper(variant)
    return F.when(F.lower(name).contains("abrogat") & (v == "O"), "abrogato").when(v == "M", "multivigente").when(v == "V", "vigente")


def catalogue_tracks(cat: DataFrame) -> DataFrame:
    """Per track: acts and latest date of creation. The original variant counts for repealed collections only."""
    rows = cat.withColumn("track", catalogue_track(F.col("collection"), F.col("variant"))).filter("track is not null")
    return rows.groupBy("track").agg(F.sum("acts").alias("acts"), F.max("created").alias("latest"))


def coverage_gap(laws: DataFrame, cat: DataFrame) -> DataFrame:
    """Per track: local and catalogue acts, the difference, and the sum of the positive differences."""
    tracks = laws.sparkSession.createDataFrame([("vigente",), ("multivigente",), ("abrogato",)], "track string")
    rows = tracks.join(track_counts(laws).withColumnRenamed("n", "local"), "track", "left").join(catalogue_tracks(cat).select("track", F.col("acts").alias("remote")), "track", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("local", "remote")}).withColumn("delta", F.col("remote") - F.col("local"))
    return rows.withColumn("total_gap", F.sum(F.greatest("delta", F.lit(0))).over(Window.partitionBy()))  # three rows


def variant_matrix(cat: DataFrame) -> DataFrame:
    """collection, has_o, has_v, has_m, acts, all_three, only_v."""
    rows = cat.groupBy("collection").pivot("variant", ["O", "V", "M"]).agg(F.sum("acts"))
    rows = rows.select("collection", *((F.col(v).isNotNull()).alias(f"has_{v.lower()}") for v in "OVM"), sum((F.coalesce(v, F.lit(0)) for v in "OVM"), F.lit(0)).alias("acts"))
    return rows.withColumn("all_three", F.expr("has_o and has_v and has_m")).withColumn("only_v", F.expr("has_v and not has_o and not has_m"))


def collections_with(cat: DataFrame, variants: list[str]) -> DataFrame:
    """Collections that offer any of the variants, with those they offer."""
    rows = cat.groupBy("collection").agg(F.sort_array(F.collect_set("variant")).alias("variants"))
    return rows.filter(F.arrays_overlap("variants", F.array(*map(F.lit, variants))))


def catalogue_scan(cat: DataFrame) -> DataFrame:
    """Collections whose name shows a track."""
    low = F.lower("collection")
    key = F.when(low.contains("multivigent"), "multivigente").when(low.contains("abrog"), "abrogato").otherwise("vigente")
    return cat.filter(low.rlike("vigent|abrog")).select("collection", "acts", key.alias("key"))


def history_gap(laws: DataFrame, ratios: dict[str, float] | None = None, default: float = 2.0) -> DataFrame:
    """Per collection: acts, ratio, acts expected of the full history and additional ones (whole numbers)."""
    low = F.lower("urn")
    guess = F.when(low.contains("cost"), "Costituzione").when(low.contains("codice"), "Codici").otherwise("Varie")
    table = laws.sparkSession.createDataFrame(list((ratios or dims.HISTORY_RATIOS).items()), "collection string, ratio double")
    rows = laws.groupBy(F.coalesce("collection", "type", guess).alias("collection")).agg(F.count("*").alias("acts"))
    rows = rows.join(F.broadcast(table), "collection", "left").withColumn("ratio", F.coalesce("ratio", F.lit(default)))
    return rows.withColumn("expected", F.expr("cast(acts * ratio as bigint)")).withColumn("additional", F.expr("cast(acts * (ratio - 1) as bigint)"))


def budget_select(items: DataFrame, budget: float, group: str = "grp") -> DataFrame:
    """Items in order of priority: taken if they fit what is left of the group's budget, else skipped with a reason.

    A group's rows pass as a sorted stream; what is held is one remaining budget, not the group."""
    rows = items.select(F.col(group).alias("g"), "priority", "name", F.col("size").cast("double").alias("size"))
    rows = rows.repartition("g").sortWithinPartitions("g", "priority", "name", "size")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, pos = fold, 0.0, 0  # no group yet
        for batch in batches:
            places, before, after = [], [], []
            for key, size in zip(batch["g"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if key != at:
                    at, left, pos = key, float(budget), 0
                places.append(pos)
                before.append(left)
                left, pos = left - size if size is not None and size <= left else left, pos + 1
                after.append(left)
            kept = [batch["g"], batch["name"], batch["size"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(before, pa.float64()), pa.array(after, pa.float64())], ["g", "name", "size", "pos", "left", "rest"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.mapInArrow(fold, f"g {kind['g']}, name {kind['name']}, size double, pos int, `left` double, rest double")
    last = done.groupBy(F.col("g").alias("of")).agg(F.round(F.max_by("rest", "pos"), 6).alias("remaining"))
    fits = F.col("size") <= F.col("left")
    reason = F.when(~fits, F.format_string("exceeds budget (%.2f > %.2f)", "size", "left")).otherwise("")
    done = done.join(last, F.col("g").eqNullSafe(F.col("of")))
    return done.select(F.col("g").alias(group), "remaining", "pos", "name", "size", fits.alias("included"), reason.alias("reason"))


def variant_ratios(df: DataFrame) -> DataFrame:
    """Ratios of files, size and mean size of two variants (v_files, v_mb, m_files, m_mb), and what is additional."""
    over = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    c = F.col
    return df.select(
        "collection",
        over(c("m_files"), c("v_files")).alias("file_ratio"),
        over(c("m_mb"), c("v_mb")).alias("size_ratio"),
        over(c("m_mb") * c("v_files"), c("v_mb") * c("m_files")).alias("mean_ratio"),
        (c("m_files") - c("v_files")).alias("extra_files"),
        F.round(c("m_mb") - c("v_mb"), 6).alias("extra_mb"),
    )


def changelog_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("runs"), F.coalesce(F.sum("laws_added"), F.lit(0)).alias("laws_added"), F.coalesce(F.sum("laws_updated"), F.lit(0)).alias("laws_updated"), F.max("timestamp").alias("latest"))


def latest(log: DataFrame, order: str, k: int, *ties: str) -> DataFrame:
    """The newest k entries."""
    return log.orderBy(F.desc(order), *ties).limit(k)


def change_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.max("detected_at").alias("latest"))


def run_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("total"), *(F.count_if(F.col("result") == r).alias(r) for r in ("ok", "failed", "skipped")))


def metrics_document(df: DataFrame) -> DataFrame:
    """Long-form metrics (metric, key, value) as one JSON document per metric."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return df.groupBy("metric").agg(F.to_json(pairs).alias("document"))
