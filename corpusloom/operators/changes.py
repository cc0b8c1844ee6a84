"""Change detection, merging and snapshots. Tables are versions: every function returns the new rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators.mining import with_periods


def tag_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Collections whose tag is new or differs; is_new where there was none. One row per collection."""
    latest = new.filter("tag is not null and collection is not null").groupBy("collection").agg(F.min(F.struct("tag", *(c for c in new.columns if c not in ("collection", "tag")))).alias("n")).select("collection", "n.*")
    before = old.groupBy("collection").agg(F.min("tag").alias("old_tag"))
    rows = latest.join(before, "collection", "left").filter(F.col("old_tag").isNull() | (F.col("old_tag") != F.col("tag")))
    return rows.withColumn("is_new", F.col("old_tag").isNull())


def record_changes(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that the log has not: no equal (collection, old_etag, new_etag), null equal to null.

    Of equal ones the earliest stays, by detected_at, id and the other columns."""
    known = log.select(*(F.col(c).alias(f"__{c}") for c in ("collection", "old_etag", "new_etag")))
    same = F.lit(True)
    for c in ("collection", "old_etag", "new_etag"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    ordered = sorted(changes.columns, key=lambda c: {"detected_at": 0, "id": 1}.get(c, 2))
    earliest = changes.groupBy("collection", "old_etag", "new_etag").agg(F.min(F.struct(*ordered)).alias("__first"))
    return earliest.select(*(F.col(f"__first.{c}").alias(c) for c in changes.columns)).join(known, same, "left_anti")


def pending(log: DataFrame, preview: str) -> DataFrame:
    """Unprocessed changes newest first, with their preview decoded by the schema given."""
    return log.filter("status = 'pending'").withColumn("preview", F.from_json("preview_data", preview)).orderBy(F.desc("detected_at"), "id")


def recent_changes(log: DataFrame, k: int = 20) -> DataFrame:
    return log.orderBy(F.desc("detected_at"), "id").limit(k)


def mark_processed(log: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """The log with the given ids set to processed at the given time."""
    flags = ids.select("id").distinct().withColumn("__done", F.lit(True))
    rows = log.join(flags, "id", "left")
    rows = rows.withColumn("status", F.when(F.col("__done"), "processed").otherwise(F.col("status")))
    return rows.withColumn("processed_at", F.when(F.col("__done"), F.lit(now))).drop("__done")


def new_or_changed(cur: DataFrame, prod: DataFrame, columns: tuple[str, ...] = ("text_length", "article_count")) -> DataFrame:
    """Acts that production has not, or has with other values."""
    before = prod.select("urn", *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__known"))
    differs = F.col("__known").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cur.join(before, "urn", "left").filter(differs).select(*cur.columns)


def merge_latest(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The base with the delta's rows in place of those of the same urn."""
    return base.join(delta.select("urn"), "urn", "left_anti").unionByName(delta, allowMissingColumns=True)


def verify_staging(prod: DataFrame, staging: DataFrame) -> DataFrame:
    """Counts of both sides, their difference, rows without urn or title, and the verdict."""
    count = prod.agg(F.count("*").alias("n")).select("n").scalar()
    rows = staging.agg(F.count("*").alias("staging_count"), F.count_if(F.col("urn").isNull()).alias("null_urns"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("null_titles"))
    rows = rows.withColumn("prod_count", count).withColumn("difference", F.col("staging_count") - F.col("prod_count"))
    return rows.withColumn("passed", F.expr("staging_count > 0 and null_urns = 0 and staging_count >= prod_count"))


def merge_with_log(base: DataFrame, delta: DataFrame, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged rows and a log of what was added and updated."""
    known = base.select("urn").distinct().withColumn("__known", F.lit(True))
    action = F.when(F.col("__known"), "updated").otherwise("added").alias("action")
    log = delta.join(known, "urn", "left").select(F.lit(now).cast("timestamp").alias("timestamp"), F.col("urn").alias("law_urn"), action)
    return merge_latest(base, delta), log


def _first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return rows.filter("__n = 1").drop("__n")


def dedupe_first(df: DataFrame, order: tuple[str, ...], key: str = "urn") -> DataFrame:
    """The first row of each key by the order columns; rows without a key go."""
    return _first(df, key, [F.asc(c) for c in order])


def dedupe_last(df: DataFrame, order: tuple[str, ...], key: str = "urn") -> DataFrame:
    return _first(df, key, [F.desc(c) for c in order])


def dedupe_counts(df: DataFrame, key: str = "urn") -> DataFrame:
    """kept, skipped (repeats) and rows without a key."""
    return df.agg(F.count_distinct(key).alias("kept"), (F.count(key) - F.count_distinct(key)).alias("skipped"), F.count_if(F.col(key).isNull()).alias("no_key"))


def separate_tracks(vigente: DataFrame, abrogated: DataFrame) -> DataFrame:
    """All acts once, with track (vigente or abrogated), status rewritten for moved ones, and moved.

    A row belongs to the abrogated set if its source or status says so. Of acts in both inputs, one that moves
    replaces the other."""
    rows = vigente.withColumn("__from", F.lit("vigente")).unionByName(abrogated.withColumn("__from", F.lit("abrogated")))
    gone = F.lower(F.coalesce("source_collection", F.lit(""))).contains("abrogat") | (fx.normalized_status(F.col("status")) == "abrogated")
    rows = rows.withColumn("track", F.when(gone, "abrogated").otherwise("vigente")).withColumn("moved", F.col("track") != F.col("__from"))
    rows = rows.withColumn("status", F.when(F.col("moved"), F.when(gone, "abrogated").otherwise("in_force")).otherwise(F.col("status")))
    best = Window.partitionBy("urn", "track").orderBy(F.desc("moved"), "__from")
    return rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n", "__from")


def track_manifest(separated: DataFrame) -> DataFrame:
    return separated.agg(
        F.count_if(F.col("track") == "vigente").alias("vigente_count"),
        F.count_if(F.col("track") == "abrogated").alias("abrogated_count"),
        F.count_if(F.col("moved") & (F.col("track") == "abrogated")).alias("moved_to_abrogated"),
        F.count_if(F.col("moved") & (F.col("track") == "vigente")).alias("moved_to_vigente"),
    )


def capture_snapshot(laws: DataFrame, snapshot_id: int, note: str = "") -> DataFrame:
    """Status of every act at one time, to be appended under its id."""
    return laws.select(
        F.lit(snapshot_id).alias("snapshot_id"), "urn", "title", "year", F.lower(F.coalesce("status", F.lit(""))).alias("status"), fx.dataset_track(F.col("source_collection"), F.col("status")).alias("track"), "source_collection", F.lit(note).alias("note")
    )


def transitions(snap: DataFrame) -> DataFrame:
    """Changes of status or track between each snapshot and the one before: snapshot_id, urn, from, to."""
    ids = snap.select("snapshot_id").distinct()
    pairs = ids.select("snapshot_id", F.lag("snapshot_id").over(Window.orderBy("snapshot_id")).alias("before")).filter("before is not null")  # one row a snapshot
    text = lambda c: F.coalesce(c, F.lit(""))
    old = snap.select(F.col("snapshot_id").alias("before"), "urn", F.col("status").alias("from_status"), F.col("track").alias("from_track"))
    new = snap.select("snapshot_id", "urn", F.col("status").alias("to_status"), F.col("track").alias("to_track"))
    rows = new.join(F.broadcast(pairs), "snapshot_id").join(old, ["before", "urn"])
    return rows.filter((text("from_status") != text("to_status")) | (text("from_track") != text("to_track"))).select("snapshot_id", "urn", "from_status", "to_status", "from_track", "to_track")


def recent_snapshots(snap: DataFrame, k: int = 50) -> DataFrame:
    return snap.groupBy("snapshot_id").agg(F.count("*").alias("acts")).orderBy(F.desc("snapshot_id")).limit(k)


def transition_counts(trans: DataFrame) -> DataFrame:
    return trans.groupBy("snapshot_id").agg(F.count("*").alias("n"))


def latest_transitions(trans: DataFrame, k: int = 100) -> DataFrame:
    return trans.orderBy(F.desc("snapshot_id"), "urn").limit(k)


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("urn"), "urn", "left_anti")


def updated(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = ("title", "text_length", "importance_score")) -> DataFrame:
    """Acts of both versions that differ in one of the columns."""
    used = [c for c in columns if c in old.columns and c in new.columns]
    before = old.select("urn", *(F.col(c).alias(f"__{c}") for c in used))
    differs = F.lit(False)
    for c in used:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(before, "urn").filter(differs).select(*new.columns)


def compare(old: DataFrame, new: DataFrame, old_cit: DataFrame, new_cit: DataFrame, sample_added: int = 100, sample_updated: int = 50) -> DataFrame:
    """One row: totals of added and updated acts with samples by urn, and the difference of the citations."""
    one = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    some = lambda df, k: df.select("urn").orderBy("urn").limit(k).agg(F.sort_array(F.collect_list("urn")).alias("u")).select("u").scalar()
    a, u = added(old, new), updated(old, new)
    return new.sparkSession.range(1).select(
        one(a).alias("added"), some(a, sample_added).alias("added_sample"), one(u).alias("updated"), some(u, sample_updated).alias("updated_sample"), (one(new_cit) - one(old_cit)).alias("citation_delta")
    )


def insert_ignore(base: DataFrame, new: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The base and the first new row of each key that it has not."""
    return base.unionByName(dedupe_first(new, order, key).join(base.select(key), key, "left_anti").select(*base.columns))


def upsert_laws(base: DataFrame, new: DataFrame) -> DataFrame:
    """The base with new rows in place of old ones; a missing status becomes in_force, periods are filled in."""
    ready = with_periods(new.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("in_force"))))
    return merge_latest(base, ready)


def update_columns(base: DataFrame, patch: DataFrame, key: str = "urn") -> DataFrame:
    """The base with the patch's non-null values; other columns and rows stay."""
    columns = [c for c in patch.columns if c != key and c in base.columns]
    new = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    rows = base.join(new, key, "left")
    return rows.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))
