"""Change-detection queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import changes as c
from corpusloom.operators import versions
from corpusloom.plans.mining import ERA, GOV, LEG, STATUS, TRACK
from corpusloom.sources import files
from corpusloom.sources.tables import shared_dir

NOW = dt.datetime(2024, 2, 1)
MIDDLE = dt.datetime(2024, 1, 16)


@register("c01_tag_diff", "select n.collection, n.tag, n.acts, o.tag as old_tag, o.tag is null as is_new from v_tags_new n left join v_tags_old o on o.collection = n.collection where n.tag is not null and (o.tag is null or o.tag <> n.tag)")
def _(t):
    return c.tag_diff(t.tags_old, t.tags_new)


EARLY = dt.datetime(2024, 1, 8)


@register("c02_record_changes", """with w as (select collection, old_etag, concat(new_etag, '-', cast(id // 50 as varchar)) as new_etag, detected_at < timestamp '2024-01-08' as logged from v_log)
 select distinct collection, old_etag, new_etag from w n where not exists (select 1 from w o where o.logged and o.collection is not distinct from n.collection and o.old_etag is not distinct from n.old_etag and o.new_etag is not distinct from n.new_etag)""")
def _(t):
    rows = t.log.withColumn("new_etag", F.concat("new_etag", F.lit("-"), F.expr("id div 50").cast("string")))
    return c.record_changes(rows.filter(F.col("detected_at") < F.lit(EARLY)), rows).select("collection", "old_etag", "new_etag")


ALL_CHANGES = "w as (select collection, old_etag, concat(new_etag, '-', cast(id // 500 as varchar)) as new_etag, detected_at < timestamp '2024-01-16' as logged from v_log)"


def _log_and_changes(t):
    """The log of January's first half and the changes of all rows; the tags differ from one 500 ids to the next, so both grow."""
    rows = t.log.withColumn("new_etag", F.concat("new_etag", F.lit("-"), F.expr("id div 500").cast("string")))
    return rows.filter(F.col("detected_at") < F.lit(MIDDLE)), rows


@register("c02_record_all_changes", f"""with {ALL_CHANGES} select distinct collection, old_etag, new_etag from w n where not exists (select 1 from w o where o.logged and o.collection is not distinct from n.collection and o.old_etag is not distinct from n.old_etag and o.new_etag is not distinct from n.new_etag)""")
def _(t):
    return c.record_changes(*_log_and_changes(t)).select("collection", "old_etag", "new_etag")


@register("c03_pending", "select id, collection, json_extract_string(preview_data, '$.k') as k from v_log where status = 'pending'")
def _(t):
    return c.pending(t.log, "k string").select("id", "collection", F.col("preview.k").alias("k"))


@register("c03_recent_changes", "select id, collection, status from v_log order by detected_at desc, id limit 20")
def _(t):
    return c.recent_changes(t.log).select("id", "collection", "status")


@register("c04_mark_processed", "select id, case when id % 10 = 3 then 'processed' else status end as status, case when id % 10 = 3 then timestamp '2024-02-01' end as processed_at from v_log")
def _(t):
    return c.mark_processed(t.log, t.log.filter("id % 10 = 3").select("id"), NOW).select("id", "status", "processed_at")


@register("c05_new_or_changed", "select n.urn, n.text_length, n.article_count from v_new n left join v_old o on o.urn = n.urn where o.urn is null or o.text_length is distinct from n.text_length or o.article_count is distinct from n.article_count")
def _(t):
    return c.new_or_changed(t.new, t.old).drop("title")


def _versions(t):
    """The new and the old version, stored with digests."""
    where = f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    old = versions.store_version(t.old, f"{where}/old", buckets=8)
    return versions.store_version(t.new, f"{where}/new", buckets=8), old


@register("c05_by_digests", "select n.urn, n.text_length, n.article_count from v_new n left join v_old o on o.urn = n.urn where o.urn is null or o.text_length is distinct from n.text_length or o.article_count is distinct from n.article_count")
def _(t):
    return versions.new_or_changed(*_versions(t)).drop("title")


@register("c16_removed_by_digests", "select urn, text_length, article_count, title from v_old where urn not in (select urn from v_new)")
def _(t):
    return versions.removed(*_versions(t))


DELTA = "delta as (select n.* from v_new n left join v_old o on o.urn = n.urn where o.urn is null or o.text_length is distinct from n.text_length), merged as (select * from v_old where urn not in (select urn from delta) union all select * from delta)"


@register("c06_merge_latest", f"with {DELTA} select * from merged")
def _(t):
    return c.merge_latest(t.old, c.new_or_changed(t.new, t.old))


@register("c07_verify_staging", f"""with {DELTA} select count(*) as staging_count, count(*) filter (where urn is null) as null_urns, count(*) filter (where coalesce(title, '') = '') as null_titles, (select count(*) from v_old) as prod_count,
 count(*) - (select count(*) from v_old) as difference, count(*) >= (select count(*) from v_old) as passed from merged""")
def _(t):
    return c.verify_staging(t.old, c.merge_latest(t.old, c.new_or_changed(t.new, t.old)))


@register("c09_merge_with_log", f"with {DELTA} select urn as law_urn, case when urn in (select urn from v_old) then 'updated' else 'added' end as action from delta")
def _(t):
    return c.merge_with_log(t.old, c.new_or_changed(t.new, t.old))[1].select("law_urn", "action")


@register("c10_dedupe_first", "select law_urn as urn, min(id) as id from v_log group by 1")
def _(t):
    return c.dedupe_first(t.log.withColumnRenamed("law_urn", "urn"), ("id",)).select("urn", "id")


@register("c10_dedupe_counts", "select count(distinct old_etag) as kept, count(old_etag) - count(distinct old_etag) as skipped, count(*) filter (where old_etag is null) as no_key from v_log")
def _(t):
    return c.dedupe_counts(t.log, "old_etag")


@register("c11_dedupe_last", "select old_etag, max(id) as id from v_log where old_etag is not null group by 1")
def _(t):
    return c.dedupe_last(t.log, ("id",), "old_etag").select("old_etag", "id")


GONE = f"(contains(lower(coalesce(source_collection, '')), 'abrogat') or {STATUS} = 'abrogated')"
SEPARATE = f"""with i as (select *, 'vigente' as f from v_laws where article_count < 15 union all select *, 'abrogated' as f from v_laws where article_count >= 10), g as (select *, case when {GONE} then 'abrogated' else 'vigente' end as track from i),
 m as (select *, track <> f as moved from g), k as (select *, row_number() over (partition by urn, track order by moved desc, f) as n from m)"""


def _separated(t):
    return c.separate_tracks(t.laws.filter("article_count < 15"), t.laws.filter("article_count >= 10"))


@register("c12_separate_tracks", SEPARATE + " select urn, track, moved, case when moved then case track when 'abrogated' then 'abrogated' else 'in_force' end else status end as status from k where n = 1")
def _(t):
    return _separated(t).select("urn", "track", "moved", "status")


@register("c12_written_tracks", SEPARATE + """ select urn, year, row_number() over (order by coalesce(year::varchar, '') desc, urn desc) - 1 as place from k where n = 1 and track = 'vigente'""")
def _(t):
    where = f"{shared_dir(t.spark)}/tracks-{uuid.uuid4().hex}"
    files.write_tracks(_separated(t).select("urn", "year", "track", "status"), where)
    return files.read_track(t.spark, where, "vigente", "urn string, year int").select("urn", "year", "place")


@register("c12_track_manifest", SEPARATE + """ select count(*) filter (where track = 'vigente') as vigente_count, count(*) filter (where track = 'abrogated') as abrogated_count, count(*) filter (where moved and track = 'abrogated') as moved_to_abrogated,
 count(*) filter (where moved and track = 'vigente') as moved_to_vigente from k where n = 1""")
def _(t):
    return c.track_manifest(_separated(t))


@register("c13_capture_snapshot", f"select 7 as snapshot_id, urn, lower(coalesce(status, '')) as status, {TRACK} as track from v_laws")
def _(t):
    return c.capture_snapshot(t.laws, 7).select("snapshot_id", "urn", "status", "track")


SNAP = "s as (select snapshot_id, urn, status, source_collection as track from v_snapshot), p as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as before from (select distinct snapshot_id from s)), tr as (select n.snapshot_id, n.urn, o.status as from_status, n.status as to_status, o.track as from_track, n.track as to_track from s n join p on p.snapshot_id = n.snapshot_id join s o on o.snapshot_id = p.before and o.urn = n.urn where coalesce(o.status, '') <> coalesce(n.status, '') or coalesce(o.track, '') <> coalesce(n.track, ''))"


def _snap(t):
    return t.snapshot.withColumnRenamed("source_collection", "track")


@register("c14_transitions", f"with {SNAP} select * from tr")
def _(t):
    return c.transitions(_snap(t))


@register("c15_recent_snapshots", "select snapshot_id, count(*) as acts from v_snapshot group by 1 order by 1 desc limit 50")
def _(t):
    return c.recent_snapshots(_snap(t))


@register("c15_latest_transitions", f"with {SNAP} select * from tr order by snapshot_id desc, urn limit 100")
def _(t):
    return c.latest_transitions(c.transitions(_snap(t)))


@register("c15_transition_counts", f"with {SNAP} select snapshot_id, count(*) as n from tr group by 1")
def _(t):
    return c.transition_counts(c.transitions(_snap(t)))


@register("c16_compare", """with a as (select urn from v_new where urn not in (select urn from v_old)), u as (select n.urn from v_new n join v_old o on o.urn = n.urn where n.text_length is distinct from o.text_length or n.title is distinct from o.title)
 select (select count(*) from a) as added, (select string_agg(urn, ',' order by urn) from (select urn from a order by urn limit 100)) as added_sample, (select count(*) from u) as updated,
 (select string_agg(urn, ',' order by urn) from (select urn from u order by urn limit 50)) as updated_sample, (select count(*) from v_citations where cnt = 1) - (select count(*) from v_citations) as citation_delta""")
def _(t):
    row = c.compare(t.old, t.new, t.citations, t.citations.filter("cnt = 1"))
    return row.withColumns({x: F.array_join(x, ",") for x in ("added_sample", "updated_sample")})


@register("c17_insert_ignore", "select urn, text_length, article_count, title from v_old union all select urn, text_length, article_count, title from v_new where urn not in (select urn from v_old)")
def _(t):
    return c.insert_ignore(t.old, t.new.union(t.new), "urn", ("text_length",))


@register("c18_upsert_laws", f"""with n as (select l.urn, l.year, coalesce(nullif(l.status, ''), 'in_force') as status, {LEG} as legislature, {GOV} as government, {ERA} as era from v_laws l where article_count < 5)
 select urn, year, status, null as legislature, null as government, null as era from v_laws where urn not in (select urn from n) union all select * from n""")
def _(t):
    cols = t.laws.select("urn", "year", "status")
    return c.upsert_laws(cols, cols.join(t.laws.filter("article_count < 5").select("urn"), "urn", "left_semi"))


@register("c19_update_columns", "select l.urn, l.year, case when m.urn is not null and m.domain_cluster is not null then m.domain_cluster else l.type end as type from v_laws l left join v_meta m on m.urn = l.urn")
def _(t):
    return c.update_columns(t.laws.select("urn", "year", "type"), t.meta.select("urn", F.col("domain_cluster").alias("type")))
