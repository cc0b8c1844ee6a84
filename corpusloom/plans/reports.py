"""Report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import counters, mining
from corpusloom.operators import reports as r
from corpusloom.plans.mining import STATUS, TRACK, WORDS, _labels
from corpusloom.sources.tables import shared_dir


@register("r01_totals", "select (select count(*) from v_laws) as acts, (select count(*) from v_citations) as citations, (select count(*) from v_amendments) as amendments")
def _(t):
    return r.one_row(t.spark, acts=t.laws, citations=t.citations, amendments=t.amendments)


@register("r02_by_type", "select coalesce(nullif(type, ''), 'unknown') as type, count(*) as n from v_laws group by 1")
def _(t):
    return r.by_type(t.laws)


@register("r03_by_year", "select year, count(*) as n from v_laws where year > 0 group by 1")
def _(t):
    return r.by_year(t.laws)


@register("r03_last_years", "select year, count(*) as n from v_laws where year > 0 group by 1 order by 1 desc limit 10")
def _(t):
    return r.by_year(t.laws, 10)


@register("r04_temporal_distribution", """with y as (select try_cast(substring(date, 1, 4) as int) as y from v_chains) select 'decade' as level, y // 10 * 10 as decade, count(*) as acts, min(y) as earliest, max(y) as latest from y where y is not null group by 2
 union all select 'all', null, count(*), min(y), max(y) from y where y is not null""")
def _(t):
    return r.temporal_distribution(t.chains.withColumn("published_date", F.lit("")), "published_date", "date")


@register("r05_by_domain", "select domain_cluster, count(*) as n from v_meta where domain_cluster is not null and domain_cluster <> '' group by 1")
def _(t):
    return r.by_domain(t.meta)


@register("r06_text_stats", "select round(avg(text_length)) as avg_length, sum(text_length)::bigint as total_length, round(avg(article_count), 1) as avg_articles, sum(article_count)::bigint as total_articles from v_laws")
def _(t):
    return r.text_stats(t.laws)


@register("r07_length_stats", """with x as (select 'text' as field, length(text) as n from v_laws union all select 'title', length(title) from v_laws), s as (select field, n, row_number() over (partition by field order by n) - 1 as i, count(*) over (partition by field) as c from x where n > 0)
 select field, max(c) as n, min(n) as least, max(n) as most, round(avg(n), 6) as mean, max(case when i = c // 2 then n end) as median from s group by 1""")
def _(t):
    return r.length_stats(t.laws)


@register("r08_coverage", """with c as (select count(*) as a, count(*) filter (where urn is not null) as n1, count(*) filter (where text <> '') as n2, count(*) filter (where status is not null) as n3, count(*) filter (where year > 2000) as n4 from v_laws)
 select unnest(['id', 'text', 'status', 'recent']) as rule, unnest([n1, n2, n3, n4]) as n, round(unnest([n1, n2, n3, n4]) * 100 / a, 2) as percent from c""")
def _(t):
    return r.coverage(t.laws, {"id": F.col("urn").isNotNull(), "text": F.col("text") != "", "status": F.col("status").isNotNull(), "recent": F.col("year") > 2000})


@register("r09_serialized_mb", """select round(sum(octet_length(encode('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}')) + 1) / 1048576, 6) as mb from documents""")
def _(t):
    return r.serialized_mb(t.documents.select("doc_id", "lang", "source"))


@register("r10_by_status", "select status, count(*) as n from v_laws group by 1")
def _(t):
    return r.counted(t.laws, "status")


@register("r10_by_source", "select source_collection, count(*) as n from v_laws group by 1 order by 2 desc, 1 limit 10")
def _(t):
    return r.counted(t.laws, "source_collection", 10)


@register("r11_dashboard", f"""select count(*) as acts, count(distinct type) as types, min(year) as min_year, max(year) as max_year, sum(article_count)::bigint as articles, count(*) filter (where {STATUS} = 'in_force') as in_force,
 count(*) filter (where {STATUS} = 'abrogated') as abrogated, count(*) filter (where importance_score > 0) as scored from v_laws""")
def _(t):
    return r.dashboard(t.laws)


REG = f"reg as (select urn, title, year, {STATUS} as status, unnest({_labels('lower(text)')}) as label from v_laws)"


def _reg(t):
    return mining.fiscal_registry(t.laws, WORDS)[1]


@register("r12_label_by_status", f"with {REG} select label, status, count(*) as n from reg group by 1, 2")
def _(t):
    return r.label_by_status(_reg(t))


@register("r13_label_registry", f"with {REG} select label, count(distinct urn) as acts, count(*) as mentions from reg group by 1")
def _(t):
    return r.label_registry(_reg(t))


@register("r13_registry_overview", f"with {REG} select count(*) as rows, count(distinct urn) as acts, count(distinct label) as labels from reg")
def _(t):
    return r.registry_overview(_reg(t))


@register("r14_registry_view", f"with {REG} select urn, title, year, label, status from reg where label = 'places' and status = 'in_force'")
def _(t):
    return r.registry_view(_reg(t), "places", "in_force")


@register("r15_label_notes", f"with {REG} select distinct label, case label when 'places' then 'where' else 'No note.' end as note from reg")
def _(t):
    return r.label_notes(_reg(t), {"places": "where", "other": "x"})


@register("r16_track_counts", f"select {TRACK} as track, count(*) as n from v_laws group by 1")
def _(t):
    return r.track_counts(t.laws)


@register("r16_track_view", f"select urn, title, year from v_laws where {TRACK} = 'abrogato' order by year desc nulls last, urn limit 200")
def _(t):
    return r.track_view(t.laws, "abrogato")


CTRACK = "case when contains(lower(collection), 'abrogat') and variant = 'O' then 'abrogato' when variant = 'M' then 'multivigente' when variant = 'V' then 'vigente' end"


@register("r17_catalogue_tracks", f"select {CTRACK} as track, sum(acts)::bigint as acts, max(created) as latest from v_catalogue where {CTRACK} is not null group by 1")
def _(t):
    return r.catalogue_tracks(t.catalogue)


@register("r18_coverage_gap", f"""with g as (select track, (select count(*) from v_laws where {TRACK} = track) as local, coalesce((select sum(acts)::bigint from v_catalogue where {CTRACK} = track), 0) as remote from (values ('vigente'), ('multivigente'), ('abrogato')) x(track))
 select track, local, remote, remote - local as delta, (sum(greatest(remote - local, 0)) over ())::bigint as total_gap from g""")
def _(t):
    return r.coverage_gap(t.laws, t.catalogue)


@register("r19_variant_matrix", """with m as (select collection, bool_or(variant = 'O') as has_o, bool_or(variant = 'V') as has_v, bool_or(variant = 'M') as has_m, sum(acts)::bigint as acts from v_variants group by 1)
 select *, has_o and has_v and has_m as all_three, has_v and not has_o and not has_m as only_v from m""")
def _(t):
    return r.variant_matrix(t.variants)


@register("r20_collections_with", "select collection, array_to_string(list_sort(list(distinct variant)), ',') as variants from v_variants group by 1 having bool_or(variant in ('M', 'O'))")
def _(t):
    return r.collections_with(t.variants, ["M", "O"]).withColumn("variants", F.array_join("variants", ","))


NAMED = "select concat(case when c_custkey % 4 = 0 then 'Multivigente ' when c_custkey % 4 = 1 then 'Atti abrogati ' when c_custkey % 4 = 2 then 'Vigenti ' else 'Codici ' end, c_name) as collection, c_nationkey as acts from customer"


@register("r21_catalogue_scan", f"with n as ({NAMED}) select collection, acts, case when contains(lower(collection), 'multivigent') then 'multivigente' when contains(lower(collection), 'abrog') then 'abrogato' else 'vigente' end as key from n where regexp_matches(lower(collection), 'vigent|abrog')")
def _(t):
    return r.catalogue_scan(t.spark.sql(NAMED.replace("from customer", "from {c}"), c=t.base("customer")))


@register("r22_history_gap", """with g as (select coalesce(case when year % 3 = 0 then 'Codici' end, case when year % 3 = 1 then type end, 'Varie') as collection, count(*) as acts from v_laws group by 1), q as (select collection, acts, case collection when 'Codici' then 41.17::double else 2.0::double end as ratio from g)
 select collection, acts, ratio, trunc(acts * ratio)::bigint as expected, trunc(acts * (ratio - 1))::bigint as additional from q""")
def _(t):
    laws = t.laws.withColumn("collection", F.when(F.col("year") % 3 == 0, "Codici")).withColumn("type", F.when(F.col("year") % 3 == 1, F.col("type")))
    return r.history_gap(laws)


@register("r23_budget_select", """with recursive i as (select c_nationkey as grp, c_name as name, greatest(c_acctbal, 0) as size, row_number() over (partition by c_nationkey order by c_custkey) as k from customer),
 w as (select grp, name, size, k, size <= 9000 as included, case when size <= 9000 then 9000 - size else 9000 end as rest from i where k = 1
  union all select i.grp, i.name, i.size, i.k, i.size <= w.rest, case when i.size <= w.rest then w.rest - i.size else w.rest end from w join i on i.grp = w.grp and i.k = w.k + 1),
 f as (select grp, arg_max(rest, k) as remaining from w group by 1) select w.grp, round(f.remaining, 4) as remaining, w.k - 1 as pos, w.name, w.size, w.included from w join f using (grp)""")
def _(t):
    items = t.customer.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("priority"), F.col("c_name").alias("name"), F.greatest("c_acctbal", F.lit(0.0)).alias("size"))
    return r.budget_select(items, 9000).drop("reason").withColumn("remaining", F.round("remaining", 4))


SIZES = "select s_suppkey as collection, s_nationkey as v_files, s_nationkey * 3 + 1 as m_files, s_acctbal as v_mb, s_acctbal * 7 + 2 as m_mb from supplier"


@register("r24_variant_ratios", f"""with s as ({SIZES}) select collection, round(m_files / nullif(v_files, 0), 6) as file_ratio, round(m_mb / nullif(v_mb, 0), 6) as size_ratio, round(m_mb * v_files / nullif(v_mb * m_files, 0), 6) as mean_ratio,
 m_files - v_files as extra_files, round(m_mb - v_mb, 6) as extra_mb from s""")
def _(t):
    return r.variant_ratios(t.spark.sql(SIZES.replace("from supplier", "from {s}"), s=t.base("supplier")))


RUNS = "select ts as timestamp, event_id as id, user_id as laws_added, event_id % 5 as laws_updated from events"


@register("r25_changelog_summary", "select count(*) as runs, sum(user_id)::bigint as laws_added, sum(event_id % 5)::bigint as laws_updated, max(ts) as latest from events")
def _(t):
    return r.changelog_summary(t.spark.sql(RUNS.replace("from events", "from {e}"), e=t.base("events")))


@register("r25_latest_updates", "select event_id as id, user_id as laws_added from events order by ts desc, event_id limit 10")
def _(t):
    return r.latest(t.spark.sql(RUNS.replace("from events", "from {e}"), e=t.base("events")), "timestamp", 10, "id").select("id", "laws_added")


@register("r26_update_log", "select id, collection, status from v_log order by detected_at desc, id limit 50")
def _(t):
    return r.latest(t.log, "detected_at", 50, "id").select("id", "collection", "status")


@register("r27_change_summary", "select count(*) as total, count(*) filter (where status = 'pending') as pending, max(detected_at) as latest from v_log")
def _(t):
    return r.change_summary(t.log)


@register("r28_run_summary", "select count(*) as total, count(*) filter (where event_id % 4 = 0) as ok, count(*) filter (where event_id % 4 = 1) as failed, count(*) filter (where event_id % 4 > 1) as skipped from events")
def _(t):
    return r.run_summary(t.events.select(F.expr("case event_id % 4 when 0 then 'ok' when 1 then 'failed' else 'skipped' end").alias("result")))


@register("s10_metrics_document", """select 'by_type' as metric, '{' || string_agg('"' || type || '":' || n, ',' order by type) || '}' as document from (select type, count(*) as n from v_laws group by 1)""")
def _(t):
    rows = r.by_type(t.laws).select(F.lit("by_type").alias("metric"), F.col("type").alias("key"), F.col("n").alias("value"))
    return r.metrics_document(rows)


def _counters(t):
    """Acts by type, counted in four batches as they might be taken in, and merged."""
    where = f"{shared_dir(t.spark)}/counters-{uuid.uuid4().hex}"
    shape = (["type"], ["text_length", "year"], ["urn", "source_collection"])
    for k in range(4):
        counters.add_batch(t.laws.filter(F.crc32(F.encode("urn", "UTF-8")) % 4 == k), where, str(k), *shape)
    return counters.merged(counters.stored_counters(t.spark, where), *shape)


@register("r11_merged_counters", "select type, count(*) as acts, sum(text_length)::double as text_length, min(year) as first_year, max(year) as last_year, true as near from v_laws group by type")
def _(t):
    """Counts and sums equal those over all acts; the distinct urns are within 3 %, four standard errors."""
    near = F.abs(F.col("urn_about_distinct") - F.col("n")) <= 0.03 * F.col("n") + 1
    return _counters(t).select("type", F.col("n").alias("acts"), F.col("text_length_sum").alias("text_length"), F.col("year_min").alias("first_year"), F.col("year_max").alias("last_year"), near.alias("near"))
