"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import validation as v


@register("v01_dup_keys", "select law_urn, count(*) as n from v_log group by 1 having count(*) > 1")
def _(t):
    return v.dup_keys(t.log, "law_urn")


@register("v02_empty_count", "select count(*) filter (where coalesce(title, '') = '') as empty_title, count(*) filter (where coalesce(text, '') = '') as empty_text, count(*) filter (where coalesce(status, '') = '') as empty_status from v_laws")
def _(t):
    return v.empty_count(t.laws, "title", "text", "status")


@register("v03_bad_years", "select count(*) filter (where year + 20 < 1800 or year + 20 > 2030) as bad_years from v_laws")
def _(t):
    return v.bad_years(t.laws.withColumn("year", F.col("year") + 20))


@register("v04_validate", """with c as (select count(*) as total_laws, count(*) filter (where coalesce(title, '') = '') as empty_titles, count(*) filter (where coalesce(text, '') = '') as missing_text, count(*) filter (where year > 2030) as bad_years,
 count(*) - count(distinct urn) as duplicates, (select count(distinct cited_urn) from v_citations where cited_urn not in (select urn from v_laws)) as orphans, (select count(*) from v_citations) as total_citations from v_laws)
 select *, duplicates = 0 and empty_titles = 0 and missing_text = 0 and bad_years = 0 as passed from c""")
def _(t):
    return v.validate(t.laws, t.citations).drop("issues", "no_duplicates", "no_empty_titles", "no_bad_years", "no_missing_text")


@register("v05_extra_checks", """with c as (select count(*) filter (where urn is null) as a, count(*) filter (where coalesce(title, '') = '') as b, count(*) filter (where coalesce(length(text), 0) < 10) as c, count(*) filter (where year is null) as d,
 (select count(*) from v_citations where cited_urn not in (select urn from v_laws)) as e, (select count(*) from v_citations) as f, (select count(*) from v_meta) as g from v_laws)
 select unnest(['no urn', 'no title', 'no text', 'no year', 'orphan citations', 'citations', 'metadata rows']) as "check", unnest([a, b, c, d, e, f, g]) as value from c""")
def _(t):
    return v.extra_checks(t.laws, t.citations, t.meta)


@register("v06_short_texts", "select urn, title, length(text) as length from v_laws where length(text) < 60")
def _(t):
    return v.short_texts(t.laws, 60)


@register("v07_presence", "select urn, urn in (select urn from v_laws) as present from (values ('doc:1'), ('doc:77'), ('doc:x')) e(urn)")
def _(t):
    return v.presence(t.laws, ["doc:1", "doc:77", "doc:x"])


@register("v08_state_counters", """select count(*) as metadata_rows, count(*) filter (where pagerank > 0) as with_pagerank, count(*) filter (where coalesce(domain_cluster, '') <> '') as with_domain, count(*) filter (where citation_count_incoming > 0) as with_citations_in,
 (select count(*) from v_laws) as acts, (select count(*) from v_citations) as edges from v_meta""")
def _(t):
    return v.state_counters(t.laws, t.citations, t.meta)
