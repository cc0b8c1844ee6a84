"""Amendment and time queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import amendments as am
from corpusloom.operators import intervals
from corpusloom.plans.mining import GOV, LEG

NOW = dt.datetime(2024, 1, 31)


def _chained(t):
    return t.chains.withColumn("modifies", am.modified_ids(F.col("modifies_one"), F.split("modifies_list", ",")))


@register("a01_upsert_amendments", """with n as (select urn, amending_urn, action, seq, concat('2026', substring(date_effective, 5)) as date_effective, 1 as z from v_amendments), b as (select urn, amending_urn, concat(action, ':old') as action, seq, date_effective, 0 as z from v_amendments union all select urn, amending_urn, action, seq, date_effective, 0 as z from v_amendments),
 r as (select *, row_number() over (partition by urn, amending_urn, action order by z desc, seq desc) as n from (select * from n union all select * from b)) select urn, amending_urn, action, seq, date_effective from r where n = 1""")
def _(t):
    old = t.amendments.withColumn("action", F.concat("action", F.lit(":old"))).unionByName(t.amendments)
    new = t.amendments.withColumn("date_effective", F.concat(F.lit("2026"), F.expr("substring(date_effective, 5)")))
    return am.upsert_amendments(old, new).select("urn", "amending_urn", "action", "seq", "date_effective")


def _base_and_new(t):
    """All amendments, and all of them with a later date: those of even seq under the same key, the others under a new one."""
    key = F.when(F.col("seq") % 2 == 0, F.col("amending_urn")).otherwise(F.concat("amending_urn", F.lit(":bis")))
    return t.amendments, t.amendments.withColumns({"amending_urn": key, "date_effective": F.concat(F.lit("2025"), F.expr("substring(date_effective, 5)"))})


@register("a01_upsert_all_amendments", """with n as (select urn, case when seq % 2 = 0 then amending_urn else concat(amending_urn, ':bis') end as amending_urn, action, seq, concat('2025', substring(date_effective, 5)) as date_effective, 1 as z from v_amendments),
 b as (select urn, amending_urn, action, seq, date_effective, 0 as z from v_amendments), r as (select *, row_number() over (partition by urn, amending_urn, action order by z desc, seq desc) as n
 from (select * from n union all select * from b)) select urn, amending_urn, action, seq, date_effective from r where n = 1""")
def _(t):
    return am.upsert_amendments(*_base_and_new(t)).select("urn", "amending_urn", "action", "seq", "date_effective")


@register("a02_timeline", "select a.date_effective, a.amending_urn, a.action, l.title as amending_title, a.seq from v_amendments a left join v_laws l on l.urn = a.amending_urn where a.urn = 'doc:7'")
def _(t):
    return am.timeline(t.amendments, t.laws, "doc:7")


@register("a03_most_amended", """select a.urn, count(*) as amendments, min(a.date_effective) as first_date, max(a.date_effective) as last_date, l.title from v_amendments a join v_laws l on l.urn = a.urn group by a.urn, l.title order by 2 desc, 1 limit 30""")
def _(t):
    return am.most_amended(t.amendments, t.laws)


@register("a04_recent_amendments", """with k as (select * from v_amendments where detected_at >= timestamp '2024-01-31' - interval 10 days order by detected_at desc, seq limit 50)
 select k.seq, k.urn, l.title, k.amending_urn, m.title as amending_title, k.action from k left join v_laws l on l.urn = k.urn left join v_laws m on m.urn = k.amending_urn""")
def _(t):
    return am.recent_amendments(t.amendments, t.laws, NOW, days=10).drop("detected_at")


@register("a05_recent_log", "select id, collection, status from v_log where detected_at >= timestamp '2024-01-20' - interval 36 hours")
def _(t):
    return am.recent_log(t.log, dt.datetime(2024, 1, 20), hours=36).select("id", "collection", "status")


EACH = "e as (select urn, date, unnest(case when modifies_list is not null then string_split(modifies_list, ',') when modifies_one is not null then [modifies_one] else [] end) as original from v_chains)"


@register("a06_amendment_chains", f"with {EACH} select original, string_agg(coalesce(date, '') || '=' || urn, ';' order by date nulls first, urn) as chain, count(*) as n from e group by 1")
def _(t):
    line = F.transform("chain", lambda x: F.concat(F.coalesce(x["date"], F.lit("")), F.lit("="), x["law_id"]))
    return am.amendment_chains(_chained(t)).select("original", F.array_join(line, ";").alias("chain"), F.size("chain").cast("long").alias("n"))


@register("a06_amendment_parts", f"""with {EACH}, p as (select *, row_number() over (partition by original order by date nulls first, urn) - 1 as pos from e)
 select original, pos // 4 as part, string_agg(coalesce(date, '') || '=' || urn, ';' order by pos) as chain from p group by 1, 2""")
def _(t):
    line = F.transform("chain", lambda x: F.concat(F.coalesce(x["date"], F.lit("")), F.lit("="), x["law_id"]))
    return am.amendment_parts(_chained(t), part=4).select("original", "part", F.array_join(line, ";").alias("chain"))


@register("a07_with_amendments", f"with {EACH} select c.urn, (select count(*) from e where e.original = c.urn) as n_chain, case when modifies_list is not null then 2 when modifies_one is not null then 1 else 0 end as n_modifies from v_chains c")
def _(t):
    return am.with_amendments(_chained(t)).select("urn", F.size("chain").cast("long").alias("n_chain"), F.size("modifies").alias("n_modifies"))


@register("a08_chain_stats", f"with {EACH} select count(*) as acts_amended, sum(n)::bigint as amendments, round(avg(n), 6) as mean_length from (select original, count(*) as n from e group by 1)")
def _(t):
    return am.chain_stats(am.amendment_chains(_chained(t)))


@register("a09_validity", "select urn, try_cast(date as date) as valid_from, try_cast(modifies_one as date) as valid_to, try_cast(date as date) as published_date, coalesce(date < '2000', false) as is_current from v_chains")
def _(t):
    return am.validity(t.chains.withColumn("cur", F.col("date") < "2000"), "date", "modifies_one", "date", "cur")


@register("a09_state_as_of", """select a.seq, a.urn, a.detected_at::varchar as at, l.id, l.new_etag from v_amendments a asof left join v_log l on a.urn = l.law_urn and a.detected_at >= l.detected_at""")
def _(t):
    history = t.log.select(F.col("law_urn").alias("urn"), F.col("detected_at").alias("since"), "id", "new_etag")
    points = t.amendments.select("seq", "urn", "detected_at")
    return intervals.as_of(points, history, "urn", "detected_at", "since", ["id", "new_etag"]).select("seq", "urn", F.col("detected_at").cast("string").alias("at"), "id", "new_etag")


@register("a09_state_at", """select urn, arg_max(status, ts) as status from (select concat('user:', user_id) as urn, event_type as status, ts from events) where ts <= timestamp '2024-01-15 12:00:00' group by urn""")
def _(t):
    history = t.events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("urn"), F.col("event_type").alias("status"), "ts")
    return intervals.state_at(history, "urn", "ts", F.lit("2024-01-15 12:00:00").cast(history.schema["ts"].dataType), ["status"]).select("urn", "status")


@register("a10_amendment_stats", f"""with {EACH}, n as (select c.urn, (select count(*) from e where e.original = c.urn) as n, modifies_one is not null or modifies_list is not null as m from v_chains c)
 select count(*) filter (where n > 0) as acts_amended, count(*) filter (where m) as acts_modifying, sum(n)::bigint as amendments, round(avg(case when n > 0 then n end), 6) as mean, max(n) as most from n""")
def _(t):
    return am.amendment_stats(am.with_amendments(_chained(t)))


@register("a11_legislature_trends", f"""with p as (select l.year, {LEG} as legislature, {GOV} as government from v_laws l) select legislature, array_to_string(list_sort(list(distinct year)), ',') as years, count(*) as acts,
 min_by(government, year) filter (where government is not null) as government from p group by 1""")
def _(t):
    return am.legislature_trends(t.laws).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@register("a12_by_legislature", f"with p as (select {LEG} as legislature from v_laws l) select legislature, count(*) as acts from p group by 1")
def _(t):
    return am.by_legislature(t.laws)
