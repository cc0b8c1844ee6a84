"""The corpus model on the test tables: views whose SQL text runs unchanged in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpusloom.shipping import ship

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
N_DOCS = "(select count(*) from documents)"

VIEWS = {
    "v_laws": """select concat('doc:', cast(doc_id as varchar(20))) as urn, substring(split_part(text, chr(10), 1), 1, 80) as title, lang as type,
        1940 + cast(doc_id % 90 as int) as year, text, n_chars as text_length, cast(doc_id % 25 as int) as article_count,
        case doc_id % 7 when 0 then 'abrogato' when 1 then 'Vigente' when 2 then 'in_force' when 3 then ' A ' when 4 then null else 'in_force' end as status,
        source as source_collection, concat(cast(1940 + cast(doc_id % 90 as int) as varchar(4)), '-03-07') as date,
        cast((doc_id * 7919) % 10001 as double) / 100 as importance_score from documents""",
    "v_citations": f"""select citing_urn, cited_urn, count(*) as cnt, min(ctx) as context from (
        select concat('doc:', cast(l_orderkey % ({N_DOCS} + 100) as varchar(20))) as citing_urn,
        concat('doc:', cast(l_partkey % ({N_DOCS} + 50) as varchar(20))) as cited_urn, l_returnflag as ctx
        from lineitem) e group by citing_urn, cited_urn""",
    "v_meta": """select concat('doc:', cast(doc_id as varchar(20))) as urn, case doc_id % 6 when 0 then null when 1 then '' when 2 then 'diritto_civile'
        when 3 then 'diritto_penale' when 4 then 'trasporti' else 'diritto_europeo' end as domain_cluster, cast(doc_id % 13 as bigint) as citation_count_incoming,
        cast((doc_id * 31) % 1000 as double) / 1000 as pagerank from documents where doc_id % 11 <> 5""",
    "v_amendments": f"""select concat('doc:', cast(user_id % {N_DOCS} as varchar(20))) as urn, concat('doc:', cast((event_id * 7) % {N_DOCS} as varchar(20))) as amending_urn,
        event_type as action, substring(cast(ts as varchar(40)), 1, 10) as date_effective, ts as detected_at, props as change_description, event_id as seq from events""",
    "v_snapshot": """select snapshot_id, urn, status, source_collection from (select cast(1 + floor((day(ts) - 1) / 7) as int) as snapshot_id, concat('user:', cast(user_id as varchar(20))) as urn,
        event_type as status, case when event_id % 3 = 0 then 'multivigente' else 'codici' end as source_collection,
        row_number() over (partition by cast(1 + floor((day(ts) - 1) / 7) as int), user_id order by ts desc, event_id desc) as rn from events) s where rn = 1""",
    "v_catalogue": """select n.n_name as collection, case n.n_nationkey % 3 when 0 then 'O' when 1 then 'V' else 'M' end as variant, count(c.c_custkey) as acts,
        concat('2024-01-', cast(10 + n.n_nationkey as varchar(2))) as created
        from nation n left join customer c on c.c_nationkey = n.n_nationkey group by n.n_name, n.n_nationkey""",
    "v_variants": """select concat('coll', cast(c_nationkey as varchar(4))) as collection, case c_custkey % 3 when 0 then 'O' when 1 then 'V' else 'M' end as variant, count(*) as acts
        from customer where c_nationkey % 4 <> 1 or c_custkey % 3 = 1 group by 1, 2""",
    "v_old": """select concat('doc:', cast(doc_id as varchar(20))) as urn, n_chars as text_length, cast(doc_id % 25 as int) as article_count, lang as title from documents where doc_id % 10 <> 3""",
    "v_new": """select concat('doc:', cast(doc_id as varchar(20))) as urn, n_chars + case when doc_id % 5 = 0 then 1 else 0 end as text_length, cast(doc_id % 25 as int) as article_count,
        lang as title from documents where doc_id % 10 <> 7""",
    "v_log": """select event_id as id, concat('coll', cast(user_id % 20 as varchar(4))) as collection, case when event_id % 4 = 0 then null else concat('e', cast(event_id % 9 as varchar(4))) end as old_etag,
        concat('e', cast(event_id % 7 as varchar(4))) as new_etag, ts as detected_at, case when event_type = 'click' then 'pending' else 'processed' end as status, props as preview_data,
        concat('doc:', cast(event_id % 500 as varchar(20))) as law_urn, event_type as action from events""",
    "v_tags_old": """select concat('coll', cast(c_nationkey as varchar(4))) as collection, concat('t', cast(max(c_custkey) % 5 as varchar(4))) as tag from customer where c_nationkey % 5 <> 2 group by 1""",
    "v_tags_new": """select concat('coll', cast(c_nationkey as varchar(4))) as collection, case when c_nationkey % 7 = 3 then null else concat('t', cast(min(c_custkey) % 5 as varchar(4))) end as tag,
        count(*) as acts from customer where c_nationkey % 6 <> 4 group by c_nationkey""",
    "v_chains": """select concat('doc:', cast(doc_id as varchar(20))) as urn, case when doc_id % 4 = 1 then concat('doc:', cast(doc_id % 50 as varchar(20))) end as modifies_one,
        case when doc_id % 4 = 2 then concat('doc:', cast(doc_id % 40 as varchar(20)), ',doc:', cast(doc_id % 30 as varchar(20))) end as modifies_list,
        case when doc_id % 9 = 0 then null else concat(cast(1990 + cast(doc_id % 30 as int) as varchar(4)), '-0', cast(1 + doc_id % 9 as varchar(1)), '-15') end as date,
        lang as type, source as title from documents""",
}


def _needed(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions."""
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in _needed(sql))
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Tables:
    """Base tables and views of one directory, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        named = {t: self.base(t) for t in BASE if re.search(rf"\bfrom {t}\b|\bjoin {t}\b", sql)}
        for t in named:
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **named)

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in VIEWS:
            return self.view(f"v_{name}")
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)


def values(rows: list[tuple], columns: str, name: str = "d") -> str:
    """A SQL VALUES table of constants."""
    quoted = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") {name}({columns})"
