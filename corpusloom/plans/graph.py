"""Citation-graph queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import adjacency, graph
from corpusloom.sources.tables import shared_dir

ONE = "doc:7"


def store(t) -> adjacency.Adjacency:
    """A new adjacency of the tables' graph. Every look-up builds what it opens, so it neither depends on the session's earlier queries nor sees older tables."""
    return adjacency.build_adjacency(t.laws, t.citations, f"{shared_dir(t.spark)}/adjacency-{uuid.uuid4().hex}")


@register("g02_outgoing", f"""select c.cited_urn, l.title, c.cnt from v_citations c left join v_laws l on l.urn = c.cited_urn
 where c.citing_urn = '{ONE}' order by c.cnt desc, c.cited_urn limit 20""")
def _(t):
    return adjacency.outgoing(store(t), ONE, 20)


INCOMING = f"""select c.citing_urn, l.title, c.cnt from v_citations c left join v_laws l on l.urn = c.citing_urn
 where c.cited_urn = '{ONE}' order by c.cnt desc, c.citing_urn limit 20"""


@register("g03_incoming", INCOMING)
def _(t):
    return adjacency.incoming(store(t), ONE, 20)


@register("g03_incoming_scan", INCOMING)
def _(t):
    return graph.incoming(t.citations, t.laws, ONE, 20)


@register("g04_most_cited", """select l.urn, l.title, l.type, l.year, count(*) as citation_count from v_laws l join v_citations c on c.cited_urn = l.urn
 group by l.urn, l.title, l.type, l.year order by citation_count desc, l.urn limit 50""")
def _(t):
    return graph.most_cited(t.citations, t.laws)


@register("g05_citation_counts", """select l.urn, coalesce(i.n, 0) as citations_in, coalesce(o.n, 0) as citations_out from v_laws l
 left join (select cited_urn, count(*) as n from v_citations group by 1) i on i.cited_urn = l.urn
 left join (select citing_urn, count(*) as n from v_citations group by 1) o on o.citing_urn = l.urn""")
def _(t):
    return graph.citation_counts(t.laws, t.citations)


@register("g06_citation_counts_valid", """select l.urn, m.domain_cluster, m.citation_count_incoming, m.pagerank,
 (select count(*) from v_citations c where c.cited_urn = l.urn and c.citing_urn in (select urn from v_laws)) as citations_in,
 (select count(*) from v_citations c where c.citing_urn = l.urn and c.cited_urn in (select urn from v_laws)) as citations_out
 from v_laws l left join v_meta m on m.urn = l.urn""")
def _(t):
    return graph.citation_counts_valid(t.laws, t.citations, t.meta)


@register("g07_add_missing_metadata", """select urn, domain_cluster, citation_count_incoming, pagerank from v_meta union all
 select cited_urn, null, count(*), null from v_citations where cited_urn not in (select urn from v_meta) group by cited_urn""")
def _(t):
    return graph.add_missing_metadata(t.meta, t.citations)


NEAR = f"""with f1 as (select cited_urn as urn from (select distinct cited_urn from v_citations where citing_urn = '{ONE}' order by 1 limit 20)
  union select citing_urn from (select distinct citing_urn from v_citations where cited_urn = '{ONE}' order by 1 limit 20)),
 s1 as (select '{ONE}' as urn, 0 as depth union all select urn, 1 from (select urn from f1 where urn <> '{ONE}' order by urn limit 99)),
 o2 as (select c.cited_urn as urn, row_number() over (partition by c.citing_urn order by c.cited_urn) as n from v_citations c join s1 on s1.urn = c.citing_urn and s1.depth = 1),
 i2 as (select c.citing_urn as urn, row_number() over (partition by c.cited_urn order by c.citing_urn) as n from v_citations c join s1 on s1.urn = c.cited_urn and s1.depth = 1),
 f2 as (select urn from o2 where n <= 20 union select urn from i2 where n <= 20),
 s2 as (select urn, depth from (select urn, depth from s1 union all select urn, 2 from f2 where urn not in (select urn from s1)) order by depth, urn limit 100)
 select l.urn, substring(l.title, 1, 80) as title, l.type, l.year, s2.depth, l.urn = '{ONE}' as is_center from s2 join v_laws l on l.urn = s2.urn"""


@register("g08_neighborhood", NEAR)
def _(t):
    return adjacency.neighborhood(store(t), ONE, depth=2)


@register("g08_neighborhood_scan", NEAR)
def _(t):
    return graph.neighborhood(t.citations, t.laws, ONE, depth=2)


@register("g08_reachable", f"""with recursive e as (select distinct a, b from (select citing_urn as a, cited_urn as b from v_citations union all select cited_urn, citing_urn from v_citations)),
 r(urn, depth) as (select '{ONE}', 0 union all select e.b, r.depth + 1 from r join e on e.a = r.urn where r.depth < 2) select urn, min(depth) as depth from r group by urn""")
def _(t):
    return adjacency.reachable(t.citations, ONE, 2)


def _pagerank_sql(rounds: int = 20) -> str:
    levels = ["r0 as materialized (select urn, 1.0::double / (select count(*) from nodes) as rank from nodes)"]
    for i in range(1, rounds + 1):
        levels.append(
            f"r{i} as materialized (select n.urn, 0.15::double / (select count(*) from nodes) + 0.85::double * coalesce(sum(r.rank / d.degree), 0) as rank from nodes n "
            f"left join v_citations c on c.cited_urn = n.urn left join r{i - 1} r on r.urn = c.citing_urn left join outs d on d.citing_urn = r.urn group by n.urn)"
        )
    return (
        "with nodes as materialized (select urn from v_laws where urn in (select citing_urn from v_citations union select cited_urn from v_citations)), "
        "outs as materialized (select citing_urn, count(*) as degree from v_citations group by 1), "
        + ", ".join(levels)
        + f" select urn, round(rank, 8) as pagerank, round(rank / (select max(rank) from r{rounds}) * 100, 2) as importance_score from r{rounds}"
    )


@register("g09_importance", _pagerank_sql())
def _(t):
    return graph.importance(t.laws, t.citations)


@register("g10_related", f"""select l.urn, l.title, l.type, l.year, count(*) as shared_citations from v_citations a join v_citations b on a.cited_urn = b.cited_urn and b.citing_urn <> a.citing_urn
 join v_laws l on l.urn = b.citing_urn where a.citing_urn = '{ONE}' group by 1, 2, 3, 4 order by 5 desc, 1 limit 10""")
def _(t):
    return adjacency.related(store(t), ONE)


# acts and edges with nir URNs, made from the same tables
NIR_LAWS = """select distinct concat('urn:nir:stato:', case when doc_id % 3 = 0 then 'legge' else 'decreto.legge' end, ':', cast(1950 + cast(doc_id % 70 as int) as varchar(4)),
 case when doc_id % 2 = 0 then '-03-07' else '' end, ';', cast(doc_id % 97 as varchar(4))) as urn, lang as title from documents"""
NIR_CIT = """select distinct concat('urn:nir:stato:legge:2000;', cast(o_custkey % 50 as varchar(8))) as citing_urn, concat('urn:nir:stato:',
 case when o_orderkey % 4 = 0 then 'legge' else 'decreto.legge' end, ':', cast(1950 + cast(o_orderkey % 90 as int) as varchar(4)), case when o_orderkey % 5 = 0 then '-03-07' else '' end, ';',
 cast(o_orderkey % 97 as varchar(4))) as cited_urn from orders"""
PARTS = """split_part({0}, ':', 4) as kind, substring(split_part(split_part({0}, ':', 5), ';', 1), 1, 4) as year, split_part(split_part({0}, ':', 5), ';', 2) as number"""


def _nir(t):
    laws = t.spark.sql(NIR_LAWS.replace("from documents", "from {d}"), d=t.base("documents"))
    cit = t.spark.sql(NIR_CIT.replace("from orders", "from {o}"), o=t.base("orders"))
    return laws, cit


INDEX_SQL = f"ix as (select kind, year, number, min(urn) as actual_urn from (select urn, {PARTS.format('urn')} from nl where urn like 'urn:nir:%;%') group by 1, 2, 3)"


@register("g11_resolution_index", f"with nl as ({NIR_LAWS}), {INDEX_SQL} select * from ix")
def _(t):
    return graph.resolution_index(_nir(t)[0])


RESOLVE_SQL = f"""with nl as ({NIR_LAWS}), nc as ({NIR_CIT}), {INDEX_SQL},
 p as (select citing_urn, cited_urn, {PARTS.format('cited_urn')}, cited_urn in (select urn from nl) as known from nc),
 r as (select p.citing_urn, p.cited_urn as was, case when known then p.cited_urn else coalesce(ix.actual_urn, p.cited_urn) end as cited_urn, known or ix.actual_urn is not null as resolved
  from p left join ix using (kind, year, number)),
 k as (select *, row_number() over (partition by citing_urn, cited_urn order by (was <> cited_urn), was) as n from r)"""


@register("g12_resolve", RESOLVE_SQL + " select citing_urn, cited_urn, resolved from k where n = 1")
def _(t):
    laws, cit = _nir(t)
    return graph.resolve(cit, laws)


@register("g12_resolve_stats", RESOLVE_SQL + " select count(*) as edges, count(*) filter (where resolved) as resolved, count(*) filter (where not resolved) as unresolved from k where n = 1")
def _(t):
    laws, cit = _nir(t)
    return graph.resolve_stats(graph.resolve(cit, laws))


@register("g12b_resolve_loose", f"""with nl as ({NIR_LAWS}), nc as ({NIR_CIT}), m as (select distinct cited_urn, {PARTS.format('cited_urn')} from nc where cited_urn not in (select urn from nl)),
 c as (select m.cited_urn, nl.urn as candidate, row_number() over (partition by m.cited_urn order by nl.urn) as n from m join nl on contains(nl.urn, m.kind) and contains(nl.urn, m.year) and nl.urn like '%;' || m.number)
 select cited_urn, candidate, n from c where n <= 3""")
def _(t):
    laws, cit = _nir(t)
    return graph.resolve_loose(cit, laws)


@register("g13_valid_edges", """select (select count(*) from v_citations where cited_urn in (select urn from v_laws) and citing_urn in (select urn from v_laws)) as both_known,
 (select count(*) from v_citations where cited_urn in (select urn from v_laws)) as cited_known""")
def _(t):
    one = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    return t.spark.range(1).select(one(graph.valid_edges(t.citations, t.laws)).alias("both_known"), one(graph.valid_edges(t.citations, t.laws, both=False)).alias("cited_known"))


@register("g14_orphans", "select count(distinct cited_urn) as orphans from v_citations where cited_urn not in (select urn from v_laws)")
def _(t):
    return graph.orphans(t.citations, t.laws)


@register("g15_missing_by_prefix", """select case when contains(u, '-') then split_part(u, '-', 1) else substring(u, 1, 4) end as prefix, count(*) as n
 from (select distinct replace(cited_urn, 'doc:10', 'doc-10') as u from v_citations) where u not in (select urn from v_laws) group by 1 order by 2 desc, 1 limit 10""")
def _(t):
    cit = t.citations.withColumn("cited_urn", F.replace("cited_urn", F.lit("doc:10"), F.lit("doc-10")))
    return graph.missing_by_prefix(cit, t.laws)


@register("g16_high_degree", "select cited_urn as urn, count(*) as in_degree from v_citations group by 1 order by 2 desc, 1 limit 50")
def _(t):
    return graph.high_degree(t.citations)


@register("g17_graph_briefing", """with h as (select cited_urn as urn, count(*) as n from v_citations group by 1 order by 2 desc, 1 limit 15)
 select '# KEY AUTHORITIES' || chr(10) || chr(10) || 'The acts cited most in the corpus:' || chr(10) || chr(10) ||
 string_agg('- **' || h.urn || '**: ' || coalesce(l.title, h.urn) || chr(10) || '  (Referenced in ' || n || ' laws in dataset)' || chr(10), chr(10) order by n desc, h.urn) as briefing
 from h left join v_laws l on l.urn = h.urn""")
def _(t):
    return graph.graph_briefing(t.citations, t.laws)


@register("g18_graph_stats", """select (select count(*) from v_laws) as acts, (select count(distinct citing_urn) from v_citations) as acts_with_citations, (select count(*) from v_citations) as edges,
 (select count(*) from (select urn from v_laws union select citing_urn from v_citations union select cited_urn from v_citations)) as nodes""")
def _(t):
    return graph.graph_stats(t.citations, t.laws)


@register("g19_citation_stats", """select sum(n)::bigint as total, round(avg(n), 6) as mean, max(n) as largest, min(n) as smallest, count(*) filter (where n = 0) as none, count(*) filter (where n > 50) as over_50
 from (select l.urn, count(c.citing_urn) as n from v_laws l left join v_citations c on c.citing_urn = l.urn group by 1)""")
def _(t):
    return graph.citation_stats(t.laws, t.citations)


@register("g20_cross_domain", """select a.domain_cluster as from_domain, b.domain_cluster as to_domain, count(*) as n from v_citations c join v_meta a on a.urn = c.citing_urn and a.domain_cluster is not null
 join v_meta b on b.urn = c.cited_urn and b.domain_cluster is not null group by 1, 2 order by 3 desc, 1, 2 limit 30""")
def _(t):
    return graph.cross_domain(t.citations, t.meta)


@register("g21_avg_in_degree", "select round(avg(n), 6) as avg_in_degree from (select count(*) as n from v_citations group by cited_urn)")
def _(t):
    return graph.avg_in_degree(t.citations)


def _nested(t):
    one = F.struct(F.col("cited_urn").alias("target_urn"), F.lit(None).cast("string").alias("cited_urn"), F.col("context").alias("ref"), F.when(F.col("cnt") > 1, F.col("cnt").cast("string")).alias("article"))
    return t.citations.groupBy(F.col("citing_urn").alias("urn")).agg(F.array_sort(F.collect_list(one)).alias("citations"))


@register("g01_build_edges", """select citing_urn, cited_urn, cast(1 as bigint) as count, cast(1 as bigint) as mentions,
 case when cnt > 1 then 'art. ' || cnt || ' | ' || context else context end as context from v_citations""")
def _(t):
    return graph.build_edges(_nested(t))


@register("g22_cited_from_records", "select cited_urn as urn, count(*) as n from v_citations group by 1 order by 2 desc, 1 limit 20")
def _(t):
    return graph.cited_from_records(_nested(t))


@register("g23_citing_by_importance", f"""select l.urn, l.title, l.importance_score, (select count(*) from v_citations where cited_urn = '{ONE}') as citing_total
 from v_citations c join v_laws l on l.urn = c.citing_urn where c.cited_urn = '{ONE}' order by l.importance_score desc, l.urn limit 20""")
def _(t):
    return adjacency.citing_by_importance(store(t), ONE)


@register("g24_most_cited_stored", """select m.urn, l.title, l.year, m.citation_count_incoming from v_meta m join v_laws l on l.urn = m.urn where m.citation_count_incoming > 0
 order by m.citation_count_incoming desc, m.urn limit 25""")
def _(t):
    return graph.most_cited_stored(t.meta, t.laws)


@register("s08_adjacency_index", """with o as (select citing_urn as urn, list_sort(list(distinct cited_urn)) as x from v_citations group by 1), i as (select cited_urn as urn, list_sort(list(distinct citing_urn)) as x from v_citations group by 1)
 select coalesce(o.urn, i.urn) as urn, array_to_string(coalesce(o.x, []), ',') as outgoing, array_to_string(coalesce(i.x, []), ',') as incoming from o full join i on o.urn = i.urn""")
def _(t):
    return graph.adjacency_index(t.citations).select("urn", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


@register("s08_adjacency_parts", "select citing_urn as urn, 'outgoing' as side, cited_urn as id from v_citations union select cited_urn, 'incoming', citing_urn from v_citations")
def _(t):
    return graph.adjacency_parts(t.citations, part=20).select("urn", "side", F.explode("ids").alias("id"))


@register("s08_adjacency_store", """select c.citing_urn as urn, 'out' as side, c.cited_urn as other, c.cnt, l.urn is not null as known, l.title from v_citations c left join v_laws l on l.urn = c.cited_urn
 union all select c.cited_urn, 'in', c.citing_urn, c.cnt, l.urn is not null, l.title from v_citations c left join v_laws l on l.urn = c.citing_urn""")
def _(t):
    made = store(t)
    sides = [rows.select("urn", F.lit(side).alias("side"), "other", "cnt") for rows, side in ((made.out, "out"), (made.into, "in"))]
    return made.shown(sides[0].unionByName(sides[1]), few=False).select("urn", "side", "other", "cnt", "known", "title")


NODES_SQL = "nodes as (select l.urn as id, l.title, l.type, l.year, c.size from v_laws l join (select cited_urn, count(*) as size from v_citations group by 1) c on c.cited_urn = l.urn where c.size >= 2)"


@register("s06_graph_nodes", f"with {NODES_SQL} select * from nodes")
def _(t):
    return graph.graph_nodes(t.laws, t.citations)


@register("s06_graph_edges", f"with {NODES_SQL} select citing_urn as source, cited_urn as target from v_citations where citing_urn in (select id from nodes) and cited_urn in (select id from nodes)")
def _(t):
    return graph.graph_edges(graph.graph_nodes(t.laws, t.citations), t.citations).select("source", "target")
