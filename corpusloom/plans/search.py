"""Search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.functions import text as fx
from corpusloom.operators import search, trigrams
from corpusloom.plans.graph import store
from corpusloom.plans.mining import LEG, STATUS
from corpusloom.sources.tables import shared_dir

TOKENS = r"regexp_extract_all(lower(strip_accents(concat_ws(' ', coalesce(title, ''), coalesce(type, ''), coalesce(text, '')))), '[\p{L}\p{N}]+')"


def ranked_sql(terms: list[str]) -> str:
    """CTEs d, s and hits (every column of v_laws, and score)."""
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(terms))
    n = ", ".join(f"count(*) filter (where tf{i} > 0) as n{i}" for i in range(len(terms)))
    part = lambda i: f"greatest_idf(n{i}, total) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))"
    idf = lambda i: f"(case when ln((total - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6 else ln((total - n{i} + 0.5) / (n{i} + 0.5)) end)"
    score = " + ".join(part(i).replace(f"greatest_idf(n{i}, total)", idf(i)) for i in range(len(terms)))
    every = " and ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""d as (select *, len(tk) as length, {tf} from (select *, {TOKENS} as tk from v_laws)), s as (select count(*) as total, avg(length) as mean, {n} from d),
 hits as (select d.*, round(({score})::double, 6) as score from d, s where {every})"""



TERMS = search.query_terms("der die")


def index(t) -> search.Index:
    """A new index of the acts. Every search builds what it opens, so it neither depends on the session's earlier queries nor sees older tables."""
    return search.build_index(t.laws, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}")


@register("q02_build_index", f"with d as (select urn, {TOKENS} as tk from v_laws), p as (select urn, unnest(tk) as term from d) select (select count(*) from d) as acts, count(distinct (urn, term)) as postings, count(*) as tokens, count(distinct term) as terms from p")
def _(t):
    built = index(t)
    counts = built.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.count_distinct("term").alias("terms"))
    return counts.select(F.lit(built.total).cast("long").alias("acts"), "postings", "tokens", "terms")


@register("q01_query_terms", r"""with w as (select urn, list_filter(regexp_extract_all(lower(strip_accents(replace(title, ' ', '_ '))), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) as r from v_laws),
 p as (select urn, list_filter(flatten(list_transform(r, lambda x: string_split(x, '_'))), lambda x: x <> '') as t from w), u as (select urn, unnest(t) as term, generate_subscripts(t, 1) as i from p),
 f as (select urn, term, min(i) as i from u group by 1, 2) select urn, string_agg(term, ' ' order by i) as terms from f group by 1""")
def _(t):
    terms = fx.query_terms(F.replace("title", F.lit(" "), F.lit("_ ")))
    return t.laws.select("urn", F.array_join(terms, " ").alias("terms")).filter("terms <> ''")


@register("q02_search", f"with {ranked_sql(TERMS)} select urn, title, score from hits order by score desc, urn limit 50")
def _(t):
    return search.search(index(t), "der die").select("urn", "title", "score")


@register("q02_search_scan", f"with {ranked_sql(TERMS)} select urn, title, score from hits order by score desc, urn limit 50")
def _(t):
    return search.search(t.laws, "der die").select("urn", "title", "score")


@register("q02_postings", f"with p as (select urn, len(tk) as length, unnest(tk) as term from (select urn, {TOKENS} as tk from v_laws)) select term, count(distinct urn) as n_laws, count(*) as n from p group by 1")
def _(t):
    return search.postings(t.laws).groupBy("term").agg(F.count("*").alias("n_laws"), F.sum("tf").alias("n"))


def _snippet_sql() -> str:
    return f"""with {ranked_sql(TERMS)}, h as (select urn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from hits order by score desc, urn limit 10),
 e as (select urn, w, unnest(range(0, greatest(len(w) - 40, 0) + 1)) as p0 from h),
 c as (select urn, w, p0, len(list_filter(w[p0 + 1:p0 + 40], lambda x: len(list_filter(regexp_extract_all(lower(strip_accents(x)), '[\\p{{L}}\\p{{N}}]+'), lambda y: y in ('der', 'die'))) > 0)) as n from e),
 b as (select urn, min_by(p0, -n * 1000000 + p0) as p0, any_value(w) as w from c group by urn)
 select urn, (case when p0 > 0 then '...' else '' end) || array_to_string(list_transform(w[p0 + 1:p0 + 40], lambda x: case when len(list_filter(regexp_extract_all(lower(strip_accents(x)), '[\\p{{L}}\\p{{N}}]+'), lambda y: y in ('der', 'die'))) > 0 then '<b>' || x || '</b>' else x end), ' ')
  || (case when p0 + 40 < len(w) then '...' else '' end) as snippet from b"""


@register("q03_snippet", _snippet_sql())
def _(t):
    return search.search_snippets(index(t), "der die", 10).select("urn", "snippet")


@register("q04_search_like", "select urn, title, importance_score from v_laws where contains(lower(title), 'thwhst') or contains(lower(text), 'thwhst') order by importance_score desc, urn limit 50")
def _(t):
    return search.search_like(t.laws, "ThWhst")


def _trigrams(t) -> trigrams.Trigrams:
    """The trigrams of the acts, stored anew beside the acts themselves; ranked search's postings are not needed for them."""
    path = f"{shared_dir(t.spark)}/trigrams-{uuid.uuid4().hex}"
    return trigrams.build_trigrams(search.store_acts(t.laws, path), path)


@register("q04_by_trigrams", "select urn, title, importance_score from v_laws where contains(lower(title), 'thwhst') or contains(lower(text), 'thwhst') order by importance_score desc, urn limit 50")
def _(t):
    return trigrams.search_like(_trigrams(t), "ThWhst")


@register("q04_trigram_postings", """with g as (select distinct urn, substring(x, i, 3) as gram from (select urn, x, unnest(range(1, length(x) - 1)) as i from (select urn, lower(coalesce(title, '')) as x from v_laws union all select urn, lower(coalesce(text, '')) from v_laws)))
 select gram, count(*) as acts from g group by 1""")
def _(t):
    return _trigrams(t).postings.groupBy("gram").agg(F.sum(F.size("at")).alias("acts"))


DEGREES = "left join (select cited_urn, count(*) as n from v_citations group by 1) i on i.cited_urn = l.urn left join (select citing_urn, count(*) as n from v_citations group by 1) o on o.citing_urn = l.urn"
COLS = "l.urn, l.title, l.type, l.year, {score} as score, coalesce(i.n, 0) as citations_in, coalesce(o.n, 0) as citations_out, l.article_count, l.importance_score"


@register("q05_search_filtered", f"with {ranked_sql(TERMS)} select {COLS.format(score='l.score')} from hits l {DEGREES} where l.type = 'de' and l.year >= 1950 and l.article_count <= 20 and coalesce(i.n, 0) >= 2 order by score desc, urn limit 50")
def _(t):
    return search.search_filtered(index(t), store(t), "der die", kind="de", year_from=1950, articles_to=20, min_citations=2)


@register("q05_search_filtered_scan", f"with {ranked_sql(TERMS)} select {COLS.format(score='l.score')} from hits l {DEGREES} where l.type = 'de' and l.year >= 1950 and l.article_count <= 20 and coalesce(i.n, 0) >= 2 order by score desc, urn limit 50")
def _(t):
    return search.search_filtered(index(t), t.citations, "der die", kind="de", year_from=1950, articles_to=20, min_citations=2)


@register("q05_no_query", f"select {COLS.format(score='0.0::double')} from v_laws l {DEGREES} where l.status = 'in_force' and l.year <= 2010 and l.article_count >= 3 order by citations_in desc, urn limit 50")
def _(t):
    return search.search_filtered(t.laws, t.citations, year_to=2010, articles_from=3, status="in_force")


@register("q05_by_title", f"select {COLS.format(score='0.0::double')} from v_laws l {DEGREES} order by title nulls last, urn limit 50")
def _(t):
    return search.search_filtered(t.laws, t.citations, sort_by="title")


@register("q06_refine", f"with {ranked_sql(TERMS)}, k as (select * from hits order by score desc, urn limit 50) select urn, score from k where {STATUS} = 'in_force' and contains(lower(type), 'd') and year between 1950 and 2010")
def _(t):
    return search.refine(search.search(index(t), "der die"), "in_force", "D", 1950, 2010).select("urn", "score")


TOPICS = {"german": "der die", "english": "the of", "french": "les des", "nothing": "zzzz"}


def _many_sql() -> str:
    parts = []
    for name, query in list(TOPICS.items())[:3]:
        parts.append(f"select '{name}' as topic, urn, score, row_number() over (order by score desc, urn) as rank from (with {ranked_sql(search.query_terms(query))} select * from hits where {STATUS} = 'in_force') x")
    return "select topic, urn, score, rank from (" + " union all ".join(parts) + ") where rank <= 10"


@register("q07_search_many", _many_sql())
def _(t):
    return search.search_many(index(t), TOPICS)


LABEL = f"case {STATUS} when 'in_force' then 'In force' when 'abrogated' then 'Abrogated' else '? ' || coalesce(nullif(status, ''), 'N/A') end"


@register("q08_evidence", f"""with {ranked_sql(TERMS)}, k as (select * from hits order by score desc, urn limit 100), b as (select *, {STATUS} as known from k), v as (select * from b where known = 'in_force' order by score desc, urn limit 8),
 r as (select *, row_number() over (order by score desc, urn) as rank, {LABEL} as label from v) select 'Query: der die' || chr(10) || 'Evidence considered: ' || count(*) || ' laws (' || count(*) || ' in force, 0 abrogated).' || chr(10) || chr(10) ||
 string_agg(rank || '. [' || label || '] ' || coalesce(title, 'N/A') || ' (' || year || ') - ' || urn, chr(10) order by rank) as evidence from r""")
def _(t):
    return search.evidence(index(t), "der die")


@register("q09_browse", f"with b as (select urn, title, type, year, {STATUS} as status, substring(text, 1, 2000) as preview from v_laws) select * from b where type = 'en' and status = 'in_force' order by year desc nulls last, urn limit 25 offset 25")
def _(t):
    return search.browse(t.laws, kind="en", status="in_force", page=1)


@register("q10_get_law", """select l.urn, l.title, l.type, l.year, l.status, (select count(*) from v_citations where cited_urn = 'doc:7') as citations_in, (select count(*) from v_citations where citing_urn = 'doc:7') as citations_out,
 (select count(*) from v_amendments where urn = 'doc:7') as amendments, m.domain_cluster, m.pagerank from v_laws l left join v_meta m on m.urn = l.urn where l.urn = 'doc:7'""")
def _(t):
    return search.get_law(t.laws, t.citations, t.amendments, t.meta, "doc:7")


@register("q11_find_first", "select 1 as rule, urn, title from v_laws where urn like 'doc:77%' order by urn limit 3")
def _(t):
    return search.find_first(t.laws, [F.col("type") == "it", F.col("urn").startswith("doc:77"), F.lower("title").contains("the")], 3)


@register("q12_landmarks", """with m as (select * from (values ('a', 'doc:7', false), ('b', 'doc:99', true), ('c', 'doc:nothing', false)) m(label, stem, prefix)), h as (select label, min(urn) as urn from m join v_laws l on case when prefix then starts_with(l.urn, stem) else l.urn = stem end group by 1)
 select m.label, m.stem || case when prefix then '*' else '' end as pattern, h.urn, l.title, (select count(*) from v_citations where cited_urn = h.urn) as citations_in from m left join h using (label) left join v_laws l on l.urn = h.urn""")
def _(t):
    return search.lookup_landmarks(t.laws, t.citations, [("a", "doc:7"), ("b", "doc:99*"), ("c", "doc:nothing")])


@register("q13_law_types", "select distinct type from v_laws where type is not null")
def _(t):
    return search.law_types(t.laws)


@register("q14_year_range", "select coalesce(min(year), 1861) as min_year, coalesce(max(year), 2026) as max_year from v_laws where year > 0")
def _(t):
    return search.year_range(t.laws)


@register("q15_top_important", "select urn, title, importance_score from v_laws where importance_score > 0 order by 3 desc, 1 limit 15")
def _(t):
    return search.top_important(t.laws)


@register("q16_same_domain", """select m.urn, m.domain_cluster, l.title, l.importance_score from v_meta m join v_laws l on l.urn = m.urn where m.urn <> 'doc:2' and m.domain_cluster = (select domain_cluster from v_meta where urn = 'doc:2') order by l.importance_score desc nulls last, m.urn limit 15""")
def _(t):
    return search.same_domain(t.laws, t.meta, "doc:2")


@register("q17_same_legislature", f"with p as (select l.urn, l.title, l.importance_score, {LEG} as legislature from v_laws l) select urn, title, importance_score, legislature from p where urn <> 'doc:30' and legislature = (select legislature from p where urn = 'doc:30') order by importance_score desc nulls last, urn limit 15")
def _(t):
    return search.same_legislature(t.laws, "doc:30")


@register("q18_topic_top", """with m as (select * from (values ('old', 'e%', 1940, 1970), ('new', '%', 1990, 2030)) m(label, pattern, first, last)), h as (select m.label, l.*, row_number() over (partition by m.label order by importance_score desc, urn) as rank from v_laws l join m on lower(l.type) like m.pattern and l.year between m.first and m.last)
 select label, rank, urn, title, importance_score from h where rank <= 5""")
def _(t):
    return search.topic_top(t.laws, [("old", "E%", 1940, 1970), ("new", "%", 1990, 2030)])


@register("q19_top_in_domain", """select l.urn, l.title, l.importance_score, (select count(*) from v_citations where cited_urn = l.urn) as citations_in from v_laws l where l.urn in (select urn from v_meta where domain_cluster = 'trasporti') order by 4 desc, 3 desc, 1 limit 30""")
def _(t):
    return search.top_in_domain(t.laws, t.citations, t.meta, "trasporti")


@register("q20_most_articles", "select urn, title, article_count from v_laws order by 3 desc nulls last, 1 limit 15")
def _(t):
    return search.most_articles(t.laws)
