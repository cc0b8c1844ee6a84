"""Text-mining and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.functions import dims
from corpusloom.functions import text as fx
from corpusloom.operators import intervals, mining
from corpusloom.plans.adapters import values

#: Keyword tables of words that occur in the test texts.
WORDS = {"articles": ["the ", " der ", " les "], "places": ["und ", "que"], "rare": ["thwhst", "queque"], "none": ["zzzz"]}


def _contains(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _labels(text: str) -> str:
    return "list_filter([" + ", ".join(f"case when {_contains(text, w)} then '{k}' end" for k, w in WORDS.items()) + "], lambda x: x is not null)"


# legal references made from numbers, so that the patterns have something to find
REFS = """select concat('doc:', cast(doc_id as varchar(20))) as urn, source as title, concat('articolo ', cast(doc_id % 9 + 1 as varchar(4)), ' della legge ', cast(doc_id % 300 + 1 as varchar(4)), '/',
 cast(1950 + cast(doc_id % 70 as int) as varchar(4)), ' e d.lgs. ', cast(doc_id % 50 + 1 as varchar(4)), '/', cast(10 + doc_id % 90 as varchar(2)), ', legge ', cast(1 + doc_id % 28 as varchar(2)), ' marzo 1999, n. ', cast(doc_id % 77 + 1 as varchar(4)),
 ' per eur ', cast(doc_id % 13 as varchar(4)), '.250,50 o € ', cast(doc_id % 99 as varchar(4)), '; art. ', cast(doc_id % 5 + 1 as varchar(4)), ' costituzione, codice civile art. ', cast(doc_id % 8 + 1 as varchar(4))) as text from documents"""


def _refs(t):
    return t.spark.sql(REFS.replace("from documents", "from {d}"), d=t.base("documents"))


YEAR2 = "case when (10 + doc_id % 90) > 50 then '19' else '20' end || (10 + doc_id % 90)"


@register("t01_extract_citations", f"""with b as (select doc_id, 'doc:' || doc_id as citing_urn from documents),
 r as (select citing_urn, 'urn:nir:stato:legge:' || (1950 + doc_id % 70) || ';' || (doc_id % 300 + 1) as target_urn, 'articolo ' || (doc_id % 9 + 1) || ' della legge ' || (doc_id % 300 + 1) || '/' || (1950 + doc_id % 70) as ref,
  (doc_id % 9 + 1)::varchar as article, 1 as pass, 0 as pos from b
 union all select citing_urn, 'urn:nir:stato:legge:' || (1950 + doc_id % 70) || ';' || (doc_id % 300 + 1), 'legge ' || (doc_id % 300 + 1) || '/' || (1950 + doc_id % 70), null, 2, 0 from b
 union all select citing_urn, 'urn:nir:stato:decreto.legislativo:' || {YEAR2} || ';' || (doc_id % 50 + 1), 'd.lgs. ' || (doc_id % 50 + 1) || '/' || (10 + doc_id % 90), null, 2, 1 from b
 union all select citing_urn, 'urn:nir:stato:legge:1999;' || (doc_id % 77 + 1), 'legge ' || (1 + doc_id % 28) || ' marzo 1999, n. ' || (doc_id % 77 + 1), null, 3, 0 from b)
 select citing_urn, target_urn, ref, article, pass, pos from (select *, row_number() over (partition by citing_urn, target_urn, article order by pass, pos) as n from r) where n = 1""")
def _(t):
    return mining.extract_citations(_refs(t))


@register("t02_make_urn", """select l_orderkey, l_linenumber, 'urn:nir:stato:' || case l_linenumber % 4 when 0 then 'decreto.legislativo' when 1 then 'legge' when 2 then 'decreto.del.presidente.della.repubblica' else 'legge' end || ':' ||
 case when l_partkey % 3 = 0 then (case when 10 + l_suppkey % 90 > 50 then '19' else '20' end) || (10 + l_suppkey % 90) when l_partkey % 3 = 1 then (100 + l_suppkey % 900)::varchar else (1900 + l_suppkey % 100)::varchar end || ';' || l_partkey as urn from lineitem""")
def _(t):
    kind = F.expr("case l_linenumber % 4 when 0 then ' D.Lgs.' when 1 then 'L.' when 2 then 'd.p.r.' else 'boh' end")
    year = F.expr("cast(case when l_partkey % 3 = 0 then 10 + l_suppkey % 90 when l_partkey % 3 = 1 then 100 + l_suppkey % 900 else 1900 + l_suppkey % 100 end as string)")
    return t.lineitem.select("l_orderkey", "l_linenumber", fx.canonical_urn(kind, F.col("l_partkey").cast("string"), year).alias("urn"))


@register("t03_typed_citations", """select 'doc:' || doc_id as urn, unnest([(doc_id % 300 + 1) || '-' || (1950 + doc_id % 70), 'COST-' || (doc_id % 5 + 1), 'CODICE CIVILE ART. ' || (doc_id % 8 + 1) || '-' || (doc_id % 8 + 1)]) as cite_id,
 unnest(['legge', 'cost', 'codice']) as kind from documents""")
def _(t):
    return mining.extract_typed_citations(_refs(t))


@register("t04_raw_citations", """select 'doc:' || doc_id as urn, array_to_string(list_sort(list_distinct([(doc_id % 300 + 1) || '/' || (1950 + doc_id % 70), (doc_id % 50 + 1) || '/' || (10 + doc_id % 90)])), ';') as cited,
 array_to_string(list_sort(['articolo ' || (doc_id % 9 + 1) || ' della legge ' || (doc_id % 300 + 1) || '/' || (1950 + doc_id % 70), 'legge ' || (doc_id % 300 + 1) || '/' || (1950 + doc_id % 70), 'd.lgs. ' || (doc_id % 50 + 1) || '/' || (10 + doc_id % 90)]), ';') as raw from documents""")
def _(t):
    return mining.extract_raw_citations(_refs(t)).select("urn", F.array_join("cited", ";").alias("cited"), F.array_join("raw", ";").alias("raw"))


INLINE = """select 'doc:' || doc_id as urn, lang as title, 'see doc:' || (doc_id % 7) || ' and doc:' || (doc_id % 7) || ', doc:' || (doc_id * 3) as text from documents"""


@register("t05_urn_references", f"""with i as ({INLINE}), f as (select urn, unnest(list_distinct(['doc:' || (substr(urn, 5)::bigint % 7), 'doc:' || (substr(urn, 5)::bigint * 3)])) as ref from i)
 select f.urn, case when f.ref = 'doc:' || (substr(f.urn, 5)::bigint % 7) then 0 else 1 end as pos, f.ref, substring(l.title, 1, 60) as ref_title from f join i l on l.urn = f.ref""")
def _(t):
    return mining.urn_references(t.spark.sql(INLINE.replace("from documents", "from {d}"), d=t.base("documents")), pattern=r"doc:\d+")


TEXT6 = "lower(coalesce(title, '') || ' ' || substring(coalesce(text, ''), 1, 2000))"


@register("t06_detect_domains", f"""with k as (select urn, {_labels(TEXT6)} as keywords from v_laws) select urn, keywords[1] as domain_cluster, array_to_string(keywords[1:5], ',') as tags, array_to_string(keywords, ',') as keywords from k where len(keywords) > 0""")
def _(t):
    return mining.detect_domains(t.laws, WORDS).select("urn", "domain_cluster", F.array_join("tags", ",").alias("tags"), F.array_join("keywords", ",").alias("keywords"))


@register("t07_tag_labels", f"select urn, unnest({_labels('lower(text)')}) as label from v_laws")
def _(t):
    return mining.tag_labels(t.laws, WORDS)


@register("t08_amounts", """select 'doc:' || doc_id as urn, cast(2 as bigint) as n_amounts, greatest((doc_id % 13) * 1000 + 250.5, doc_id % 99)::double as max_amount from documents""")
def _(t):
    return mining.extract_amounts(_refs(t)).select("urn", "n_amounts", "max_amount")


def _context(words: list[str]) -> str:
    cases = [
        f"when instr(lower(text), '{w}') > 0 then substring(trim(replace(substring(text, greatest(instr(lower(text), '{w}') - 80, 1), least(length(text), instr(lower(text), '{w}') - 1 + 220) - greatest(instr(lower(text), '{w}') - 80, 1) + 1), chr(10), ' ')), 1, 280)"
        for w in words
    ]
    return "case " + " ".join(cases) + " else '' end"


@register("t09_keyword_context", f"select urn, {_context(['thwhst', 'queque', 'und '])} as context from v_laws")
def _(t):
    return mining.keyword_context(t.laws, ["thwhst", "queque", "und "])


STATUS = "case when coalesce(status, '') = '' then 'unknown' when lower(trim(status)) in ('in_force', 'vigente', 'v', 'in force', 'active') then 'in_force' when lower(trim(status)) in ('abrogated', 'abrogato', 'abrogata', 'a', 'repealed') then 'abrogated' else lower(trim(status)) end"


@register("t10_registry_per_law", f"""with r as (select urn, title, year, {STATUS} as status, {_labels('lower(text)')} as labels from v_laws)
 select urn, title, year, status, array_to_string(labels, ',') as labels, cast(0 as bigint) as n_amounts from r where len(labels) > 0""")
def _(t):
    return mining.fiscal_registry(t.laws, WORDS)[0].select("urn", "title", "year", "status", F.array_join("labels", ",").alias("labels"), "n_amounts")


@register("t10_registry_per_label", "with r as (select urn, text, unnest(" + _labels("lower(text)") + ") as label from v_laws) select urn, label, case label " + " ".join(f"when '{k}' then {_context(w)}" for k, w in WORDS.items()) + " end as context from r")
def _(t):
    return mining.fiscal_registry(t.laws, WORDS)[1].select("urn", "label", "context")


@register("t11_top_terms", r"""select term, count(*) as n from (select unnest(regexp_split_to_array(lower(title), '\s+')) as term from v_laws) where length(term) > 3 group by 1 order by 2 desc, 1 limit 500""")
def _(t):
    return mining.top_terms(t.laws)


@register("t12_enrich_rows", "select urn, length(text)::bigint as text_length, try_cast(substring(date, 1, 4) as int) as year from v_laws")
def _(t):
    return mining.enrich_rows(t.laws.drop("text_length", "year")).select("urn", "text_length", "year")


@register("t13_normalize_status", f"select urn, {STATUS} as status from v_laws")
def _(t):
    return t.laws.select("urn", fx.normalized_status(F.col("status")).alias("status"))


@register("t14_status_label", f"select urn, case {STATUS} when 'in_force' then 'In force' when 'abrogated' then 'Abrogated' else '? ' || coalesce(nullif(status, ''), 'N/A') end as label from v_laws")
def _(t):
    return t.laws.select("urn", fx.status_label(F.col("status")).alias("label"))


TRACK = f"case when contains(lower(coalesce(source_collection, '')), 'abrogat') or {STATUS} = 'abrogated' then 'abrogato' when contains(lower(coalesce(source_collection, '')), 'multivigente') then 'multivigente' else 'vigente' end"


@register("t15_dataset_track", f"select urn, {TRACK} as track from v_laws")
def _(t):
    return t.laws.select("urn", fx.dataset_track(F.col("source_collection"), F.col("status")).alias("track"))


LEG = f"coalesce((select min(n) from {values(dims.LEGISLATURES, 'n, s, e')} where l.year >= s and l.year < e), case when l.year >= 2027 then 20 end)"
GOV = f"(select min_by(name, ord) from {values([(i, *c) for i, c in enumerate(dims.CABINETS)], 'ord, name, s, e')} where l.year >= s and l.year < e)"
ERA = f"case {' '.join(f'when l.year < {y} then ' + repr(n) for y, n in dims.ERAS)} when l.year is not null then '{dims.LAST_ERA}' end"


@register("t16_legislature", f"select l.urn, {LEG} as legislature from v_laws l")
def _(t):
    return mining.with_periods(t.laws).select("urn", "legislature")


@register("t17_government", f"select l.urn, {GOV} as government from v_laws l")
def _(t):
    return mining.with_periods(t.laws).select("urn", "government")


def _periods(t, rows: list[tuple]):
    """A table of periods (name, first, after, rank) from a list."""
    return t.spark.createDataFrame([(str(n), a, b, i) for i, (n, a, b) in enumerate(rows)], "name string, first long, after long, rank int")


@register("t16_legislature_join", f"select l.urn, {LEG} as legislature from v_laws l")
def _(t):
    terms = _periods(t, [*dims.LEGISLATURES, (*dims.OPEN_TERM, None)])
    return intervals.period_of(t.laws.select("urn", "year"), "year", terms).select("urn", F.col("period").cast("int").alias("legislature"))


@register("t17_government_join", f"select l.urn, {GOV} as government from v_laws l")
def _(t):
    return intervals.period_of(t.laws.select("urn", "year"), "year", _periods(t, dims.CABINETS)).select("urn", F.col("period").alias("government"))


@register("t17_period_of_table", """select l.urn, l.year, (select arg_min(s_name, s_suppkey) from supplier where 1930 + s_suppkey % 97 <= l.year and l.year < 1930 + s_suppkey % 97 + s_nationkey % 4) as period from v_laws l""")
def _(t):
    first = 1930 + F.col("s_suppkey") % 97
    periods = t.supplier.select(F.col("s_name").alias("name"), first.alias("first"), (first + F.col("s_nationkey") % 4).alias("after"), F.col("s_suppkey").alias("rank"))
    return intervals.period_of(t.laws.select("urn", "year"), "year", periods)


@register("t18_era", f"select l.urn, {ERA} as era from v_laws l")
def _(t):
    return mining.with_periods(t.laws).select("urn", "era")


URNS = """select case doc_id % 4 when 0 then concat('urn:nir:stato:legge:', cast(1940 + cast(doc_id % 90 as int) as varchar(4)), ';', cast(doc_id as varchar(12))) when 1 then concat('urn:nir:stato:decreto.legge:', cast(1940 + cast(doc_id % 90 as int) as varchar(4)), '-05-01;', cast(doc_id as varchar(12)))
 when 2 then concat('doc:', cast(doc_id as varchar(12))) else concat('urn:nir:stato:legge:x', cast(doc_id as varchar(12))) end as urn, doc_id from documents"""
PARSED = f"""with u as ({URNS}), l as (select urn, doc_id % 4 < 2 as valid_urn, case doc_id % 4 when 0 then 'legge' when 1 then 'decreto.legge' end as law_type, case when doc_id % 4 < 2 then 1940 + (doc_id % 90)::int end as year,
 case when doc_id % 4 < 2 then doc_id::varchar end as number from u), p as (select l.*, {LEG} as legislature, {GOV} as government, {ERA} as era from l)"""


@register("t19_parse_urn", PARSED + " select * from p")
def _(t):
    return mining.parse_urn(t.spark.sql(URNS.replace("from documents", "from {d}"), d=t.base("documents")))


@register("t20_format_metadata", PARSED + """ select urn, case when valid_urn then concat_ws(' | ', 'Year: ' || year, 'Type: ' || law_type, 'Legislature: ' || legislature, 'Government: ' || government, 'Era: ' || era) else 'Invalid URN' end as line from p""")
def _(t):
    return mining.format_metadata(mining.parse_urn(t.spark.sql(URNS.replace("from documents", "from {d}"), d=t.base("documents"))))


def _html(col: str) -> str:
    out = col
    for a, b in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", "")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')" if b != "\n" else f"regexp_replace({out}, '{a}', chr(10), 'g')"
    for name, char in (("nbsp", " "), ("egrave", "è"), ("agrave", "à"), ("igrave", "ì"), ("ograve", "ò"), ("ugrave", "ù"), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        out = f"replace({out}, '&{name};', '{char}')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@register("x05_html_to_text", f"select page_id, {_html('html')} as text from pages")
def _(t):
    return t.pages.select("page_id", fx.html_to_text(F.col("html")).alias("text"))


@register("x05_blunt_text", r"select page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 50000) as text from pages")
def _(t):
    return t.pages.select("page_id", fx.blunt_text(F.col("html")).alias("text"))


@register("x08_extract_links", r"""with l as (select page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=["'']([^"'']*)["'']', 1) as x from pages), e as (select page_id, unnest(x) as href, generate_subscripts(x, 1) - 1 as pos from l),
 k as (select *, regexp_extract(href, '^[^#?]*', 0) as key from e) select page_id, key, min(pos) as pos, min_by(href, pos) as href from k group by 1, 2""")
def _(t):
    return mining.extract_links(t.pages)


PAGES = """select page_id, concat('<html><h2 class="preamble-title-akn">P &egrave; ', cast(page_id % 3 as varchar(2)), '</h2><div class="bodyTesto"><h2 class="article-num-akn">Art. ', cast(page_id as varchar(9)), '</h2>body<br/>', cast(page_id as varchar(9)), ' x&amp;y</div> <div class="d-flex">z</div></html>') as html from pages"""


@register("x06_extract_fragment", "select page_id, 'P è ' || (page_id % 3) || chr(10) || 'Art. ' || page_id || chr(10) || 'body' || chr(10) || page_id || ' x&y' as fragment from pages")
def _(t):
    return mining.extract_fragment(t.spark.sql(PAGES.replace("from pages", "from {p}"), p=t.base("pages")))


@register("x07_assemble_document", r"""select conv_id as doc, string_agg(text, chr(10) || chr(10) order by turn) as text, count(*) filter (where regexp_matches(text, 'Art\.\s*\d+')) as articles from conversations where length(text) > 5 group by 1""")
def _(t):
    return mining.assemble_document(t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("text").alias("fragment")))


XML = """select event_id, concat('<a eid="it/legge/', cast(2000 + cast(event_id % 20 as int) as varchar(4)), '/', cast(event_id as varchar(12)), '"><b date="2020-01-0', cast(1 + event_id % 9 as varchar(1)), '"/><date x="1">2019-12-31</date><c anno="', cast(1990 + cast(event_id % 10 as int) as varchar(4)), '" number="12/2001"/></a>') as xml from events"""


@register("x09_extract_dates", "select event_id, unnest(['2020-01-0' || (1 + event_id % 9), '2019-12-31', (1990 + event_id % 10)::varchar, '2001']) as date from events")
def _(t):
    return mining.extract_dates(t.spark.sql(XML.replace("from events", "from {e}"), e=t.base("events")))


@register("x04_scrape_akn_id", "select event_id, 'it/legge/' || (2000 + event_id % 20) || '/' || event_id as akn_uri, (2000 + event_id % 20) || '-' || event_id as law_id from events")
def _(t):
    return mining.scrape_akn_id(t.spark.sql(XML.replace("from events", "from {e}"), e=t.base("events")))
