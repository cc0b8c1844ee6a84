"""The streaming jobs run over the event table to its end, and file scans over tables written by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import graph, reports
from corpusloom.sources import files
from corpusloom.sources.tables import shared_dir
from corpusloom.streaming import jobs, keyed


def _stream(t, *columns: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = t.base("events").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet").select(*columns) if columns else t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet")


def _finished(t, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream emits, from a table in the shared folder."""
    where = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{where}/out")


def _watched(t, job, stream: DataFrame) -> DataFrame:
    """All changes that a job finds in a stream."""
    where = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    job(stream, f"{where}/out", f"{where}/state").awaitTermination()
    return jobs.seen_changes(t.spark, f"{where}/out")


def _keyed(events: DataFrame, *more: str) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), *more)


@register("l01_ingest", """with d as (select concat('user:', user_id) as urn, event_type as status, event_id as ts, row_number() over (partition by user_id order by event_id desc) as n from events) select urn, status, ts from d where n = 1""")
def _(t):
    where = f"{shared_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    rows = _stream(t).select(F.concat(F.lit("user:"), F.col("user_id")).alias("urn"), F.col("event_type").alias("status"), F.col("event_id").alias("ts"))
    query = jobs.ingest(rows, f"{where}/base", f"{where}/log", f"{where}/state")
    query.awaitTermination()
    return jobs.ingested(t.spark, f"{where}/base", rows.schema)


@register("l02_status_changes", """with r as (select user_id::varchar as key, event_type as value, event_id as seq, lag(event_type) over (partition by user_id order by event_id) as f from events) select key, f as "from", value as "to", seq from r where f <> value""")
def _(t):
    return _watched(t, jobs.value_changes, _keyed(_stream(t))).drop("is_new")


@register("l02_status_changes_batch", """with r as (select user_id::varchar as key, event_type as value, event_id as seq, lag(event_type) over (partition by user_id order by event_id) as f from events) select key, f as "from", value as "to", seq from r where f <> value""")
def _(t):
    return jobs.value_changes_batch(_keyed(t.events))


def _by_state(t, rows: DataFrame, tags: bool) -> DataFrame:
    """What the keyed stream emits of rows (key, value, seq, ts)."""
    where = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    keyed.run(keyed.changes(rows, "2 hours", tags), f"{where}/out", f"{where}/state")
    return keyed.seen(t.spark, f"{where}/out").drop("ts")


PASSED = "ts <= (select max(ts) - interval 2 hours from events)"


@register("l02_status_changes_keyed", f"""with r as (select user_id::varchar as key, event_type as value, event_id as seq, ts, lag(event_type) over (partition by user_id order by ts, event_id) as f from events)
 select key, f as "from", value as "to", seq from r where f <> value and {PASSED}""")
def _(t):
    rows = _keyed(_stream(t, "user_id", "event_type", "event_id", "ts"), "ts")
    return _by_state(t, rows, False).drop("is_new")


TAGS = """with r as (select collection as key, old_etag as value, id as seq, lag(old_etag) over (partition by collection order by id) as f from v_log where old_etag is not null) select key, f as "from", value as "to", seq, f is null as is_new from r where f is null or f <> value"""


@register("l03_tag_changes", TAGS)
def _(t):
    tag = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string")))
    rows = _stream(t).select(F.concat(F.lit("coll"), (F.col("user_id") % 20).cast("string")).alias("key"), tag.alias("value"), F.col("event_id").alias("seq"))
    return _watched(t, jobs.tag_changes, rows)


@register("l03_tag_changes_batch", TAGS)
def _(t):
    return jobs.tag_changes_batch(t.log.select(F.col("collection").alias("key"), F.col("old_etag").alias("value"), F.col("id").alias("seq")))


@register("l03_tag_changes_keyed", f"""with e as (select concat('coll', user_id % 20) as key, concat('e', event_id % 9) as value, event_id as seq, ts from events where event_id % 4 <> 0),
 r as (select *, lag(value) over (partition by key order by ts, seq) as f from e) select key, f as "from", value as "to", seq, f is null as is_new from r where (f is null or f <> value) and {PASSED}""")
def _(t):
    tag = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string")))
    rows = _stream(t).select(F.concat(F.lit("coll"), (F.col("user_id") % 20).cast("string")).alias("key"), tag.alias("value"), F.col("event_id").alias("seq"), "ts")
    return _by_state(t, rows, True)


@register("l04_activity_stream", """select date_trunc('day', ts) as start, event_type as action, count(*) as n from events group by 1, 2
 having date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 2 hours from events)""")
def _(t):
    rows = _stream(t).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
    return _finished(t, jobs.activity(rows)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("l04_activity", "select date_trunc('day', ts) as start, event_type as action, count(*) as n from events group by 1, 2")
def _(t):
    return jobs.activity(t.events.select("ts", F.col("event_type").alias("action")))


@register("s01_read_laws", "select urn, title, year, length(text)::bigint as chars from v_laws")
def _(t):
    where = f"{shared_dir(t.spark)}/laws-{uuid.uuid4().hex}"
    files.write_laws(t.laws, where)
    laws, _bad = files.read_laws(t.spark, where)
    return laws.select("urn", "title", "year", F.length("text").cast("long").alias("chars"))


@register("s05_export_csv", """select l.urn as "URN", l.title as "Title", l.year as "Year", coalesce(i.n, 0) as "Citations_In", coalesce(o.n, 0) as "Citations_Out" from v_laws l left join (select cited_urn, count(*) as n from v_citations group by 1) i on i.cited_urn = l.urn
 left join (select citing_urn, count(*) as n from v_citations group by 1) o on o.citing_urn = l.urn order by l.year desc nulls last, l.title nulls last, l.urn limit 200""")
def _(t):
    where = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    files.export_csv(t.laws, t.citations, where, 200)
    return files.read_export(t.spark, where).select("URN", "Title", "Year", "Citations_In", "Citations_Out")


@register("s07_citation_index", "select citing_urn as urn, count(*) as count from v_citations group by 1")
def _(t):
    nested = t.citations.groupBy(F.col("citing_urn").alias("urn")).agg(F.collect_list(F.struct("cited_urn")).alias("citations")).withColumn("title", F.lit(""))
    return files.citation_index(nested).select("urn", "count")


@register("s07_citation_index_totals", "select count(distinct citing_urn) as acts_with_citations, count(*) as citations from v_citations")
def _(t):
    nested = t.citations.groupBy(F.col("citing_urn").alias("urn")).agg(F.collect_list(F.struct("cited_urn")).alias("citations")).withColumn("title", F.lit(""))
    return files.citation_index_totals(files.citation_index(nested))


@register("s10_write_report", "with c as (select 'by_type' as metric, type as key, count(*) as n from v_laws group by type union all select 'by_year', cast(year as varchar), count(*) from v_laws group by year) select metric, count(*) as keys, sum(n)::bigint as acts from c group by 1")
def _(t):
    where = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    rows = [t.laws.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").cast("string").alias("value")).withColumn("metric", F.lit(f"by_{c}")) for c in ("type", "year")]
    files.write_report(reports.metrics_document(rows[0].unionByName(rows[1])), where)
    back = t.spark.read.schema("metric string, document string").json(where).select("metric", F.explode(F.map_values(F.from_json("document", "map<string, string>"))).alias("n"))
    return back.groupBy("metric").agg(F.count("*").alias("keys"), F.sum(F.col("n").cast("long")).alias("acts"))


@register("s11_manifest", "select filename, downloaded_at, sha256 from (select 'f' || user_id as filename, ts as downloaded_at, event_id::varchar as sha256, row_number() over (partition by user_id order by ts desc, event_id::varchar) as n from events) where n = 1")
def _(t):
    rows = t.events.select(F.concat(F.lit("f"), "user_id").alias("filename"), F.col("ts").alias("downloaded_at"), F.col("event_id").cast("string").alias("sha256"))
    return files.manifest(rows)


@register("s09_append_log", "select cast(ts as date) as day, count(*) as n from events group by 1")
def _(t):
    where = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"
    files.append_log(t.events.select("event_id", F.col("ts").alias("timestamp")), where)
    return t.spark.read.schema("event_id long, timestamp timestamp, day date").json(where).groupBy("day").agg(F.count("*").alias("n"))


@register("c08_promote", "select urn, text_length from v_new")
def _(t):
    root = f"{shared_dir(t.spark)}/promoted-{uuid.uuid4().hex}"
    files.promote(t.old, root, "20240101000000-first")
    files.promote(t.new, root, "20240102000000-second")
    return files.current(t.spark, root).select("urn", "text_length")


@register("s06_graph_files", "with nodes as (select cited_urn as id, count(*) as size from v_citations where cited_urn in (select urn from v_laws) group by 1 having count(*) >= 2) select * from nodes")
def _(t):
    where = f"{shared_dir(t.spark)}/graph-{uuid.uuid4().hex}"
    nodes = graph.graph_nodes(t.laws, t.citations)
    files.export_graph(nodes, graph.graph_edges(nodes, t.citations), where)
    return t.spark.read.schema("id string, size long").json(f"{where}/nodes")


EXPORTED = """nodes as (select cited_urn as id, count(*) as size from v_citations where cited_urn in (select urn from v_laws) group by 1 having count(*) >= 2),
 edges as (select citing_urn as source, cited_urn as target, cnt as weight from v_citations where citing_urn in (select id from nodes) and cited_urn in (select id from nodes))"""


def _exported(t):
    where = f"{shared_dir(t.spark)}/graph-{uuid.uuid4().hex}"
    nodes = graph.graph_nodes(t.laws, t.citations)
    files.export_graph(nodes, graph.graph_edges(nodes, t.citations), where, 2)
    return files.read_graph(t.spark, where)


@register("s06_exported_edges", f"with {EXPORTED} select * from edges")
def _(t):
    return _exported(t)[1]


@register("s06_export_stats", f"with {EXPORTED} select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, 2 as min_citations")
def _(t):
    return _exported(t)[2]


@register("c20_incremental_append", "select event_id, event_type from events")
def _(t):
    where = f"{shared_dir(t.spark)}/append-{uuid.uuid4().hex}"
    for _run in range(2):  # the second run finds nothing new
        jobs.append_new(_stream(t, "event_id", "event_type"), f"{where}/out", f"{where}/state").awaitTermination()
    return t.spark.read.parquet(f"{where}/out").select("event_id", "event_type")


@register("s04_write_laws", "select urn, title from v_laws order by urn")
def _(t):
    where = f"{shared_dir(t.spark)}/ordered-{uuid.uuid4().hex}"
    files.write_laws(t.laws.select("urn", "title"), where, ordered=True)
    return t.spark.read.schema("urn string, title string").json(where)


AKN_NS = 'xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0" xmlns:r="urn:x-rdfa"'
ENTRIES = f"""select concat('a', cast(doc_id as string), case when doc_id % 50 = 49 then '.txt' else '.xml' end) as entry, cast(concat('<akomaNtoso {AKN_NS}><act><meta><identification>',
 case when doc_id % 10 = 3 then '' else concat('<FRBRalias name="urn:nir" value="urn:nir:stato:legge:', cast(1950 + doc_id % 70 as string), '-01-02;', cast(doc_id as string), '"/>') end,
 case when doc_id % 4 = 1 then '' else concat('<FRBRdate date="', cast(1950 + doc_id % 70 as string), '-01-02"/>') end,
 case when doc_id % 5 = 2 then '' else concat('<r:span property="eli:title" content=" Title ', cast(doc_id as string), '"/>') end,
 '<r:span property="eli:type_document" resource="http://x#', lang, '"/></identification></meta><body><part><article eId="a1"><heading>Art. 1</heading><p> one ', cast(doc_id as string), ' </p></article></part><article eId="a2"><p>two</p></article></body></act></akomaNtoso>') as binary) as content from {{d}}"""


def _entries(t):
    return t.spark.sql(ENTRIES, d=t.base("documents")).withColumn("zip", F.lit("z"))


ACTS = """a as (select doc_id, case when doc_id % 10 <> 3 then 'urn:nir:stato:legge:' || (1950 + doc_id % 70) || '-01-02;' || doc_id end as urn, case when doc_id % 4 <> 1 then (1950 + doc_id % 70) || '-01-02' end as date,
 case when doc_id % 5 <> 2 then 'Title ' || doc_id end as title, lang as type, 'Art. 1one ' || doc_id || 'two' as text from documents)"""


@register("x01_parse_akn", f"with {ACTS} select 'a' || doc_id || case when doc_id % 50 = 49 then '.txt' else '.xml' end as entry, urn, title, date, type, text, length(text)::bigint as text_length, 2 as article_count, try_cast(substring(date, 1, 4) as int) as year from a")
def _(t):
    return files.parse_akn(_entries(t)).drop("zip", "articles")


@register("x02_explode_articles", f"with {ACTS} select urn, unnest([0, 1]) as pos, unnest(['Art. 1', 'a2']) as num, unnest(['a1', 'a2']) as \"eId\", unnest(['Art. 1one ' || doc_id, 'two']) as text from a where urn is not null")
def _(t):
    return files.explode_articles(files.parse_akn(_entries(t)).filter("urn is not null"))


@register("x03_parse_abrogated", f"""with {ACTS} select urn, coalesce(title, 'Atto del ' || coalesce(date, '')) as title, 1950 + (doc_id % 70)::int as year, length('Art. 1 one ' || doc_id || ' two')::bigint as text_length, 'Art. 1 one ' || doc_id || ' two' as text, 'abrogated' as status from a where urn is not null""")
def _(t):
    return files.parse_akn(_entries(t), variant="abrogated").select("urn", "title", "year", "text_length", "text", "status")


@register("s02_read_zip_entries", "select 'a' || doc_id || '.xml' as entry, lang from documents where doc_id % 50 <> 49")
def _(t):
    where = f"{shared_dir(t.spark)}/zips-{uuid.uuid4().hex}"
    files.write_zips(_entries(t), where).agg(F.sum("entries")).collect()
    found = files.read_zip_entries(t.spark, where)
    return found.select("entry", F.regexp_extract(F.decode("content", "UTF-8"), "http://x#([a-z]+)", 1).alias("lang"))


@register("s03_read_xml_dir", "select count(*) as acts, true as sized, true as hashed from v_laws")
def _(t):
    where = f"{shared_dir(t.spark)}/xml-{uuid.uuid4().hex}"
    t.laws.select("urn", "year").write.format("xml").option("rootTag", "acts").option("rowTag", "law").save(where)
    found = files.read_xml_dir(t.spark, where)
    return found.agg(F.sum(F.regexp_count("xml", F.lit("<law>"))).alias("acts"), F.min(F.col("size_bytes") > 0).alias("sized"), F.min(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("hashed"))


@register("s11_read_catalogue", "select collection, variant, acts, created from v_catalogue")
def _(t):
    where = f"{shared_dir(t.spark)}/catalogue-{uuid.uuid4().hex}"
    named = t.catalogue.select(F.when(F.col("acts") % 2 == 0, F.col("collection")).alias("nomeCollezione"), F.when(F.col("acts") % 2 == 1, F.col("collection")).alias("nome"), F.col("variant").alias("formato"), F.col("acts").alias("numeroAtti"), F.col("created").alias("dataCreazione"))
    named.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(where)  # a catalogue has some dozen rows
    return files.read_catalogue(t.spark, where)


@register("s12_read_feed", "select 'Act ' || event_id as title, ts::date::varchar as pub_date, 'http://x/' || event_id as link, substring(rtrim(repeat(event_type || ' ', 40)), 1, 240) as description from events")
def _(t):
    where = f"{shared_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    items = t.events.select(F.concat(F.lit("Act "), "event_id").alias("title"), F.to_date("ts").cast("string").alias("pubDate"), F.concat(F.lit("http://x/"), "event_id").alias("link"), F.repeat(F.concat("event_type", F.lit(" ")), 40).alias("description"))
    files.write_feed(items, where)
    return files.read_feed(t.spark, where)


SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: What XML cannot hold becomes a blank, as do carriage returns, which a parser would change.
UNFIT = r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{FFFE}\x{FFFF}]"


@register("x01_parse_texts", rf"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '{UNFIT}', ' ', 'g') as body from documents),
 p as (select doc_id, regexp_replace(regexp_replace(body, '^{SPACE}', ''), '{SPACE}\z', '') as body from d)
 select 'urn:nir:stato:legge:' || (1950 + doc_id % 70) || '-01-02;' || doc_id as urn, 'A ' || doc_id as num, trim('A ' || doc_id || body) as text from p""")
def _(t):
    """Every whole text as an article's body, escaped, through the parser."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), UNFIT, " ")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(mark), F.lit(entity))
    doc = F.col("doc_id").cast("string")
    urn = F.concat(F.lit("urn:nir:stato:legge:"), (1950 + F.col("doc_id") % 70).cast("string"), F.lit("-01-02;"), doc)
    head = F.concat(F.lit(f'<akomaNtoso {AKN_NS}><act><meta><identification><FRBRalias name="urn:nir" value="'), urn, F.lit('"/></identification></meta><body><part><article eId="a1"><heading>A '), doc)
    content = F.concat(head, F.lit("</heading><p>"), body, F.lit("</p></article></part></body></act></akomaNtoso>")).cast("binary")
    entries = t.documents.select(F.lit("z").alias("zip"), F.concat(doc, F.lit(".xml")).alias("entry"), content.alias("content"))
    return files.explode_articles(files.parse_akn(entries)).select("urn", "num", "text")
