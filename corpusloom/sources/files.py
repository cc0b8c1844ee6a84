"""Scans and sinks over files. Reads name their schema; nothing is inferred."""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.graph import with_degrees
from corpusloom.shipping import ship

CITATION = "struct<target_urn: string, cited_urn: string, ref: string, article: string>"
#: Every name a producer of act records uses.
LAW_SCHEMA = (
    "urn string, id string, law_id string, title string, titolo string, type string, tipo string, date string, data string, publication_date string, published_date string, "
    "year string, text string, testo string, text_length long, article_count int, status string, source_collection string, parsed_at string, date_in_force string, date_out_of_force string, "
    "is_current boolean, modifies string, citations string, articles array<struct<num: string, eId: string, text: string>>, _corrupt_record string"
)
BAD = "_corrupt_record"


def read_laws(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Act records of JSON lines under canonical names, and the number of bad lines. Blank lines are skipped.

    Citations may be objects or bare strings; `modifies` may be a string or a list."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", LAW_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), F.col("_metadata.file_name").alias("src_file")).select("r.*", "src_file")
    bad = parsed.agg(F.count_if(F.col(BAD).isNotNull()).alias("bad_lines"))
    rows = parsed.filter(F.col(BAD).isNull())
    name = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    objects = F.from_json("citations", f"array<{CITATION}>", {"mode": "PERMISSIVE"})
    strings = F.transform(F.from_json("citations", "array<string>"), lambda x: F.named_struct(F.lit("target_urn"), x, F.lit("cited_urn"), F.lit(None).cast("string"), F.lit("ref"), F.lit(None).cast("string"), F.lit("article"), F.lit(None).cast("string")))
    bare = F.col("citations").rlike(r'^\s*\[\s*"')
    laws = rows.select(
        name("urn", "id", "law_id").alias("urn"),
        name("title", "titolo").alias("title"),
        name("type", "tipo").alias("type"),
        name("date", "data", "publication_date").alias("date"),
        "published_date",
        F.coalesce(F.col("year").try_cast("int"), F.left(name("date", "data", "publication_date"), F.lit(4)).try_cast("int")).alias("year"),
        F.coalesce("text", "testo").alias("text"),
        "text_length",
        "article_count",
        "status",
        "source_collection",
        "date_in_force",
        "date_out_of_force",
        "is_current",
        F.when(F.col("modifies").startswith("["), F.from_json("modifies", "array<string>")).when(F.col("modifies").isNotNull(), F.array("modifies")).alias("modifies"),
        F.when(bare, strings).otherwise(objects).alias("citations"),
        "articles",
        "src_file",
    )
    return laws, bad


EMPTY_ZIP = 22
#: Bytes of contents that a task passes on or parses together.
TOGETHER = 2 << 20


def _member(file, offset: int, packed: int, method: int, crc: int) -> bytes | None:
    """One member of an archive from its own byte range; None if it is damaged or packed in another way."""
    head = file.read_at(30, offset)
    if len(head) < 30 or head[:4] != b"PK\x03\x04" or int.from_bytes(head[6:8], "little") & 1:
        return None
    begin = offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    data = file.read_at(packed, begin)
    try:
        data = data if method == zipfile.ZIP_STORED else zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else None
    except zlib.error:
        return None
    return data if data is not None and zlib.crc32(data) == crc else None


def read_zip_entries(spark: SparkSession, path: str, suffix: str = ".xml", task_bytes: int = 32 << 20) -> DataFrame:
    """zip, entry, pos and content of every file with the suffix in ZIP archives; broken archives and entries are skipped.

    Archives of any size: one pass reads their directories only, the members are then dealt out by their bytes, about
    `task_bytes` a task, and each is read by its own byte range. The store must be one that Arrow can open."""
    from corpusloom.sources.tables import checkpointed

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")

    def directory(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "entry", "pos", "at", "packed", "method", "crc"]
        for frame in frames:
            for uri in frame["path"]:
                system, where = fs.FileSystem.from_uri(uri)
                try:
                    with system.open_input_file(where) as file:
                        infos = zipfile.ZipFile(file).infolist() if file.size() >= EMPTY_ZIP else []
                except zipfile.BadZipFile:
                    continue
                rows = [(uri, i.filename, pos, i.header_offset, i.compress_size, i.compress_type, i.CRC) for pos, i in enumerate(infos) if i.filename.lower().endswith(suffix)]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=names)

    members = checkpointed(files.mapInPandas(directory, "path string, entry string, pos int, at long, packed long, method int, crc long"))
    total = members.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    task = max(1 << 20, min(task_bytes, total // (4 * spark.sparkContext.defaultParallelism)))
    dealt = members.withColumn("stripe", F.expr(f"at div {task}")).repartition(max(1, -(-total // task)), "path", "stripe").sortWithinPartitions("path", "at")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, opened, rows, size = None, None, [], 0
        names = ["zip", "entry", "pos", "content"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.path != opened:
                    system, where = fs.FileSystem.from_uri(r.path)
                    file, opened = system.open_input_file(where), r.path
                data = _member(file, r.at, r.packed, r.method, r.crc)
                if data is not None:
                    rows.append((r.path.rsplit("/", 1)[-1], r.entry, r.pos, data))
                    size += len(data) + 100
                if size >= TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return dealt.mapInPandas(read, "zip string, entry string, pos int, content binary")


def read_xml_dir(spark: SparkSession, path: str) -> DataFrame:
    """file, size_bytes, sha256 and xml (text) of every XML file below a directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("xml"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """collection, variant, acts, created of catalogue JSON, under either set of names."""
    schema = "nomeCollezione string, nome string, formatoCollezione string, formato string, numeroAtti long, dataCreazione string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(F.coalesce("nomeCollezione", "nome").alias("collection"), F.coalesce("formatoCollezione", "formato").alias("variant"), F.coalesce("numeroAtti", F.lit(0)).alias("acts"), F.col("dataCreazione").alias("created"))


def read_feed(spark: SparkSession, path: str, most: int = 240) -> DataFrame:
    """title, pub_date, link and description (cut) of every item of a feed."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, pubDate string, link string, description string").load(path)
    return rows.select("title", F.col("pubDate").alias("pub_date"), "link", F.left(F.coalesce("description", F.lit("")), F.lit(most)).alias("description"))


AKN = "{http://docs.oasis-open.org/legaldocml/ns/akn/3.0}"
ARTICLES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("num", "eId", "text")]))
ACT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("zip", "entry", "urn", "title", "date", "type", "text")] + [T.StructField("articles", ARTICLES)])

_TEXTS = [(n, pa.string()) for n in ("zip", "entry", "urn", "title", "date", "type", "text")]
ACT_ARROW = pa.schema([*_TEXTS, ("articles", pa.list_(pa.struct([(n, pa.string()) for n in ("num", "eId", "text")])))])


def _text_of(element: ElementTree.Element, glue: str) -> str:
    """All text below an element, each element's part stripped and joined by the glue."""
    parts = [element.text or ""]
    for child in element:
        parts += [_text_of(child, glue), child.tail or ""]
    return (glue.join(p for p in parts if p) if glue else "".join(parts)).strip()


def _act_of(content: bytes, glue: str) -> dict | None:
    """Fields of one act; None without an act element or for XML that cannot be read."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return None
    act = root if root.tag == f"{AKN}act" else root.find(f".//{AKN}act")
    if act is None:
        return None
    # by local name: publishers put the spans into namespaces of their own
    with_name = lambda tag, key, value: next((e for e in act.iter() if e.get(key) == value and str(e.tag).rpartition("}")[2] == tag), None)
    alias = with_name("FRBRalias", "name", "urn:nir")
    title = with_name("span", "property", "eli:title")
    kind = with_name("span", "property", "eli:type_document")
    date = act.find(f".//{AKN}FRBRdate")
    body = act.find(f".//{AKN}body")
    articles, seen = [], set()
    for pos, article in enumerate(body.iter(f"{AKN}article") if body is not None else ()):
        key = article.get("eId") or pos
        if key in seen:  # an article below a part is found once
            continue
        seen.add(key)
        heading = article.find(f"{AKN}heading")
        num = _text_of(heading, "") if heading is not None else ""
        articles.append({"num": num or article.get("eId"), "eId": article.get("eId"), "text": _text_of(article, glue)})
    return {
        "urn": alias.get("value") if alias is not None else None,
        "title": (title.get("content") or "").strip() if title is not None else None,
        "date": date.get("date") if date is not None else None,
        "type": (kind.get("resource") or "").rsplit("#", 1)[-1] if kind is not None else None,
        "text": _text_of(body, glue) if body is not None else "",
        "articles": articles,
    }


def _acts_of(frames: Iterator[pa.RecordBatch], glue: str) -> Iterator[pa.RecordBatch]:
    """Acts of batches (zip, entry, content), some TOGETHER bytes of contents at a time: Python never holds a batch's contents and acts at once."""
    rows, size = [], 0
    for frame in frames:
        for zip_name, entry, content in zip(*(frame.column(c) for c in ("zip", "entry", "content")), strict=True):
            data = content.as_py()
            found = _act_of(data, glue)
            if found is not None:
                rows.append({"zip": zip_name.as_py(), "entry": entry.as_py(), **found})
            size += len(data)
            if size >= TOGETHER:
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ACT_ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ACT_ARROW)


def parse_akn(entries: DataFrame, variant: str = "act", most: int = 100_000) -> DataFrame:
    """Acts of XML entries (zip, entry, content); entries without an act are dropped.

    variant "abrogated": acts without urn are dropped, a missing title is "Atto del <date>", the year comes from the
    date or the urn, the text is cut but text_length is its whole length, and the status is abrogated."""
    ship(entries.sparkSession)
    glue = " " if variant == "abrogated" else ""

    acts = entries.select("zip", "entry", "content").mapInArrow(lambda frames: _acts_of(frames, glue), ACT_SCHEMA)
    acts = acts.withColumn("article_count", F.size("articles"))
    year = F.left("date", F.lit(4)).try_cast("int")
    if variant != "abrogated":
        return acts.withColumns({"text_length": F.length("text").cast("long"), "year": year})
    acts = acts.filter("urn is not null and urn <> ''")
    from_urn = F.nullif(F.regexp_extract("urn", r":(\d{4})-", 1), F.lit("")).try_cast("int")
    return acts.withColumns(
        {
            "title": F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Atto del "), F.coalesce("date", F.lit("")))),
            "year": F.coalesce(year, from_urn),
            "text_length": F.length("text").cast("long"),
            "text": F.left("text", F.lit(most)),
            "status": F.lit("abrogated"),
        }
    )


def explode_articles(acts: DataFrame) -> DataFrame:
    """urn, pos, num, eId and text of every article."""
    return acts.select("urn", F.posexplode("articles").alias("pos", "a")).select("urn", "pos", "a.*")


def write_laws(laws: DataFrame, path: str, ordered: bool = False) -> None:
    """JSON lines, by urn if asked for (a range-partitioned sort, no single task)."""
    (laws.orderBy("urn") if ordered else laws).write.mode("overwrite").json(path)


#: Quotes are doubled inside quoted fields.
CSV = {"header": "true", "escape": '"'}


def csv_rows(laws: DataFrame, cit: DataFrame, k: int | None = None) -> DataFrame:
    """What export_csv writes."""
    rows = with_degrees(laws, cit).select(
        F.col("urn").alias("URN"), F.col("title").alias("Title"), F.col("type").alias("Type"), F.col("date").alias("Date"), F.col("year").alias("Year"), F.col("article_count").alias("Articles"),
        F.col("text_length").alias("Text_Length"), F.col("status").alias("Status"), F.col("importance_score").alias("Importance"), F.col("citations_in").alias("Citations_In"), F.col("citations_out").alias("Citations_Out"),
    )
    rows = rows.orderBy(F.desc_nulls_last("Year"), F.asc_nulls_last("Title"), "URN")
    return rows.limit(k) if k else rows


def export_csv(laws: DataFrame, cit: DataFrame, path: str, k: int | None = None) -> None:
    csv_rows(laws, cit, k).write.mode("overwrite").options(**CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """What export_csv wrote."""
    schema = "URN string, Title string, Type string, Date string, Year int, Articles int, Text_Length long, Status string, Importance double, Citations_In long, Citations_Out long"
    return spark.read.schema(schema).options(**CSV).csv(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, min_citations: int | None = None) -> None:
    """Nodes, edges and, from what was written, their numbers."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    count = lambda name: spark.read.text(f"{path}/{name}").agg(F.count("*").alias(name))
    stats = count("nodes").crossJoin(count("edges"))  # a row each
    stats.withColumn("min_citations", F.lit(min_citations)).write.mode("overwrite").json(f"{path}/stats")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What export_graph wrote: nodes, edges, stats."""
    schemas = {"nodes": "id string, title string, type string, year int, size long", "edges": "source string, target string, weight long", "stats": "nodes long, edges long, min_citations int"}
    return tuple(spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items())


def write_tracks(separated: DataFrame, path: str) -> None:
    """Each track of separated acts as JSON lines, the latest year first, then urn, both as strings and descending.

    A sort by ranges over both tracks, so the files of a track are in order and no task holds one."""
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    rows = separated.repartitionByRange("track", year.desc(), F.desc("urn")).sortWithinPartitions("track", year.desc(), F.desc("urn"))
    rows.write.mode("overwrite").partitionBy("track").json(path)


def read_track(spark: SparkSession, path: str, track: str, schema: str) -> DataFrame:
    """One track in the order in which it was written: file by file, with its place from 0."""
    rows = spark.read.schema(schema).json(f"{path}/track={track}").withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()})
    sizes = rows.groupBy("__file", "__at").agg(F.count("*").alias("n"), F.min("__id").alias("first"))  # a row a split of a file
    starts = sizes.select("__file", "__at", "first", (F.sum("n").over(Window.orderBy("__file", "__at")) - F.col("n")).alias("before"))
    placed = rows.join(F.broadcast(starts), ["__file", "__at"]).withColumn("place", F.col("before") + F.col("__id") - F.col("first"))
    return placed.drop("__file", "__at", "__id", "first", "before")


def citation_index(laws: DataFrame) -> DataFrame:
    """Acts with citations: urn, title, citations, count."""
    return laws.filter(F.size("citations") > 0).select("urn", "title", "citations", F.size("citations").cast("long").alias("count"))


def citation_index_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("acts_with_citations"), F.coalesce(F.sum("count"), F.lit(0)).alias("citations"))


def append_log(rows: DataFrame, path: str, day: str = "timestamp") -> None:
    """Appends events below one directory a day."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON document a metric (see metrics_document)."""
    metrics.write.mode("overwrite").json(path)


def manifest(rows: DataFrame) -> DataFrame:
    """The last entry of each file name."""
    last = Window.partitionBy("filename").orderBy(F.desc("downloaded_at"), "sha256")
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


POINTER = re.compile(r"^v=\d{14}-\w+$")


def promote(staging: DataFrame, root: str, version: str) -> str:
    """Writes the staging rows as a new version below root and points CURRENT at it; earlier versions are the backup.

    Pointers are only added, after their data, and the newest one counts: a reader sees the old version or all of the
    new, at any time."""
    if not POINTER.match(f"v={version}"):
        raise ValueError("a version is yyyymmddhhmmss-name")
    target = f"{root}/v={version}"
    staging.write.mode("errorifexists").parquet(target)
    staging.sparkSession.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/CURRENT")
    return target


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version promoted last."""
    version = spark.read.schema("at timestamp, version string").json(f"{root}/CURRENT").agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    return spark.read.parquet(f"{root}/v={version}")


def write_zips(entries: DataFrame, folder: str, most: int = 1 << 30) -> DataFrame:
    """Packs (entry, content) rows into ZIP archives named for the attempt, about `most` bytes each; (zip, entries)."""
    ship(entries.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, out, archive, n, size = "", None, None, 0, 0
        for frame in frames:
            for entry, content in zip(frame["entry"], frame["content"], strict=True):
                if archive is None:
                    name, n, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(entry, bytes(content))
                n, size = n + 1, size + archive.filelist[-1].compress_size
                if size >= most:
                    archive.close()
                    out.close()
                    yield pd.DataFrame({"zip": [name], "entries": [n]})
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
            yield pd.DataFrame({"zip": [name], "entries": [n]})

    return entries.select("entry", "content").mapInPandas(pack, "zip string, entries long")


def write_feed(items: DataFrame, path: str) -> None:
    """Items as feed XML."""
    items.write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
