"""Search and retrieval over acts.

Ranked search is BM25 over title, type and text. It runs on a stored index (build_index), of which a query reads the
postings of its own terms and the acts that it returns, or without one on the acts themselves, in one pass that counts
the query's terms only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators.adjacency import Adjacency
from corpusloom.operators.graph import in_out, with_degrees
from corpusloom.operators.mining import query_words
from corpusloom.sources.tables import checkpointed

K1, B = 1.2, 0.75
#: Up to so many acts are looked up in the index by their urns, which the driver then sees.
LOOKUP = 1000
#: Acts of a bucket, about; at least LEAST buckets, so that small corpora are read by several tasks, too.
PER_BUCKET, LEAST = 2_000, 16
POSTINGS = "urn string, length int, term string, tf long, bucket int"


def query_terms(query: str) -> list[str]:
    """Folded terms of a query, all of which must match; a term with an underscore is several terms."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(part for word in query_words(plain) for part in word.split("_") if part))


def _searched(cut: int | None) -> Column:
    """What is searched of an act; `cut` limits the text to its first characters."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("type", F.lit("")), text if cut is None else F.left(text, F.lit(cut)))


def postings(laws: DataFrame, cut: int | None = None) -> DataFrame:
    """urn, length (tokens), term, tf of every term of every act."""
    rows = laws.select("urn", fx.raw_tokens(_searched(cut)).alias("t")).select("urn", F.size("t").alias("length"), F.explode("t").alias("term"))
    return rows.select("urn", "length", fx.folded_token(F.col("term")).alias("term")).groupBy("urn", "length", "term").agg(F.count("*").alias("tf"))


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(name), "UTF-8")), F.lit(buckets)).cast("int")


@dataclass
class Acts:
    """Stored acts: all columns and bucket, by hash of urn."""

    acts: DataFrame
    buckets: int

    def lookup(self, urns: list[str]) -> DataFrame:
        """Some acts by urn, read from their buckets only."""
        here = sorted({zlib.crc32(u.encode()) % self.buckets for u in urns})
        return self.acts.filter(F.col("bucket").isin(here) & F.col("urn").isin(urns)).drop("bucket")


@dataclass
class Index(Acts):
    """A stored index: acts, postings (bucket, term, urn, length, tf), and the corpus totals."""

    postings: DataFrame
    total: int
    mean: float

    def terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their buckets' files are read, and of these the row groups that may hold them."""
        here = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.postings.filter(F.col("bucket").isin(here) & F.col("term").isin(terms)).select("urn", "length", "term", "tf")


def _write(rows: DataFrame, path: str, *order: str) -> None:
    """Rows in folders by bucket, each file sorted. Adaptive execution cuts what is large, so a bucket is no task's limit."""
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def store_acts(laws: DataFrame, path: str, buckets: int | None = None) -> Acts:
    """Stores acts with a urn below the path, for look-ups. The number of buckets follows the acts."""
    buckets = buckets or max(LEAST, min(4096, laws.filter("urn is not null").count() // PER_BUCKET))
    _write(laws.filter("urn is not null").withColumn("bucket", _bucket("urn", buckets)), f"{path}/acts", "urn")
    return Acts(laws.sparkSession.read.parquet(f"{path}/acts"), buckets)


def _counted(rows: DataFrame, cut: int | None) -> DataFrame:
    """postings() of acts whose urns differ, without an exchange: an act's sorted tokens are counted in its row."""
    found = rows.select("urn", fx.raw_tokens(_searched(cut)).alias("t")).filter(F.size("t") > 0)
    found = found.select("urn", F.size("t").alias("length"), F.sort_array(F.transform("t", fx.folded_token)).alias("t"))
    begins = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    found = found.withColumn("at", begins)
    each = F.transform("at", lambda i, n: F.struct(F.get("t", i - 1).alias("term"), (F.coalesce(F.get("at", n + 1), F.col("length") + 1) - i).cast("long").alias("tf")))
    return found.select("urn", "length", F.inline(each))


def build_index(laws: DataFrame, path: str, buckets: int | None = None, cut: int | None = None) -> Index:
    """Stores the index of acts with a urn below the path: tables in buckets by hash of term and of urn, each sorted."""
    spark = laws.sparkSession
    stored_acts = store_acts(laws, path, buckets)
    rows, buckets = stored_acts.acts, stored_acts.buckets
    twice = not rows.groupBy("urn").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    tf = postings(rows, cut) if twice else _counted(rows, cut)
    _write(tf.withColumn("bucket", _bucket("term", buckets)), f"{path}/postings", "term", "urn")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    # an act without a token has no posting, but counts
    totals = rows.agg(F.count("*").alias("total")).crossJoin(stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")))  # one row each
    totals.select("total", "tokens", F.lit(buckets).alias("buckets")).write.json(f"{path}/totals")
    return open_index(laws.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    totals = spark.read.schema("total long, tokens long, buckets int").json(f"{path}/totals").first()
    acts, tf = spark.read.parquet(f"{path}/acts"), spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return Index(acts, totals["buckets"], tf, totals["total"], totals["tokens"] / max(totals["total"], 1))


def _variants(term: str) -> str:
    """A pattern of the term with or without accents."""
    by_letter: dict[str, str] = {}
    for accented, plain in fx.FOLDED.items():
        by_letter[plain] = by_letter.get(plain, "") + accented
    return "".join(f"[{c}{by_letter[c]}]" if c in by_letter else re.escape(c) for c in term)


def _scanned(laws: DataFrame, terms: list[str], cut: int | None) -> tuple[DataFrame, int, float]:
    """urn, length, term, tf of some terms in all acts, the number of acts and their mean length, in one pass."""
    low = F.lower(_searched(cut))
    # what stands before a term is looked at only where the term is
    pattern = "(?s)(" + "|".join(rf"{_variants(t)}(?<![\p{{L}}\p{{N}}].{{{len(t)}}})" for t in terms) + r")(?![\p{L}\p{N}])"
    rows = laws.select("urn", F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("length"), F.regexp_extract_all(low, F.lit(pattern), 1).alias("t"))
    counts = F.transform(F.array(*map(F.lit, terms)), lambda w: F.struct(w.alias("term"), F.size(F.filter("t", lambda x: fx.unaccented(x) == w)).cast("long").alias("tf")))
    rows = checkpointed(rows.select("urn", "length", F.filter(counts, lambda x: x["tf"] > 0).alias("c")))
    totals = rows.agg(F.count("*").alias("total"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()
    return rows.select("urn", "length", F.explode("c").alias("x")).select("urn", "length", "x.term", "x.tf"), totals["total"], totals["mean"]


def _bm25(tf: Column, length: Column, n: Column, total: int, mean: float) -> Column:
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _parts(source: DataFrame | Index, terms: list[str], cut: int | None) -> DataFrame:
    """urn, term and the term's part of the score, for each act and term of the list that it has."""
    rows, total, mean = (source.terms(terms), source.total, source.mean) if isinstance(source, Index) else _scanned(source, terms, cut)
    n = rows.groupBy("term").agg(F.count("*").alias("n"))  # as many rows as terms
    return rows.join(F.broadcast(n), "term").select("urn", "term", _bm25(F.col("tf"), F.col("length"), F.col("n"), total, max(mean, 1e-9)).alias("part"))


def scores(source: DataFrame | Index, query: str, cut: int | None = None) -> DataFrame:
    """urn and score (6 decimals) of the acts that match every term; an empty query matches nothing."""
    terms = query_terms(query)
    if not terms:
        acts = source.acts if isinstance(source, Index) else source
        return acts.select("urn").filter(F.lit(False)).withColumn("score", F.lit(0.0))
    found = _parts(source, terms, cut).groupBy("urn").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("found"))
    return found.filter(F.col("found") == len(terms)).drop("found")


def ranked(source: DataFrame | Index, query: str, cut: int | None = None) -> DataFrame:
    """The matching acts with all columns and score."""
    acts = source.acts.drop("bucket") if isinstance(source, Index) else source
    return acts.join(scores(source, query, cut), "urn")


def search(source: DataFrame | Index, query: str, k: int = 50, cut: int | None = None) -> DataFrame:
    """The k best acts. Only they are looked up in the acts."""
    best = scores(source, query, cut).orderBy(F.desc("score"), "urn").limit(k)
    if not isinstance(source, Index) or k > LOOKUP:
        acts = source.acts.drop("bucket") if isinstance(source, Index) else source
        best = best if k > LOOKUP else F.broadcast(best)
        return acts.join(best, "urn").orderBy(F.desc("score"), "urn").limit(k)
    rows = [tuple(r) for r in best.collect()]  # at most k
    found = source.acts.sparkSession.createDataFrame(rows, "urn string, score double")
    return source.lookup([u for u, _ in rows]).join(F.broadcast(found), "urn").orderBy(F.desc("score"), "urn")


def search_snippets(source: DataFrame | Index, query: str, k: int = 50, width: int = 40, cut: int | None = None) -> DataFrame:
    """The k best acts with urn, title, score and snippet, in one call."""
    best = search(source, query, k, cut)
    return snippet(best, query_terms(query), width, ("title", "score")).orderBy(F.desc("score"), "urn")


def snippet(hits: DataFrame, terms: list[str], width: int = 40, carried: tuple[str, ...] = ()) -> DataFrame:
    """urn, the carried columns, and the window of `width` words of text with the most matches (the first of equals), matches in <b>.

    Only the places of matches are compared: the first of the best windows ends with a match, or begins the text. It
    takes two pointers' work, one look at each match for each match within a window of it."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    rows = hits.select("urn", *carried, words.alias("w"))
    match = lambda x: F.exists(fx.tokens(x), lambda y: y.isin(terms))
    places = F.filter(F.transform("w", lambda x, i: F.when(match(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places).withColumn("n", F.size("w"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    # a window that begins at max(0, p - width + 1) is the first to hold the match at p; matches of a window lie close together in the list
    start = lambda p: F.least(F.greatest(p - width + 1, F.lit(0)), last)
    inside = lambda p, i: F.size(F.filter(F.slice("places", F.greatest(i + 2 - width, F.lit(1)), F.lit(2 * width)), lambda x: (x >= start(p)) & (x < start(p) + width)))
    windows = F.transform("places", lambda p, i: F.struct((-inside(p, i)).alias("less"), start(p).alias("at")))
    rows = rows.withColumn("at", F.coalesce(F.array_min(windows)["at"], F.lit(0)))
    part = F.transform(F.slice("w", F.col("at") + 1, F.lit(width)), lambda x: F.when(match(x), F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x))
    text = F.concat(F.when(F.col("at") > 0, "...").otherwise(""), F.array_join(part, " "), F.when(F.col("at") + width < F.col("n"), "...").otherwise(""))
    return rows.select("urn", *carried, text.alias("snippet"))


def search_like(laws: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Acts whose title or text holds the query, in any case, by importance. % and _ stand for themselves."""
    low = query.lower()
    rows = laws.filter(F.lower("title").contains(low) | F.lower("text").contains(low))
    return rows.select("urn", "title", "importance_score").orderBy(F.desc("importance_score"), "urn").limit(k)


SORTS = {
    "relevance": [F.desc, "score"],
    "citations": [F.desc, "citations_in"],
    "year_desc": [F.desc_nulls_last, "year"],
    "year_asc": [F.asc_nulls_last, "year"],
    "title": [F.asc_nulls_last, "title"],
    "articles": [F.desc_nulls_last, "article_count"],
    "importance": [F.desc_nulls_last, "importance_score"],
}


def search_filtered(
    source: DataFrame | Index, cit: DataFrame | Adjacency, query: str = "", kind=None, year_from=None, year_to=None, articles_from=None, articles_to=None, status=None, min_citations=None, sort_by: str = "relevance", k: int = 50
) -> DataFrame:
    """Search with filters and a sort order; without a query, relevance means incoming citations.

    Degrees come from a stored adjacency, or are counted over the edges of the hits."""
    acts = source.acts if isinstance(source, Index) else source
    rows = ranked(source, query) if query_terms(query) else acts.withColumn("score", F.lit(0.0))
    for column, test, value in (("type", "=", kind), ("year", ">=", year_from), ("year", "<=", year_to), ("article_count", ">=", articles_from), ("article_count", "<=", articles_to), ("status", "=", status)):
        if value is not None:
            rows = rows.filter({"=": F.col(column) == value, ">=": F.col(column) >= value, "<=": F.col(column) <= value}[test])
    rows = rows.select("urn", "title", "type", "year", "score", "article_count", "importance_score")
    if isinstance(cit, Adjacency):
        rows = rows.join(cit.degrees, "urn", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations_in", "citations_out")})
    elif query_terms(query):
        rows = checkpointed(rows)  # the hits meet the edges before these are counted
        of = lambda c: cit.join(rows.select(F.col("urn").alias(c)), c, "left_semi").select("citing_urn", "cited_urn")
        inn, out = in_out(of("cited_urn"))[0], in_out(of("citing_urn"))[1]
        rows = rows.join(inn, "urn", "left").join(out, "urn", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations_in", "citations_out")})
    else:
        rows = with_degrees(rows, cit)
    if min_citations is not None:
        rows = rows.filter(F.col("citations_in") >= min_citations)
    direction, column = SORTS["citations" if sort_by == "relevance" and not query_terms(query) else sort_by]
    return rows.select("urn", "title", "type", "year", "score", "citations_in", "citations_out", "article_count", "importance_score").orderBy(direction(column), "urn").limit(k)


def refine(results: DataFrame, status: str | None = None, kind: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Filters on results that are already cut to the best."""
    if status:
        results = results.filter(fx.normalized_status(F.col("status")) == status)
    if kind:
        results = results.filter(F.lower("type").contains(kind.lower()))
    if year_from is not None:
        results = results.filter(F.col("year") >= year_from)
    if year_to is not None:
        results = results.filter(F.col("year") <= year_to)
    return results


def search_many(source: DataFrame | Index, topics: dict[str, str], k: int = 10, status: str | None = "in_force", cut: int | None = None) -> DataFrame:
    """The k best acts of each named query (filtered by status after ranking): topic, urn, score, rank.

    The terms of all queries are read or counted together; (topic, term) pairs are a constant table."""
    acts = source.acts if isinstance(source, Index) else source
    table = [(topic, term, len(terms)) for topic, query in topics.items() if (terms := query_terms(query)) for term in terms]
    # as many rows as the caller gave terms
    pairs = F.broadcast(acts.sparkSession.createDataFrame(table, "topic string, term string, terms int"))
    parts = _parts(source, sorted({term for _, term, _ in table}) or [""], cut)
    found = parts.join(pairs, "term").groupBy("topic", "terms", "urn").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("found")).filter("found = terms")
    if status:
        known = acts.select("urn", fx.normalized_status(F.col("status")).alias("status")).filter(F.col("status") == status)
        found = found.join(known, "urn", "left_semi")
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "urn")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("topic", "urn", "score", "rank")


def evidence(source: DataFrame | Index, query: str, k: int = 8, pool: int = 100, include_abrogated: bool = False) -> DataFrame:
    """One text that lists the best acts with their status."""
    best = search(source, query, pool).withColumn("known", fx.normalized_status(F.col("status")))
    if not include_abrogated:
        best = best.filter("known = 'in_force'")
    best = best.orderBy(F.desc("score"), "urn").limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "urn")))  # at most k rows
    line = F.format_string("%d. [%s] %s (%s) - %s", "rank", fx.status_label(F.col("status")), F.coalesce("title", F.lit("N/A")), F.coalesce(F.col("year").cast("string"), F.lit("N/A")), "urn")
    rows = best.agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.count("*").alias("n"), F.count_if(F.col("known") == "in_force").alias("v"), F.count_if(F.col("known") == "abrogated").alias("a")
    )
    head = F.format_string(f"Query: {query}\nEvidence considered: %d laws (%d in force, %d abrogated).\n\n", "n", "v", "a")
    return rows.select(F.concat(head, F.array_join(F.col("l.line"), "\n")).alias("evidence"))


BROWSE = {"year_desc": SORTS["year_desc"], "year_asc": SORTS["year_asc"], "title": SORTS["title"], "articles": SORTS["articles"], "importance": SORTS["importance"]}


def browse(laws: DataFrame, kind=None, year=None, status=None, sort_by: str = "year_desc", page: int = 0, size: int = 25, preview: int = 2000) -> DataFrame:
    """One page of acts with a preview of the text."""
    rows = laws.withColumn("status", fx.normalized_status(F.col("status")))
    for column, value in (("type", kind), ("year", year), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    direction, column = BROWSE[sort_by]
    rows = rows.orderBy(direction(column), "urn").offset(page * size).limit(size)
    return rows.select("urn", "title", "type", "year", "status", F.left("text", F.lit(preview)).alias("preview"))


def get_law(laws: DataFrame, cit: DataFrame, am: DataFrame, meta: DataFrame, urn: str) -> DataFrame:
    """One act with its counts and metadata."""
    one = laws.filter(F.col("urn") == urn).select("urn", "title", "type", "year", "status")
    count = lambda df, c, name: df.filter(F.col(c) == urn).groupBy(F.col(c).alias("urn")).agg(F.count("*").alias(name))
    for df, c, name in ((cit, "cited_urn", "citations_in"), (cit, "citing_urn", "citations_out"), (am, "urn", "amendments")):
        one = one.join(count(df, c, name), "urn", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return one.join(meta.filter(F.col("urn") == urn).select("urn", "domain_cluster", "pagerank"), "urn", "left")


def find_first(laws: DataFrame, rules: list[Column], k: int = 1) -> DataFrame:
    """The first k acts by urn of the first rule that any act meets."""
    rank = F.coalesce(*(F.when(rule, i) for i, rule in enumerate(rules)))
    rows = laws.withColumn("rule", rank).filter("rule is not null")
    best = rows.agg(F.min("rule").alias("r")).select("r").scalar()
    return rows.filter(F.col("rule") == best).select("rule", "urn", "title").orderBy("urn").limit(k)


def lookup_landmarks(laws: DataFrame, cit: DataFrame, marks: list[tuple[str, str]]) -> DataFrame:
    """label, pattern, urn, title, citations_in of a list of (label, urn or prefix ending in *); the first urn that fits."""
    spark = laws.sparkSession
    table = F.broadcast(spark.createDataFrame([(a, b, b.rstrip("*"), b.endswith("*")) for a, b in marks], "label string, pattern string, stem string, prefix boolean"))
    fits = F.when(F.col("prefix"), F.col("urn").startswith(F.col("stem"))).otherwise(F.col("urn") == F.col("stem"))
    hits = laws.select("urn", "title").join(table, fits).groupBy("label").agg(F.min(F.struct("urn", "title")).alias("hit"))
    rows = table.join(hits, "label", "left").select("label", "pattern", "hit.urn", "hit.title")
    counts = cit.join(F.broadcast(rows.select(F.col("urn").alias("cited_urn")).filter("cited_urn is not null").distinct()), "cited_urn").groupBy(F.col("cited_urn").alias("urn")).agg(F.count("*").alias("citations_in"))
    return rows.join(counts, "urn", "left").select("label", "pattern", "urn", "title", F.coalesce("citations_in", F.lit(0)).alias("citations_in"))


def law_types(laws: DataFrame) -> DataFrame:
    return laws.select("type").filter("type is not null").distinct().orderBy("type")


def year_range(laws: DataFrame, first: int = 1861, last: int = 2026) -> DataFrame:
    return laws.filter("year > 0").agg(F.coalesce(F.min("year"), F.lit(first)).alias("min_year"), F.coalesce(F.max("year"), F.lit(last)).alias("max_year"))


def top_important(laws: DataFrame, k: int = 15) -> DataFrame:
    return laws.filter("importance_score > 0").select("urn", "title", "importance_score").orderBy(F.desc("importance_score"), "urn").limit(k)


def same_domain(laws: DataFrame, meta: DataFrame, urn: str, k: int = 15) -> DataFrame:
    """Other acts of an act's domain by importance."""
    mine = meta.filter(F.col("urn") == urn).agg(F.min("domain_cluster").alias("domain_cluster"))  # one row
    peers = meta.filter(F.col("urn") != urn).join(F.broadcast(mine), "domain_cluster").select("urn", "domain_cluster")
    return peers.join(laws.select("urn", "title", "importance_score"), "urn").orderBy(F.desc_nulls_last("importance_score"), "urn").limit(k)


def same_legislature(laws: DataFrame, urn: str, k: int = 15) -> DataFrame:
    """Other acts of an act's parliamentary term by importance."""
    rows = laws.select("urn", "title", "importance_score", fx.legislature(F.col("year")).alias("legislature"))
    mine = rows.filter(F.col("urn") == urn).agg(F.min("legislature").alias("legislature"))  # one row
    return rows.filter(F.col("urn") != urn).join(F.broadcast(mine), "legislature").orderBy(F.desc_nulls_last("importance_score"), "urn").limit(k)


def topic_top(laws: DataFrame, topics: list[tuple[str, str, int, int]], k: int = 5) -> DataFrame:
    """The k most important acts of each (label, type pattern, year from, year to)."""
    table = F.broadcast(laws.sparkSession.createDataFrame(topics, "label string, pattern string, first int, last int"))
    hits = laws.join(table, F.expr("lower(type) like lower(pattern) and year between first and last"))
    order = Window.partitionBy("label").orderBy(F.desc("importance_score"), "urn")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("label", "rank", "urn", "title", "importance_score")


def top_in_domain(laws: DataFrame, cit: DataFrame, meta: DataFrame, domain: str, k: int = 30) -> DataFrame:
    """Acts of a domain by incoming citations, then importance."""
    rows = laws.join(meta.filter(F.col("domain_cluster") == domain).select("urn"), "urn", "left_semi").select("urn", "title", "importance_score")
    return with_degrees(rows, cit).drop("citations_out").orderBy(F.desc("citations_in"), F.desc("importance_score"), "urn").limit(k)


def most_articles(laws: DataFrame, k: int = 15) -> DataFrame:
    return laws.select("urn", "title", "article_count").orderBy(F.desc_nulls_last("article_count"), "urn").limit(k)
