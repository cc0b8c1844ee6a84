"""A stored two-way adjacency of the citation graph, for look-ups of an act's neighbours.

`build_adjacency` writes every edge twice, in buckets by the act it is looked up by: `out` by the citing and `in` by the
cited act. Edges are ids and a count alone; what lists show of the other end is looked up in the stored acts, once the
edges of a look-up are known. Buckets are sorted by urn, and a hub's edges are several files of a bucket. A look-up opens
the files of its acts' buckets, and of these the row groups that may hold them; no query here reads all edges. Titles are
those of the day it was built: build it anew, or at other paths, when acts change.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import discard

#: Edges of a bucket, about, and acts up to which a set of acts is looked up by name instead of being joined.
PER_BUCKET = 250_000
LOOKUP = 1_000
ACTS = "urn string, title string, type string, year int, importance_score double, bucket int"
EDGES = "urn string, other string, cnt long, bucket int"
DEGREES = "urn string, citations_in long, citations_out long"


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(name), "UTF-8")), F.lit(buckets)).cast("int")


@dataclass
class Adjacency:
    """The stored tables: acts by urn, edges by citing act (out) and by cited act (into), citations_in and _out by urn."""

    acts: DataFrame
    out: DataFrame
    into: DataFrame
    degrees: DataFrame
    buckets: int

    def _named(self, rows: DataFrame, urns: list[str]) -> DataFrame:
        here = sorted({zlib.crc32(u.encode()) % self.buckets for u in urns})
        return rows.filter(F.col("bucket").isin(here) & F.col("urn").isin(urns)).drop("bucket")

    def cited_by(self, urns: list[str]) -> DataFrame:
        """Edges from some acts."""
        return self._named(self.out, urns)

    def citing(self, urns: list[str]) -> DataFrame:
        """Edges to some acts."""
        return self._named(self.into, urns)

    def lookup(self, urns: list[str]) -> DataFrame:
        return self._named(self.acts, urns)

    def shown(self, rows: DataFrame, few: bool = True) -> DataFrame:
        """Rows with `other`, and of that act known, title, type, year and importance_score.

        Of rows with few others these are looked up by name; if there are more than LOOKUP, or with few=False, all acts are joined."""
        some = [r["other"] for r in rows.select("other").distinct().limit(LOOKUP + 1).collect()] if few else []
        named = few and len(some) <= LOOKUP
        acts = (self.lookup(some) if named else self.acts.drop("bucket")).withColumnRenamed("urn", "other").withColumn("known", F.lit(True))
        return rows.join(F.broadcast(acts) if named else acts, "other", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def build_adjacency(laws: DataFrame, cit: DataFrame, path: str, buckets: int | None = None) -> Adjacency:
    """Stores the adjacency of acts (urn, title, type, year, importance_score) and edges (citing_urn, cited_urn, cnt).

    The number of buckets follows the number of edges. Edges without one of their ends are left out."""
    spark = laws.sparkSession
    shown = [F.col("title").cast("string").alias("title"), F.col("type").cast("string").alias("type"), F.col("year").cast("int").alias("year"), F.col("importance_score").cast("double").alias("importance_score")]
    edges = cit.filter("citing_urn is not null and cited_urn is not null").select("citing_urn", "cited_urn", F.col("cnt").cast("long").alias("cnt"))
    edges.write.option("compression", "zstd").parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    buckets = buckets or max(1, min(4096, edges.count() // PER_BUCKET))

    def write(rows: DataFrame, name: str, *order: str) -> None:
        # adaptive execution cuts what is large, so a hub's bucket is written by several tasks
        dealt = rows.withColumn("bucket", _bucket("urn", buckets)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")

    write(laws.filter("urn is not null").select("urn", *shown), "acts", "urn")
    degrees = []
    for name, here, there, side in (("out", "citing_urn", "cited_urn", "citations_out"), ("in", "cited_urn", "citing_urn", "citations_in")):
        write(edges.select(F.col(here).alias("urn"), F.col(there).alias("other"), "cnt"), name, "urn", "other")
        # a task reads an act's edges side by side, so few rows are left to exchange
        degrees.append(spark.read.schema(EDGES).parquet(f"{path}/{name}").groupBy("urn").agg(F.count("*").alias(side)))
    degrees[1].join(degrees[0], "urn", "full").write.parquet(f"{path}/degrees")
    discard(spark, f"{path}/edges")
    spark.createDataFrame([(buckets,)], "buckets int").write.json(f"{path}/totals")
    return open_adjacency(spark, path)


def open_adjacency(spark: SparkSession, path: str) -> Adjacency:
    buckets = spark.read.schema("buckets int").json(f"{path}/totals").first()["buckets"]
    edges = spark.read.schema(EDGES)
    return Adjacency(spark.read.schema(ACTS).parquet(f"{path}/acts"), edges.parquet(f"{path}/out"), edges.parquet(f"{path}/in"), spark.read.schema(DEGREES).parquet(f"{path}/degrees"), buckets)


def _listed(graph: Adjacency, edges: DataFrame, name: str, k: int | None) -> DataFrame:
    """The k edges counted most, with titles: only these acts are looked up."""
    order = F.desc("cnt"), "other"
    rows = graph.shown(edges.orderBy(*order).limit(k) if k else edges).orderBy(*order)
    return (rows.limit(k) if k else rows).select(F.col("other").alias(name), "title", "cnt")


def outgoing(graph: Adjacency, urn: str, k: int | None = None) -> DataFrame:
    """Acts that an act cites: cited_urn, title (where known), cnt."""
    return _listed(graph, graph.cited_by([urn]), "cited_urn", k)


def incoming(graph: Adjacency, urn: str, k: int | None = None) -> DataFrame:
    """Acts that cite an act: citing_urn, title (where known), cnt."""
    return _listed(graph, graph.citing([urn]), "citing_urn", k)


def neighborhood(graph: Adjacency, urn: str, depth: int = 1, max_nodes: int = 100, fan: int = 20) -> DataFrame:
    """Known acts within `depth` hops: urn, title (80 characters), type, year, depth, is_center.

    A node passes on at most `fan` cited and `fan` citing acts, by urn; nodes are taken by (depth, urn) up to max_nodes.
    The caps are the feature's, so a hop brings at most 2 * fan * max_nodes ids to the driver, and the next one opens
    the buckets of those that are new."""
    seen, frontier = {urn: 0}, [urn]
    for hop in range(1, depth + 1):
        sides = [rows.select("urn", "other").distinct().withColumn("n", F.row_number().over(Window.partitionBy("urn").orderBy("other"))).filter(F.col("n") <= fan) for rows in (graph.cited_by(frontier), graph.citing(frontier))]
        found = {r["other"] for r in sides[0].union(sides[1]).collect()} - seen.keys()
        frontier = sorted(found)[: max_nodes - len(seen)]
        seen |= dict.fromkeys(frontier, hop)
        if not frontier:
            break
    hops = graph.acts.sparkSession.createDataFrame(list(seen.items()), "urn string, depth int")
    rows = graph.lookup(list(seen)).join(F.broadcast(hops), "urn")  # at most max_nodes rows
    return rows.select("urn", F.left("title", F.lit(80)).alias("title"), "type", "year", "depth", (F.col("urn") == urn).alias("is_center"))


def related(graph: Adjacency, urn: str, k: int = 10) -> DataFrame:
    """Known acts that cite what an act cites, by the number of shared references."""
    mine = graph.cited_by([urn]).select(F.col("other").alias("urn")).distinct()
    some = [r["urn"] for r in mine.limit(LOOKUP + 1).collect()]
    others = graph.citing(some) if len(some) <= LOOKUP else graph.into.join(mine, "urn", "left_semi")
    shared = others.filter(F.col("other") != urn).groupBy("other").agg(F.count("*").alias("n"))
    rows = graph.shown(shared).filter("known").groupBy(F.col("other").alias("urn"), "title", "type", "year").agg(F.sum("n").alias("shared_citations"))
    return rows.orderBy(F.desc("shared_citations"), "urn").limit(k)


def citing_by_importance(graph: Adjacency, urn: str, k: int = 20) -> DataFrame:
    """Known acts that cite an act by importance, with the number of all that cite it."""
    rows = graph.citing([urn])
    total = rows.agg(F.count("*").alias("n")).select("n").scalar()
    best = graph.shown(rows).filter("known").select(F.col("other").alias("urn"), "title", "importance_score")
    return best.orderBy(F.desc("importance_score"), "urn").limit(k).withColumn("citing_total", total)


def reachable(cit: DataFrame, urn: str, depth: int) -> DataFrame:
    """urn and depth (the least) of everything within `depth` hops over both directions, by a recursive query.

    No caps: rows of a level are the walks of that length, so it is for small depths (see neighborhood for others);
    Spark stops it beyond spark.sql.cteRecursionRowLimit rows."""
    both = cit.select(F.col("citing_urn").alias("a"), F.col("cited_urn").alias("b")).union(cit.select("cited_urn", "citing_urn")).distinct()
    return cit.sparkSession.sql(
        """with recursive walks(urn, depth) as (
             select :urn, 0
             union all
             select e.b, w.depth + 1 from walks w join {both} e on e.a = w.urn where w.depth < :depth)
           select urn, min(depth) as depth from walks group by urn""",
        args={"urn": urn, "depth": depth},
        both=both,
    )
