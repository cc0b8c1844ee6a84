"""The citation graph: edges (citing_urn, cited_urn, …) and acts.

Sorts end in urn, so results do not depend on partitioning. Aggregates run before joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("urn")).agg(F.count("*").alias(name))


def in_out(cit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by cited and by citing act."""
    return _count(cit, "cited_urn", "citations_in"), _count(cit, "citing_urn", "citations_out")


def with_degrees(laws: DataFrame, cit: DataFrame) -> DataFrame:
    """Acts with citations_in and citations_out, zeros kept."""
    inn, out = in_out(cit)
    rows = laws.join(inn, "urn", "left").join(out, "urn", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations_in", "citations_out")})


def build_edges(laws: DataFrame) -> DataFrame:
    """Edges from nested citations (urn, citations array of struct target_urn, cited_urn, ref, article).

    The first citation of a pair gives its context; `mentions` counts them."""
    each = laws.select(F.col("urn").alias("citing_urn"), F.posexplode("citations").alias("pos", "c"))
    each = each.withColumn("cited_urn", F.coalesce("c.target_urn", "c.cited_urn")).filter("cited_urn is not null and citing_urn is not null")
    context = F.coalesce(F.when(F.col("c.article").isNotNull(), F.concat(F.lit("art. "), F.col("c.article"), F.lit(" | "), F.coalesce("c.ref", F.lit("")))), F.col("c.ref"))
    first = F.min_by(F.struct(context.alias("context")), "pos").alias("first")
    edges = each.groupBy("citing_urn", "cited_urn").agg(F.count("*").alias("mentions"), first)
    return edges.select("citing_urn", "cited_urn", F.lit(1).cast("long").alias("count"), "mentions", F.col("first.context").alias("context"))


def _ends(cit: DataFrame, laws: DataFrame, urn: str, here: str, there: str, k: int | None) -> DataFrame:
    titles = laws.select(F.col("urn").alias(there), "title")
    rows = cit.filter(F.col(here) == urn).join(titles, there, "left").orderBy(F.desc("cnt"), there)
    return (rows.limit(k) if k else rows).select(there, "title", "cnt")


def outgoing(cit: DataFrame, laws: DataFrame, urn: str, k: int | None = None) -> DataFrame:
    """Acts that an act cites, with titles where known."""
    return _ends(cit, laws, urn, "citing_urn", "cited_urn", k)


def incoming(cit: DataFrame, laws: DataFrame, urn: str, k: int | None = None) -> DataFrame:
    """Acts that cite an act, with titles where known."""
    return _ends(cit, laws, urn, "cited_urn", "citing_urn", k)


def most_cited(cit: DataFrame, laws: DataFrame, k: int = 50) -> DataFrame:
    """Known acts by the number of acts citing them."""
    top = _count(cit, "cited_urn", "citation_count").join(laws.select("urn", "title", "type", "year"), "urn")
    return top.orderBy(F.desc("citation_count"), "urn").limit(k)


def citation_counts(laws: DataFrame, cit: DataFrame) -> DataFrame:
    """urn, citations_in, citations_out of every act."""
    return with_degrees(laws.select("urn"), cit)


def valid_edges(cit: DataFrame, laws: DataFrame, both: bool = True) -> DataFrame:
    """Edges whose cited act (and citing act) is known."""
    known = laws.select("urn")
    rows = cit.join(known.withColumnRenamed("urn", "cited_urn"), "cited_urn", "left_semi")
    return rows.join(known.withColumnRenamed("urn", "citing_urn"), "citing_urn", "left_semi") if both else rows


def citation_counts_valid(laws: DataFrame, cit: DataFrame, meta: DataFrame) -> DataFrame:
    """Degrees over edges whose other end is known; the other features of meta stay."""
    known = laws.select("urn")
    inn = _count(cit.join(known.withColumnRenamed("urn", "citing_urn"), "citing_urn", "left_semi"), "cited_urn", "citations_in")
    out = _count(cit.join(known.withColumnRenamed("urn", "cited_urn"), "cited_urn", "left_semi"), "citing_urn", "citations_out")
    rows = known.join(meta, "urn", "left").join(inn, "urn", "left").join(out, "urn", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations_in", "citations_out")})


def add_missing_metadata(meta: DataFrame, cit: DataFrame) -> DataFrame:
    """Metadata rows plus one for each cited id without any."""
    missing = _count(cit, "cited_urn", "citation_count_incoming").join(meta.select("urn"), "urn", "left_anti")
    return meta.unionByName(missing, allowMissingColumns=True)


def neighborhood(cit: DataFrame, laws: DataFrame, urn: str, depth: int = 1, max_nodes: int = 100, fan: int = 20) -> DataFrame:
    """Known acts within `depth` hops: urn, title (80 characters), type, year, depth, is_center.

    A node passes on at most `fan` cited and `fan` citing acts, by urn; nodes are taken by (depth, urn) up to
    max_nodes. Each hop joins the frontier, of at most max_nodes rows, with the edges, and is checkpointed."""
    from corpusloom.sources.tables import checkpointed

    spark = cit.sparkSession
    seen = spark.createDataFrame([(urn, 0)], "urn string, depth int")
    frontier = seen
    for hop in range(1, depth + 1):
        found = []
        for here, there in (("citing_urn", "cited_urn"), ("cited_urn", "citing_urn")):
            # at most max_nodes rows of frontier: a proven bound for the broadcast
            step = cit.join(F.broadcast(frontier.select(F.col("urn").alias(here))), here).select(F.col(here).alias("from"), F.col(there).alias("urn")).distinct()
            ranked = step.withColumn("n", F.row_number().over(Window.partitionBy("from").orderBy("urn"))).filter(F.col("n") <= fan)
            found.append(ranked.select("urn"))
        new = found[0].union(found[1]).distinct().join(seen, "urn", "left_anti").withColumn("depth", F.lit(hop))
        seen = checkpointed(seen.union(new).orderBy("depth", "urn").limit(max_nodes))
        frontier = seen.filter(F.col("depth") == hop)
    known = laws.select("urn", F.left("title", F.lit(80)).alias("title"), "type", "year")
    return known.join(F.broadcast(seen), "urn").select("urn", "title", "type", "year", "depth", (F.col("urn") == urn).alias("is_center"))


def importance(laws: DataFrame, cit: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5, hub: int = 1_000_000) -> DataFrame:
    """PageRank: urn, pagerank (8 decimals), importance_score (0 to 100 of the largest, 2 decimals).

    Nodes are the known acts on any edge, out-degrees count all edges, and mass of acts without citations is not
    handed out again. Nodes get numbers; nodes and the cited acts of each (with 1 / out-degree) are stored once in tables
    of equal buckets by number, so a round joins ranks and citations where they lie, adds contributions up in the map
    tasks and exchanges these alone: one exchange a round. Every `cut_every` rounds the ranks are stored the same way.
    Acts with more than `hub` citations have no such row: their edges are dealt out evenly and meet the few hubs' ranks
    in a broadcast, of at most one hub for every `hub` edges."""
    import uuid

    from corpusloom.sources.tables import checkpointed, shared_dir

    spark = cit.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = []

    def bucketed(df: DataFrame) -> DataFrame:
        """The rows in a table of `parts` buckets by id, which joins and aggregations by id read in place."""
        name = f"corpusloom_{uuid.uuid4().hex}"
        made.append(name)
        df.repartition(parts, "id").write.bucketBy(parts, "id").sortBy("id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return spark.table(name)

    cit = checkpointed(cit.select("citing_urn", "cited_urn"))
    ends = cit.select(F.col("citing_urn").alias("urn")).union(cit.select("cited_urn"))
    names = checkpointed(ends.distinct().join(laws.select("urn"), "urn", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    nodes = bucketed(names)
    n = nodes.count()
    degrees = cit.groupBy("citing_urn").agg(F.count("*").alias("degree"))
    cited = cit.join(names.select(F.col("urn").alias("cited_urn"), F.col("id").alias("to")), "cited_urn")
    edges = cited.join(degrees, "citing_urn").join(names.select(F.col("urn").alias("citing_urn"), "id"), "citing_urn").select("id", "to", "degree")
    few = bucketed(edges.filter(F.col("degree") <= hub).groupBy("id").agg((1 / F.first("degree")).alias("share"), F.collect_list("to").alias("to")))
    many = checkpointed(edges.filter(F.col("degree") > hub).select("id", "to", (1 / F.col("degree")).alias("share")).repartition(parts))
    hubs = not many.isEmpty()
    base = F.lit((1 - damping) / max(n, 1))
    ids = nodes.select("id")
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(1, iterations + 1):
        part = (F.col("rank") * F.col("share")).alias("part")
        given = few.join(ranks.hint("shuffle_hash"), "id").select(F.explode("to").alias("to"), part)
        if hubs:
            of_hubs = ranks.join(F.broadcast(many.select("id").distinct()), "id", "left_semi")
            given = given.union(many.join(F.broadcast(of_hubs), "id").select("to", part))
        total = given.groupBy(F.col("to").alias("id")).agg(F.sum("part").alias("in"))
        ranks = ids.join(total.hint("shuffle_hash"), "id", "left").select("id", (base + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if (hubs or i % cut_every == 0) and i < iterations:
            ranks = bucketed(ranks)
    ranks = checkpointed(nodes.join(ranks.hint("shuffle_hash"), "id").select("urn", "rank"))
    for name in made:
        spark.sql(f"drop table {name}")
    top = ranks.agg(F.max("rank").alias("m")).select("m").scalar()
    return ranks.select("urn", F.round("rank", 8).alias("pagerank"), F.round(F.col("rank") / top * 100, 2).alias("importance_score"))


def related(cit: DataFrame, laws: DataFrame, urn: str, k: int = 10) -> DataFrame:
    """Acts that cite what an act cites, by the number of shared references."""
    mine = cit.filter(F.col("citing_urn") == urn).select("cited_urn")
    others = cit.filter(F.col("citing_urn") != urn).join(mine, "cited_urn")
    shared = _count(others, "citing_urn", "shared_citations").join(laws.select("urn", "title", "type", "year"), "urn")
    return shared.orderBy(F.desc("shared_citations"), "urn").limit(k)


def _parts(urn: str) -> dict:
    col = F.col(urn)
    last = F.split_part(col, F.lit(":"), F.lit(5))
    return {
        "kind": F.split_part(col, F.lit(":"), F.lit(4)),
        "year": F.left(F.split_part(last, F.lit(";"), F.lit(1)), F.lit(4)),
        "number": F.split_part(last, F.lit(";"), F.lit(2)),
    }


def resolution_index(laws: DataFrame) -> DataFrame:
    """(kind, year, number) of nir URNs and the first urn that has them."""
    rows = laws.filter(F.col("urn").startswith("urn:nir:") & F.col("urn").contains(";")).select("urn", *(c.alias(k) for k, c in _parts("urn").items()))
    return rows.groupBy("kind", "year", "number").agg(F.min("urn").alias("actual_urn"))


def resolve(cit: DataFrame, laws: DataFrame) -> DataFrame:
    """Edges with cited urns replaced by those of the corpus; of colliding edges the unchanged one stays.

    Adds resolved: whether the cited act is now known."""
    rows = cit.select("*", *(c.alias(k) for k, c in _parts("cited_urn").items())).join(resolution_index(laws), ["kind", "year", "number"], "left")
    known = laws.select(F.col("urn").alias("cited_urn"), F.lit(True).alias("known"))
    rows = rows.join(known, "cited_urn", "left")
    target = F.when(F.col("known"), F.col("cited_urn")).otherwise(F.coalesce("actual_urn", "cited_urn"))
    rows = rows.withColumn("target", target).withColumn("changed", F.col("target") != F.col("cited_urn"))
    rows = rows.withColumn("resolved", F.coalesce("known", F.lit(False)) | F.col("actual_urn").isNotNull())
    best = Window.partitionBy("citing_urn", "target").orderBy("changed", "cited_urn")
    rows = rows.withColumn("n", F.row_number().over(best)).filter("n = 1")
    return rows.select("citing_urn", F.col("target").alias("cited_urn"), *(c for c in cit.columns if c not in ("citing_urn", "cited_urn")), "resolved")


def resolve_stats(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("edges"), F.count_if(F.col("resolved")).alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def resolve_loose(cit: DataFrame, laws: DataFrame, k: int = 3) -> DataFrame:
    """Up to k candidates for each cited urn that is unknown: same number and year, type contained in the urn."""
    missing = orphan_rows(cit, laws).select("cited_urn", *(c.alias(n) for n, c in _parts("cited_urn").items())).filter("number <> ''")
    known = laws.select("urn", F.split_part("urn", F.lit(";"), F.lit(-1)).alias("number"), F.explode(F.array_distinct(F.regexp_extract_all("urn", F.lit(r"(\d{4})"), 1))).alias("year"))
    rows = missing.join(known, ["number", "year"]).filter(F.col("urn").contains(F.col("kind")))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("cited_urn").orderBy("urn")))
    return ranked.filter(F.col("n") <= k).select("cited_urn", F.col("urn").alias("candidate"), "n")


def orphan_rows(cit: DataFrame, laws: DataFrame) -> DataFrame:
    """Distinct cited ids that are not in the corpus."""
    return cit.select("cited_urn").distinct().join(laws.select(F.col("urn").alias("cited_urn")), "cited_urn", "left_anti")


def orphans(cit: DataFrame, laws: DataFrame) -> DataFrame:
    return orphan_rows(cit, laws).agg(F.count("*").alias("orphans"))


def missing_by_prefix(cit: DataFrame, laws: DataFrame, k: int = 10) -> DataFrame:
    """Missing ids by what stands before their first dash, else by their first four characters."""
    prefix = F.when(F.col("cited_urn").contains("-"), F.split_part("cited_urn", F.lit("-"), F.lit(1))).otherwise(F.left("cited_urn", F.lit(4)))
    rows = orphan_rows(cit, laws).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "prefix").limit(k)


def high_degree(cit: DataFrame, n: int = 50) -> DataFrame:
    """Ids by in-degree, known or not."""
    return _count(cit, "cited_urn", "in_degree").orderBy(F.desc("in_degree"), "urn").limit(n)


def graph_briefing(cit: DataFrame, laws: DataFrame, n: int = 15) -> DataFrame:
    """One text that lists the n most cited ids with titles."""
    top = high_degree(cit, n).join(laws.select("urn", "title"), "urn", "left")
    line = F.format_string("- **%s**: %s\n  (Referenced in %d laws in dataset)\n", "urn", F.coalesce("title", "urn"), "in_degree")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("o"), "urn", line.alias("line"))))
    head = "# KEY AUTHORITIES\n\nThe acts cited most in the corpus:\n\n"
    return top.agg(lines.alias("l")).select(F.concat(F.lit(head), F.array_join(F.col("l.line"), "\n")).alias("briefing"))


def graph_stats(cit: DataFrame, laws: DataFrame) -> DataFrame:
    """Acts, acts with citations, edges and nodes."""
    nodes = laws.select("urn").union(cit.select("citing_urn")).union(cit.select("cited_urn")).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name)).select(name).scalar().alias(name)
    spark = cit.sparkSession
    return spark.range(1).select(one(laws, "acts"), one(cit.select("citing_urn").distinct(), "acts_with_citations"), one(cit, "edges"), one(nodes, "nodes"))


def citation_stats(laws: DataFrame, cit: DataFrame) -> DataFrame:
    """Citations per act: total, mean, largest, smallest, acts with none and with over 50."""
    per = with_degrees(laws.select("urn"), cit).select(F.col("citations_out").alias("n"))
    return per.agg(
        F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") > 50).alias("over_50")
    )


def cross_domain(cit: DataFrame, meta: DataFrame, k: int = 30) -> DataFrame:
    """Edges by the domains of their ends."""
    of = meta.filter("domain_cluster is not null").select("urn", "domain_cluster")
    rows = cit.join(of.toDF("citing_urn", "from_domain"), "citing_urn").join(of.toDF("cited_urn", "to_domain"), "cited_urn")
    return rows.groupBy("from_domain", "to_domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_domain", "to_domain").limit(k)


def avg_in_degree(cit: DataFrame) -> DataFrame:
    return _count(cit, "cited_urn", "n").agg(F.round(F.avg("n"), 6).alias("avg_in_degree"))


def cited_from_records(laws: DataFrame, k: int = 20) -> DataFrame:
    """Cited urns counted in nested citations."""
    each = laws.select(F.explode("citations").alias("c")).select(F.coalesce("c.target_urn", "c.cited_urn").alias("urn")).filter("urn is not null")
    return each.groupBy("urn").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "urn").limit(k)


def citing_by_importance(cit: DataFrame, laws: DataFrame, urn: str, k: int = 20) -> DataFrame:
    """Acts that cite an act by importance, with the number of all of them."""
    rows = cit.filter(F.col("cited_urn") == urn).select(F.col("citing_urn").alias("urn")).join(laws.select("urn", "title", "importance_score"), "urn")
    total = cit.filter(F.col("cited_urn") == urn).agg(F.count("*").alias("n")).select("n").scalar()
    return rows.orderBy(F.desc("importance_score"), "urn").limit(k).withColumn("citing_total", total)


def most_cited_stored(meta: DataFrame, laws: DataFrame, k: int = 25) -> DataFrame:
    """Acts by their stored in-degree, above zero."""
    rows = meta.filter("citation_count_incoming > 0").join(laws.select("urn", "title", "year"), "urn")
    return rows.select("urn", "title", "year", "citation_count_incoming").orderBy(F.desc("citation_count_incoming"), "urn").limit(k)


def adjacency_parts(cit: DataFrame, part: int = 10_000) -> DataFrame:
    """urn, side (outgoing or incoming), part (from 0) and at most about `part` ids each: a hub is many rows.

    Ids are dealt to parts by hash, so a hub's ids meet in many tasks and no array grows with it."""
    sides = [cit.select(F.col(a).alias("urn"), F.lit(side).alias("side"), F.col(b).alias("id")) for a, b, side in (("citing_urn", "cited_urn", "outgoing"), ("cited_urn", "citing_urn", "incoming"))]
    each = sides[0].union(sides[1]).filter("urn is not null and id is not null").distinct()
    sizes = each.groupBy("urn", "side").agg(F.count("*").alias("n"))
    big = sizes.filter(F.col("n") > part).select("urn", "side", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    dealt = each.join(big, ["urn", "side"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.groupBy("urn", "side", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def adjacency_index(cit: DataFrame) -> DataFrame:
    """urn, outgoing and incoming ids, sorted: a row an act, for graphs whose hubs fit a row (see adjacency_parts)."""
    out = cit.groupBy(F.col("citing_urn").alias("urn")).agg(F.sort_array(F.collect_set("cited_urn")).alias("outgoing"))
    inn = cit.groupBy(F.col("cited_urn").alias("urn")).agg(F.sort_array(F.collect_set("citing_urn")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return out.join(inn, "urn", "full").select("urn", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


def graph_nodes(laws: DataFrame, cit: DataFrame, min_citations: int = 2) -> DataFrame:
    """Acts with at least so many incoming citations: id, title, type, year, size."""
    size = _count(cit, "cited_urn", "size").filter(F.col("size") >= min_citations)
    return laws.join(size, "urn").select(F.col("urn").alias("id"), "title", "type", "year", "size").orderBy(F.desc("size"), "id")


def graph_edges(nodes: DataFrame, cit: DataFrame) -> DataFrame:
    """Edges between the nodes: source, target and, where edges have a count, weight."""
    ids = nodes.select("id")
    rows = cit.join(ids.withColumnRenamed("id", "citing_urn"), "citing_urn", "left_semi").join(ids.withColumnRenamed("id", "cited_urn"), "cited_urn", "left_semi")
    return rows.select(F.col("citing_urn").alias("source"), F.col("cited_urn").alias("target"), *([F.col("cnt").alias("weight")] if "cnt" in cit.columns else []))
