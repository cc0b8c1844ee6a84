"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets. Sources in code-point order, null last, get the weights 5, 2, 1, repeating. Together they take
   `share` times all words; a source takes at most `cap` times its own words and what it cannot take goes to
   the others by weight (water filling, one row per source).
2. Blocks. The documents of a source are shuffled by a hash of doc_id and text and laid end to end; the stream is cut
   into blocks of B words. Offsets come from two levels of prefix sums (4,096 hash ranges per source, then
   rows), so one source that holds a third of all rows is spread over thousands of window groups.
3. Schedule. Slot i has the golden-ratio point frac(i * phi), in 32-bit integers; the source whose interval of
   cumulative shares holds the point gets the slot. The r-th slot of a source plays block r modulo its number
   of blocks. Slots beyond a source's target are not played, and the few that the finite schedule leaves
   short (its discrepancy, logarithmic in the slots) follow at the end, so each source takes its target to
   the word.
4. Slots join blocks on (source, block): at most a few slots and the documents of B words meet in one key.

Defined cases: a null text has size 0; a null source is a source of its own; size-0 documents take nothing;
rows that repeat a doc_id are rows of their own; rows alike in all that is read take what their places in the stream
give them; a very long document is cut into blocks; an empty table gives no rows; columns other than doc_id, text and
source are ignored. Equal input gives equal output, however it is partitioned. Sources are ranked in one task, a row a
source: some thousands, not one a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, cut, joined_small, whole_text

#: 2^32 and 2^32 over the golden ratio.
SPAN = 4294967296
GOLDEN = 2654435769
CELL_BITS = 20
#: Slots and words are divided into about so many parts.
PARTS = 4096


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words, the shuffling key, and n, how many rows are alike in these: one row each."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), _key(seed).alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))


def _key(seed: str) -> Column:
    """A hash of doc_id and text: rows without an id, or of one id, are shuffled by their texts."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(whole_text())))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: no, source, source_size, weight, target (double)."""
    every = Window.partitionBy()
    filled = every.orderBy("ratio", "no")
    rows = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rows = rows.withColumn("no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    rows = rows.withColumn("before", F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    rows = rows.withColumn("common", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("common"))
    return rows.select("no", "source", "source_size", "weight", target.alias("target"))


@dataclass
class Mix:
    """documents: no, doc_id, source, size, key, start, source_size, target. segments: the mix in slot order."""

    documents: DataFrame
    segments: DataFrame


def _placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's first word in its source's shuffled stream; rows alike in all that is read follow each other."""
    keyed = joined_small(
        sizes, targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))
    ).withColumn("bucket", F.substring("key", 1, 3))
    before = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("n")
    offsets = keyed.groupBy("no", "bucket").agg(F.sum(words).alias("words"))
    offsets = offsets.select("no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("no", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("within", F.coalesce(F.sum(words).over(within), F.lit(0))).join(offsets, ["no", "bucket"])
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    return rows.select("no", "doc_id", "source", "size", "key", (F.col("offset") + F.col("within") + F.col("copy") * F.col("size")).alias("start"), "source_size", "target")


def _slots(targets: DataFrame, block: int) -> DataFrame:
    """The schedule: slot, no, epoch, block, limit (words of the source's stream that this epoch plays)."""
    spark = targets.sparkSession
    plan = targets.filter("source_size > 0").withColumn("words", F.floor("target"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("full", F.expr("words div source_size"))
    plan = plan.withColumn("left", F.col("words") - F.col("full") * F.col("source_size"))
    plan = plan.withColumn("needed", F.col("full") * F.col("blocks") + F.ceil(F.col("left") / block))
    before = Window.partitionBy().orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("before", F.coalesce(F.sum("needed").over(before), F.lit(0))).select("no", "source_size", "blocks", "full", "left", "needed", "before")
    plan = cut(plan)
    n = plan.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]
    whole = F.lit(max(n, 1)).cast("decimal(38,0)")
    edge = lambda c: F.floor(c.cast("decimal(19,0)") * F.lit(SPAN).cast("decimal(19,0)") / whole).cast("long")
    cells = plan.select("no", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("needed")).alias("hi")).filter("lo < hi")
    cells = cells.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))))
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % 2**31 * GOLDEN) % SPAN).alias("x"))
    points = points.withColumn("cell", F.shiftright("x", CELL_BITS))
    dealt = points.join(cells, "cell").filter("lo <= x and x < hi").select("slot", "no", F.expr(f"slot div {max(1, n // PARTS)}").alias("chunk"))
    counts = dealt.groupBy("no", "chunk").count()
    earlier = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("no", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(offsets, ["no", "chunk"]).select("slot", "no", (F.col("rank") + F.col("offset")).alias("rank"))
    got = counts.groupBy("no").agg(F.sum("count").alias("got"))
    short = plan.join(got, "no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < needed")
    tail = short.withColumn("rank", F.explode(F.expr("sequence(got, needed - 1)"))).select((F.lit(n) + F.col("before") + F.col("rank")).alias("slot"), "no", "rank")
    played = ranked.unionByName(tail).join(plan, "no").filter("rank < needed")
    return played.select(
        "slot",
        "no",
        F.expr("rank div blocks").alias("epoch"),
        F.expr("rank % blocks").alias("block"),
        F.expr("if(rank div blocks = full, left, source_size)").alias("limit"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, max_block: int = 65536, seed: str = "mix") -> Mix:
    """The mix of all documents.

    Its segments are rows (slot, source, epoch, doc_id, begin_word, end_word, no, start): read in slot order
    they are the training stream. Blocks have `max_block` words, or a 4,096th of the mix if that is less.
    """
    sizes = cut(measured(docs, seed))
    targets = cut(source_targets(sizes, weights, share, cap))
    wanted = targets.agg(F.coalesce(F.round(F.sum("target"), 3), F.lit(0.0))).first()[0]
    block = int(min(max_block, max(1, wanted // PARTS)))
    documents = cut(_placed(sizes, targets))
    stop = F.col("start") + F.col("size")
    pieces = documents.filter("size > 0").withColumn("stop", stop)
    pieces = pieces.select("no", "source", "doc_id", "start", "stop", F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")).alias("block"))
    segments = pieces.join(_slots(targets, block), ["no", "block"])
    segments = segments.withColumn("begin", F.greatest("start", F.col("block") * block))
    segments = segments.withColumn("end", F.least("stop", (F.col("block") + 1) * block, "limit")).filter("begin < end")
    segments = segments.select(
        "slot", "source", "epoch", "doc_id", (F.col("begin") - F.col("start")).alias("begin_word"), (F.col("end") - F.col("start")).alias("end_word"), "no", "start"
    )
    return Mix(documents, segments)


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (of the schedule; null if not taken)."""
    made = mix(docs, **options)
    taken = made.segments.groupBy("no", "start").agg(F.sum(F.col("end_word") - F.col("begin_word")).alias("taken"), F.min("slot").alias("first_slot"))
    rows = made.documents.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    return rows.join(taken.withColumnRenamed("start", "at"), ["no", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot"
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The documents as the mix plays them, with all their columns: a row for each epoch that takes the document whole,
    and one more for the document whose size is nearest to what its source then lacks. Documents without words stay
    once; rows alike in doc_id, source and text share their plays evenly, rounded up. Only the keys of rows that are
    not played once meet the texts."""
    made = mix(docs, seed=seed, **options)
    epochs = made.segments.groupBy("no", "start", "epoch").agg(F.sum(F.col("end_word") - F.col("begin_word")).alias("words"))
    rows = made.documents.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    plays = rows.join(epochs.withColumnRenamed("start", "at"), ["no", "at"], "left")
    whole = F.count_if(F.expr("size = 0 or words = size")).alias("plays")
    plays = cut(plays.groupBy("key", "source", "no", "at", "size", "source_size", "target").agg(whole))
    left = cut(plays.groupBy("no").agg((F.floor(F.max("target")) - F.sum(F.col("plays") * F.col("size"))).alias("gap")))
    again = joined_small(plays, left, "no").withColumn("off", F.abs(F.col("gap") - F.col("size"))).filter("off < gap and plays = floor(try_divide(target, source_size))")
    nearest = cut(again.groupBy("no").agg(F.min_by("at", F.struct("off", "at")).alias("at")).withColumn("more", F.lit(1)))
    plays = joined_small(plays, nearest, ["no", "at"], "left").withColumn("plays", F.col("plays") + F.coalesce("more", F.lit(0)))
    alike = F.sum(F.when(F.col("size") > 0, 1).otherwise(F.col("plays")))
    plays = plays.groupBy("key", "source").agg(F.ceil(F.sum("plays") / alike).cast("int").alias("__plays"))
    plays = cut(plays.filter("__plays <> 1").select(F.unhex("key").alias("__its"), F.col("source").alias("__of"), "__plays"))
    keyed = docs.withColumn("__key", F.unhex(_key(seed)))
    on = (F.col("__key") == F.col("__its")) & F.col("source").cast("string").eqNullSafe(F.col("__of"))
    played = joined_small(keyed, plays, on, "left").withColumn("__plays", F.coalesce("__plays", F.lit(1))).filter("__plays > 0")
    return played.withColumn("__play", F.explode(F.sequence(F.lit(1), F.col("__plays")))).select(*docs.columns)


OP1_SQL = r"""
with m as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  md5('mix' || coalesce(':' || doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size from m group by source),
n as (select *, row_number() over (order by source asc nulls last) - 1 as no from s),
w as (select *, case no % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2.0::double as most,
  (sum(source_size) over ())::double * 1.5::double as total from n),
f as (select *, coalesce(sum(most) over (order by most / weight, no rows between unbounded preceding and 1 preceding), 0)::double as before,
  (sum(weight) over (order by most / weight, no rows between current row and unbounded following))::double as rest from w),
l as (select *, (total - before) / rest as level, (total - before) / rest * weight >= most as sated from f),
t as (select source, source_size, case when sated then most else weight * max(case when not sated then level end) over () end as target from l),
z as (select *, row_number() over (order by source asc nulls last) - 1 as no, floor(target)::bigint as words from t),
y as (select *, least(65536, greatest(1, floor((select round(sum(target), 3) from t) / 4096)))::bigint as b from z),
p as (select doc_id, size, y.no, y.source_size, y.target, y.b,
  coalesce(sum(size) over (partition by m.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from m join y on m.source is not distinct from y.source),
n1 as (select no, b, source_size, (source_size + b - 1) // b as blocks, words // source_size as full_, words % source_size as rest from y where source_size > 0),
n2 as (select *, full_ * blocks + (rest + b - 1) // b as needed from n1),
n3 as (select *, (coalesce(sum(needed) over (order by no rows between unbounded preceding and 1 preceding), 0))::bigint as before from n2),
k as (select coalesce(sum(needed), 0)::bigint as n from n3),
x as (select slot, (slot % 2147483648 * 2654435769) % 4294967296 as x from (select unnest(range((select n from k))) as slot)),
d as (select slot, no, row_number() over (partition by no order by slot) - 1 as rank from x join n3 on
  x >= before::hugeint * 4294967296 // (select n from k) and x < (before + needed)::hugeint * 4294967296 // (select n from k)),
e as (select slot, no, rank from d union all select (select n from k) + before + r, no, r from
  (select no, before, unnest(range((select count(*) from d where d.no = n3.no), needed)) as r from n3)),
f2 as (select slot, no, b, rank % blocks as block, case when rank // blocks = full_ then rest else source_size end as lim from e join n3 using (no) where rank < needed),
g as (select p.no, p.start, slot, least(p.start + p.size, (block + 1) * f2.b, lim) - greatest(p.start, block * f2.b) as part
  from p join f2 on p.no = f2.no and p.size > 0 and f2.block between p.start // f2.b and (p.start + p.size - 1) // f2.b),
h as (select no, start, sum(part)::bigint as taken, min(slot)::bigint as first_slot from g where part > 0 group by 1, 2)
select doc_id, size, source_size, target, coalesce(h.taken, 0)::bigint as taken, h.first_slot from p left join h on h.no = p.no and h.start = p.start and p.size > 0
"""
