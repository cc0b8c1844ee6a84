"""Chat formatting with collapse of cumulative snapshots.

Logged conversations often hold every earlier state of a longer one. Rolling turn-prefix hashes find them: the
prefix of n turns has the sums over its turns of two 64-bit hashes of (position, role, text). A conversation
whose whole hash is a proper prefix of another one, or that equals one with a smaller conv_id, is dropped by
anti-joins; the maximal ones are rendered.

Positions and prefix sums come from two levels (PART positions each), and a long conversation is rendered as
several rows of PART turns, so one conversation that holds a third of all rows is spread over many groups.

Defined cases: turns are ordered by turn (null first), different turns of one number by the MD5 of role
and text; equal rows count once; a null role renders as "unknown"
and a null text as nothing, and both differ from empty strings and from each other when conversations are compared;
rows with a null conv_id are one conversation; very long turns are rendered whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

PART = 1024
#: The marks of the format.
OPEN, MIDDLE, CLOSE = "<|", "|>", "<|end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn: <|role|> newline text newline <|end|> newline; "<|" inside a text becomes "< |"."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit(MIDDLE + "\n"), body, F.lit("\n" + CLOSE + "\n"))


def _marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the MD5 of what is said, in which null differs from every text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = F.concat_ws(":", F.isnull("text").cast("string"), F.coalesce(F.length("role"), F.lit(-1)).cast("string"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.withColumn("h", F.unhex(F.md5(said)))


def prefixes(turns: DataFrame, part: int = PART) -> DataFrame:
    """Every distinct turn (conv_id, turn, h) with its position from 1 and the rolling hash (a, b) up to it.

    Turn numbers are dealt into ranges of `part`; positions and sums inside a range are windows over
    (conversation, range), and ranges add up over one row each. No text is shuffled."""
    rows = _marked(turns).select("conv_id", "turn", "h").distinct()
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / part), F.lit(-(2**53))))
    here = Window.partitionBy("conv_id", "range").orderBy("turn", "h")
    rows = rows.withColumn("within", F.row_number().over(here))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "before")
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).withColumn("position", F.col("before") + F.col("within"))
    rows = rows.withColumn("ha", F.xxhash64("position", "h").cast("decimal(20,0)")).withColumn("hb", F.xxhash64(F.lit("b"), "position", "h").cast("decimal(20,0)"))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "range").agg(F.sum("ha").alias("sa"), F.sum("hb").alias("sb"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select(
        F.col("conv_id").alias("c2"), F.col("range").alias("r2"), *(F.coalesce(F.sum(s).over(earlier), zero).cast("decimal(38,0)").alias(f"{s}0") for s in ("sa", "sb"))
    )
    rows = rows.withColumn("a", F.sum("ha").over(upto)).withColumn("b", F.sum("hb").over(upto))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("range") == F.col("r2")))
    return rows.select(
        "conv_id", "turn", "h", F.col("position").cast("long").alias("position"), *((F.col(x) + F.col(f"s{x}0")).cast("decimal(38,0)").alias(x) for x in ("a", "b"))
    )


def maximal(marked: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another and the first of equals."""
    lengths = marked.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    lengths = lengths.select(F.col("conv_id").alias("c"), "n_turns")
    whole = marked.join(lengths, F.col("conv_id").eqNullSafe(F.col("c")))
    ends = whole.filter("position = n_turns").select("conv_id", "n_turns", "a", "b")
    inner = whole.filter("position < n_turns").select("position", F.col("a").alias("pa"), F.col("b").alias("pb")).distinct()
    # equal conversations collapse before the join, so a very common one is one row in it
    first = F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("first")
    ends = ends.groupBy("n_turns", "a", "b").agg(first, F.count("*").alias("copies"))
    longest = ends.join(inner, (F.col("n_turns") == F.col("position")) & (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti")
    return longest.select(F.col("first.conv_id").alias("conv_id"), "n_turns", "copies")


def chat_texts(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations), part (from 0) and text of each maximal conversation."""
    marked = cut(prefixes(turns, part))
    kept = maximal(marked).select(F.col("conv_id").alias("c"), "n_turns", "copies")
    places = marked.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", F.col("turn").alias("t"), F.col("h").alias("x"), "position", "n_turns", "copies")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h") == F.col("x"))
    rows = _marked(turns).withColumn("line", rendered(F.col("role"), F.col("text"))).join(places, same).withColumn("part", F.expr(f"(position - 1) div {part}"))
    lines = F.array_sort(F.collect_set(F.struct("position", "line")))  # equal rows count once
    return rows.groupBy("conv_id", "n_turns", "copies", "part").agg(lines.alias("lines")).select("conv_id", "n_turns", "copies", "part", F.array_join(F.col("lines.line"), "").alias("text"))


OP9_SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations),
p as (select *, row_number() over (partition by conv_id order by turn nulls first,
  md5(concat_ws(':', (text is null)::varchar, coalesce(length(role), -1)::varchar, coalesce(role, ''), coalesce(text, '')))) as position from t),
c as (select conv_id, list(struct_pack(r := role, t := text) order by position) as turns, count(*) as n_turns from p group by conv_id),
h as (select conv_id, n_turns, turns, md5(turns::varchar) as whole from c),
x as (select distinct c.n_turns as longer, k.n as n, md5(c.turns[1:k.n]::varchar) as prefix from c, lateral (select unnest(range(1, c.n_turns)) as n) k),
m as (select h.* from h where not exists (select 1 from x where x.n = h.n_turns and x.prefix = h.whole)),
f as (select min(conv_id) as conv_id, n_turns, count(*) as copies from m group by whole, n_turns)
select f.conv_id, f.n_turns, f.copies, (p.position - 1) // 1024 as part,
  string_agg('<|' || coalesce(p.role, 'unknown') || '|>' || chr(10) || replace(coalesce(p.text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' order by p.position) as text
from f join p on p.conv_id = f.conv_id group by 1, 2, 3, 4
"""
