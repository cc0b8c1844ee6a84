"""Hard-negative mining: for every anchor and each of its positives, the best rows of other labels within a window of
scores that depends on the positive's score.

Scores are integer inner products of quantised vectors, floor(256 * x) for each component x as a double.

1. Block. Rows are packed into blocks of ROWS vectors, anchors into blocks of about ANCHORS; both are stored. Every pair
   of blocks meets once in a join on the anchor block, whose side is broadcast if its counted bytes are few and shuffled
   otherwise, and is one matrix product.
2. Positives. Each task keeps the best rows of the anchor's own label for each anchor it meets; the tasks' winners are
   ranked once more.
3. Slots. The windows of an anchor's positives overlap, but their upper limits, in falling order, split the scores into
   disjoint slots: slot i holds what is at most limit i and above limit i + 1. Each task keeps the best k rows of other
   labels in each (anchor, slot), so what leaves a task is bounded by its anchors, and a score below a slot's k-th best
   is dropped where it arises.
4. Suffixes. Slots fall, so the window of positive i begins with slot i and goes on with the later ones: the merged
   suffix of slots from i on, cut to k, and at its lower limit, answers it. At most k rows a slot are merged.

A task holds the winners of HELD anchor blocks and passes on those of the oldest beyond. Nothing is sampled or capped.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of
different lengths are compared as if the shorter one ended in zeros, an empty one scores 0; scores are exact up to 2^56
and stay there beyond it, components at 2^62; ties go to the smaller id, null last; a row with a null id is no anchor;
repeated rows are rows of their own, and so may be each other's positives; a positive with a negative score has no
window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import joined_small, stored, table

ROWS = 2048
ANCHORS = 1024
#: Anchors whose products with a block of rows are in memory at a time, and anchor blocks whose winners a task holds.
TILE = 256
HELD = 16
#: Places for rows in a block's row numbers.
PLACES = 1 << 16
#: Scores beyond this are this, so that a hundred times a score is a long.
MOST = 1 << 56

PACKED = "n int, dims int, ids binary, labels binary, vectors binary"
FOUND = "anchor long, slot int, score long, id long, row long"


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised vectors, padded with zeros to one length, and which rows have finite components only."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.isfinite(x)
    fine = np.bincount(row[~good], minlength=len(sizes)) == 0
    with np.errstate(over="ignore", invalid="ignore"):
        quantised = np.clip(np.floor(256 * np.where(good, x, 0)), -(2.0**62), 2.0**62)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = quantised
    return out, fine


def blocks(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Packed blocks of rows (id, label, embedding): block, n, dims, ids, labels, vectors; ids are followed by null marks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def packed(held: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            ids, nulls, labels = (np.concatenate([h[i] for h in held]) for i in range(3))
            dims = max(h[3].shape[1] for h in held)
            vectors = np.concatenate([np.pad(h[3], ((0, 0), (0, dims - h[3].shape[1]))) for h in held])
            number += 1
            fields = [number - 1, len(ids), dims, ids.tobytes() + nulls.astype(np.uint8).tobytes(), labels.tobytes(), vectors.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([f], t) for f, t in zip(fields, [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], ["block", "n", "dims", "ids", "labels", "vectors"])

        held, count = [], 0
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                vectors, fine = _matrix(part.column(2))
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy()[fine], np.asarray(ids.is_null())[fine], part.column(1).to_numpy()[fine], vectors[fine]))
                count += int(fine.sum())
                if count >= size:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return rows.mapInArrow(pack, f"block long, {PACKED}")


class Block:
    """An unpacked block."""

    def __init__(self, n: int, dims: int, ids: bytes, labels: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64, n)
        self.nulls = np.frombuffer(ids, np.uint8, n, 8 * n) if len(ids) > 8 * n else np.zeros(n, np.uint8)
        self.labels = np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(n, dims)
        self.most = float(np.abs(self.vectors).max(initial=0))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer rows; `most` bounds a product's absolute value, term by term."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if most * dims < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    sums = np.zeros((len(a), len(b)), dtype=object)
    for k in range(dims):
        sums += whole(a[:, k])[:, None] * whole(b[:, k])[None, :]
    return np.clip(sums, -MOST, MOST).astype(np.int64)


def anchors_of(packed: DataFrame, every: int, folder: str) -> DataFrame:
    """The anchors among the rows of stored blocks: anchor (the row's number), id, label, vector; stored."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(*(r[c] for c in ("n", "dims", "ids", "labels", "vectors")))
                at = np.flatnonzero((block.ids % every == 0) & (block.nulls == 0))
                columns = [pa.array(r["block"] * PLACES + at), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array([v.tobytes() for v in block.vectors[at]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "label", "vector"])

    return stored(packed.mapInArrow(pick, "anchor long, id long, label long, vector binary"), folder)


def anchor_blocks(anchors: DataFrame, count: int) -> DataFrame:
    """Packed blocks of anchors (anchor, label, vector, limits, low): part, n, dims, ids, labels, vectors, limits, low; stored.

    limits are falling; `count` is the number of anchors."""
    parts = -(-count // ANCHORS)
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "anchor")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: int, held: list[dict]) -> pa.RecordBatch:
            dims, wide = max(len(r["vector"]) // 8 for r in held), max(len(r["limits"]) for r in held)
            vectors = b"".join(r["vector"] + bytes(8 * dims - len(r["vector"])) for r in held)
            limits = np.array([r["limits"] + [-MOST - 1] * (wide - len(r["limits"])) for r in held], np.int64)
            ints = lambda c: np.array([r[c] for r in held], np.int64).tobytes()
            fields = [part, len(held), dims, ints("anchor"), ints("label"), vectors, limits.tobytes(), ints("low")]
            types = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([f], t) for f, t in zip(fields, types, strict=True)], ["part", "n", "dims", "ids", "labels", "vectors", "limits", "low"])

        at, held = None, []
        for batch in batches:
            for r in batch.select(["anchor", "label", "vector", "limits", "low", "part"]).to_pylist():
                if held and r["part"] != at:
                    yield packed(at, held)
                    held = []
                at = r["part"]
                held.append(r)
        if held:
            yield packed(at, held)

    return stored(dealt.mapInArrow(pack, f"part int, {PACKED}, limits binary, low binary"), "anchor-blocks")


class Winners:
    """The best k rows of each (anchor, slot) of an anchor block, from the row blocks met so far."""

    def __init__(self, block: Block, limits: bytes, low: bytes, k: int, same: bool):
        n = len(block.ids)
        self.block, self.k, self.same = block, k, same
        self.limits, self.low = np.frombuffer(limits, np.int64).reshape(n, -1), np.frombuffer(low, np.int64)
        self.least = np.full(self.limits.shape, -MOST - 1)
        self.found = [np.empty(0, np.int64) for _ in range(6)]  # anchor, slot, -score, null, id, row

    def add(self, rows: Block, number: int) -> None:
        new = []
        for at in range(0, len(self.block.ids), TILE):
            mine = slice(at, at + TILE)
            scores = products(self.block.vectors[mine], rows.vectors, self.block.most * rows.most)
            fits = (self.block.labels[mine, None] == rows.labels) == self.same
            fits &= scores >= self.low[mine, None]
            slot = np.full(scores.shape, -1, np.int8)
            for limit in self.limits[mine].T:
                slot += scores <= limit[:, None]
            anchor, row = np.nonzero(fits & (slot >= 0))
            slot, score = slot[anchor, row].astype(np.int64), scores[anchor, row]
            anchor += at
            row_number = number * PLACES + row
            some = (score >= self.least[anchor, slot]) & (row_number != self.block.ids[anchor])
            new.append([anchor[some], slot[some], -score[some], rows.nulls[row[some]].astype(np.int64), rows.ids[row[some]], row_number[some]])
        every = [np.concatenate([old, *(n[i] for n in new)]) for i, old in enumerate(self.found)]
        order = np.lexsort(every[::-1])
        every = [c[order] for c in every]
        key = every[0] * self.limits.shape[1] + every[1]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(key)]])))
        self.found = [c[place < self.k] for c in every]
        last = np.flatnonzero(place == self.k - 1)
        self.least[every[0][last], every[1][last]] = -every[2][last]

    def batch(self) -> pa.RecordBatch:
        anchor, slot, score, null, ids, row = self.found
        columns = [self.block.ids[anchor], slot.astype(np.int32), -score, pa.array(ids, mask=null.astype(bool)), row]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "score", "id", "row"])


def winners(packed: DataFrame, by: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """anchor, slot, score, id, row: the best k of each (anchor, slot) over all blocks, ranked from 1 in `place`."""
    few = by.select("part", *(F.col(c).alias(f"a_{c}") for c in ("n", "dims", "ids", "labels", "vectors", "limits", "low")))
    pairs = joined_small(packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), few, "part")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Winners] = OrderedDict()
        number, rows = None, None
        for batch in batches:
            for i in range(len(batch)):
                value = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                if value("block") != number:
                    number, rows = value("block"), Block(*map(value, ("n", "dims", "ids", "labels", "vectors")))
                part = value("part")
                if part not in held:
                    if len(held) >= HELD:
                        yield held.popitem(last=False)[1].batch()
                    held[part] = Winners(Block(*map(value, ("a_n", "a_dims", "a_ids", "a_labels", "a_vectors"))), value("a_limits"), value("a_low"), k, same)
                held[part].add(rows, number)
        for kept in held.values():
            yield kept.batch()

    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return pairs.mapInArrow(scan, FOUND).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, *, id: str = "vec_id", label: str | Column = "label", embedding: str = "embedding", every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`; an anchor's positives are the first `positives` other rows of
    its label; negatives have other labels and low * positive_score <= 100 * negative_score <= high * positive_score."""
    if not (0 <= low < high <= 100 and 0 < positives < 100 and k > 0):
        raise ValueError("0 <= low < high <= 100, up to 99 positives and at least one negative are needed")
    rows = vectors.select(F.col(id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    packed = stored(blocks(rows.filter("label is not null and embedding is not null")), "vector-blocks")
    anchors = anchors_of(packed, every, "anchors")
    count = anchors.count()
    parts = max(1, -(-count // ANCHORS))
    anyhow = anchors.select("anchor", "label", "vector", F.array(F.lit(MOST)).alias("limits"), F.lit(-MOST).alias("low"))
    best = stored(winners(packed, anchor_blocks(anyhow, max(count, 1)), parts, positives, True), "positives")
    # floor(high * p / 100) and ceil(low * p / 100) of what is not negative
    best = best.filter("score >= 0").select("anchor", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"({high} * score) div 100").alias("upper"), F.expr(f"({low} * score + 99) div 100").alias("lower"))
    limits = best.groupBy("anchor").agg(F.reverse(F.sort_array(F.collect_list("upper"))).alias("limits"), F.min("lower").alias("low"))
    bounded = anchors.join(limits, "anchor").select("anchor", "label", "vector", "limits", "low")
    found = winners(packed, anchor_blocks(bounded, max(count, 1)), parts, k, False)
    falling = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("slot").alias("slot"))))
    slots = found.groupBy("anchor").agg(falling.alias("slots"))
    suffix = F.expr(f"slice(filter(slots, x -> x.slot >= slot), 1, {k})")
    answers = best.join(slots, "anchor").withColumn("suffix", suffix).select("*", F.posexplode(F.expr("filter(suffix, x -> -x.below >= lower)")).alias("at", "x"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return answers.join(named, "anchor").select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.below")).alias("negative_score"))


def op13(spark, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=relabelled)


OP13_SQL = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, r.id as id, a.label = r.label as own, list_inner_product(a.q, r.q)::bigint as score
  from v a join v r on a.id <> r.id where a.id % 100 = 0),
p as (select * from s where own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.own and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
