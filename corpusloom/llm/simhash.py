"""SimHash near-duplicates by covering locality-sensitive hashing, exact within the radius.

Fingerprints: 64-bit SimHash over the XXH64 (seed 42) of word shingles. Equal fingerprints collapse to one
row first. Covering hashing (Pagh 2016): each bit position gets a vector of radius+1 bits; mask v keeps the
positions whose vector has odd product with v. For every set of at most `radius` positions some v is
orthogonal to all of them, so any two fingerprints within the radius agree on the bits of one of the
2^(radius+1)-1 masks: no linked pair is missed.

Fingerprints meet in (mask, masked bits) buckets. A task streams the sorted buckets, compares inside each with
bit counts, and emits a spanning forest of the links found, not the pairs. A bucket of more than BUCKET
distinct fingerprints is divided again: its free bits fall into radius+1 groups, and a pair within the radius agrees
on one of them, so it meets in a (mask, masked bits, group, group's bits) bucket. What is still too large is dealt
into blocks, and each pair of blocks is a bucket of its own: every pair is compared, in bounded memory. Components
come from alternating large-star and small-star steps over checkpointed edges. The sides of joins with hot keys are
checkpointed tables, so that Spark can split a bucket of a third of all rows or the hub of a large component.

Defined cases: a text of fewer words than a shingle counts as one shingle of all its words; a text without
words, or null, has fingerprint zero and links like any other; a null doc_id is never a component's name
unless all its members are null; repeated rows give repeated rows, of which one_of_each_component keeps one; ties
between rows of one component go by doc_id, then fingerprint, then hash; very long texts are hashed whole; an empty
table gives no rows; other columns are ignored.

Recall: links within the radius are exact, but a near copy need not lie within it. Of copies of the test documents
with a few words changed, tests/llm measures the share that is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, joined_small, stored, whole_text

BUCKET = 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(text: str, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `width` words joined by spaces, in order, repeats included."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[part : part + 65536]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _row_key() -> Column:
    """256 bits of a row's doc_id and text; a null doc_id differs from all others."""
    name = F.col("doc_id").cast("string")
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-")), whole_text()), 256))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); keyed: and key (_row_key)."""
    rows = docs.select("doc_id", whole_text().alias("text"), *([_row_key().alias("key")] if keyed else []))
    names = ["doc_id", "fp", *rows.columns[2:]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), width, seed)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names)

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + (", key binary" if keyed else ""))


def covering_masks(radius: int = 4, bits: int = 64) -> np.ndarray:
    """The masks of a covering family: any `radius` positions are all outside one of them."""
    vectors = np.array([1 + b % (2 ** (radius + 1) - 1) for b in range(bits)], dtype=np.uint64)
    masks = [sum(1 << b for b in range(bits) if int(vectors[b] & np.uint64(v)).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return np.array(masks, dtype=np.uint64)


def _forest(fps: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (lower, higher) that span the links among fps, or between fps and other.

    Breadth first: each node is compared once, with those not reached yet."""
    nodes = fps if other is None else np.concatenate([fps, other])
    right = np.arange(len(nodes)) >= len(fps)
    new = np.ones(len(nodes), dtype=bool)
    edges: list[np.ndarray] = []
    for start in range(len(nodes)):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            there = np.flatnonzero(new if other is None else new & (right != right[i]))
            near = there[np.bitwise_count(nodes[i] ^ nodes[there]) <= radius]
            if len(near):
                new[near] = False
                edges.append(np.stack([np.full(len(near), i), near], axis=1))
                todo += near.tolist()
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = nodes[np.concatenate(edges)].view(np.int64)
    return pairs.min(axis=1), pairs.max(axis=1)


def _divided(rows: DataFrame, masks: list[int], radius: int, bucket: int) -> DataFrame:
    """The rows (v, bits, fp) of large buckets, in the buckets of their groups of free bits (column more)."""
    free = [[b for b in range(64) if not mask >> b & 1] for mask in masks]
    groups = [[sum(1 << b for i, b in enumerate(bits) if i % (radius + 1) == g) for g in range(radius + 1)] for bits in free]
    table = F.array(*(F.array(*(F.lit(x - 2**64 if x >= 2**63 else x) for x in row)) for row in groups))
    rows = rows.select("v", "bits", "fp", F.posexplode(F.get(table, F.col("v"))).alias("g", "mask"))
    # the group's number and bits in one value: masks differ, so bits of two groups may only meet in a needless comparison
    return rows.select("v", "bits", F.xxhash64("g", F.col("fp").bitwiseAND(F.col("mask"))).alias("more"), "fp")


KEYS = ["v", "bits", "more"]


def _sized(rows: DataFrame) -> DataFrame:
    """The rows of buckets of two fingerprints or more, with the bucket's count."""
    return rows.join(cut(rows.groupBy(*KEYS).count().filter("count > 1")), KEYS)


def links(distinct: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a < b, between fingerprints within the radius whose components are those of all links.

    `distinct` has one row per fingerprint, column fp.
    """
    masks = [int(m) for m in covering_masks(radius)]
    rows = distinct.select("fp", F.posexplode(F.array(*(F.lit(m - 2**64 if m >= 2**63 else m) for m in masks))).alias("v", "mask"))
    rows = rows.select("v", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), F.lit(0).cast("long").alias("more"), "fp")
    sizes = cut(rows.groupBy(*KEYS).count().filter("count > 1"))
    rows = rows.join(sizes, KEYS)
    if not sizes.filter(F.col("count") > bucket).isEmpty():
        rows = rows.filter(F.col("count") <= bucket).unionByName(_sized(_divided(rows.filter(F.col("count") > bucket), masks, radius, bucket)))
    # blocks of a bucket that is still large: its row goes to every pair of blocks that holds its own
    rows = rows.withColumn("blocks", F.when(F.col("count") <= bucket, 1).otherwise(F.expr(f"cast(ceil(2 * count / {bucket}) as int)")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*KEYS, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "fp")
    keys = [*KEYS, "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "own", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def groups(frame: pd.DataFrame) -> pd.DataFrame:
            key = frame[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            fps, own = frame["fp"].to_numpy().view(np.uint64), frame["own"].to_numpy()
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(frame)]])
            # most buckets are pairs
            pair = starts[ends - starts == 2]
            pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius]
            both = np.stack([fps[pair], fps[pair + 1]]).view(np.int64)
            found = [(both.min(axis=0), both.max(axis=0))]
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                i, j = key[a, 3], key[a, 4]
                if i == j:
                    found.append(_forest(fps[a:b], None, radius))
                else:
                    first = fps[a:b][own[a:b] == i]
                    found.append(_forest(first, fps[a:b][own[a:b] == j], radius))
            return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(frame):
                continue
            key = frame[keys].to_numpy()
            last = (key == key[-1]).all(axis=1)
            whole = int(np.argmin(last[::-1])) if not last.all() else len(frame)
            held = frame.iloc[len(frame) - whole :].reset_index(drop=True)
            if whole < len(frame):
                yield groups(frame.iloc[: len(frame) - whole].reset_index(drop=True))
        if held is not None and len(held):
            yield groups(held)

    return rows.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it reaches) for every node of the edges (a, b).

    Alternating large-star and small-star (Kiveris et al. 2014), one checkpoint a round, until no edge changes; the
    rounds grow with the square of the logarithm of the nodes. The star's minima are checkpointed: a hub's edges can
    then be split over tasks.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        joined = both.join(least, F.col("u") == F.col("w"))
        if large:
            moved = joined.filter("v > u").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b"))
        else:
            moved = joined.select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).union(
                least.select(F.least("m", "w").alias("a"), F.greatest("m", "w").alias("b"))
            )
        return moved.filter("a < b").distinct()

    edges = cut(edges)
    before = None
    for _ in range(max_rounds):
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """The classes (one row per fingerprint, column fp) with the root of their component."""
    roots = cut(components(links(classes.select("fp"), radius)))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id it reaches)."""
    marked = cut(fingerprints(docs, width, seed))
    named = _rooted(cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))), radius)
    names = cut(named.groupBy("root").agg(F.min("least_id").alias("component_id")))  # a plain join side, which can be split
    of_class = named.join(names, "root").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_component(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One document of each component, with all columns: the smallest doc_id, a null last, then fingerprint and key.
    Of rows equal in doc_id and text the first by all columns as JSON stays, however rows are dealt out.

    Components are told apart by their root and documents by doc_id and text, so distinct documents without an id,
    or of one id, all stay. What is decided is decided on narrow rows (doc_id, fingerprint, key): the texts only meet
    the keys of rows that go, which are broadcast if their bytes are few.
    """
    marked = stored(fingerprints(docs, width, seed, keyed=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "fp", "key")).alias("first")
    classes = cut(marked.groupBy("fp").agg(first))
    chosen = _rooted(classes, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.key", F.lit(True).alias("stays"))
    alike = marked.groupBy("key").agg(F.count("*").alias("n"))
    odd = cut(alike.join(chosen, "key", "left").select(F.col("key").alias("__key"), F.coalesce("stays", F.lit(False)).alias("__stays"), "n").filter("not __stays or n > 1").drop("n"))
    rows = joined_small(docs.withColumn("__key", _row_key()), odd, "__key", "left")
    left = rows.filter("__stays is null").select(*docs.columns)
    if odd.filter("__stays").isEmpty():
        return left
    # equal rows collapse in each task before they are shuffled
    once = rows.filter("__stays").groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("__row"))
    return left.unionByName(once.select("__row.*"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """one_of_each_component, and of rows that share a doc_id only the first by text. Rows without an id all stay."""
    left = one_of_each_component(docs, **options)
    own = F.when(F.col("doc_id").isNull(), _row_key())
    return left.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", own).orderBy(whole_text()))).filter("__n = 1").drop("__n")
