"""Quality classifier: learned hashed word and character n-gram vectors, averaged, with softmax output.

Features of a text are its words and the character n-grams (3 and 4 code points) inside words with their
borders, hashed into 2^18 buckets; letter case counts. Word bigrams are reduced to one that generalises: a word
that repeats the one before it. A document is the mean of its features' vectors, and
two outputs go through a softmax. Numpy stochastic gradient descent trains vectors and outputs on a bounded
sample of labelled rows: at most SAMPLE rows, those with the smallest hash of doc_id. The sample's texts are
whole and are turned into features by tasks; the driver sees bucket counts only, three bytes a distinct bucket. As the output is linear in
the features, scoring needs one number a bucket (2 MB, broadcast) and covers every text whole.

Training and scoring take their features from one function. Every text has borders of its own, and the numbers of
the buckets are integers (2^-28ths), whose sums do not depend on their order: a text's score is the same whatever
texts share its batch, to the last bit. A step moves a text's buckets by their share of it times the number of its
distinct buckets, 50 at most, as a mean over many features would else hardly move any.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read.

Defined cases: a text without features (empty, null, white space) has the score of the bias alone, the share of
label 1; without any label to learn from, every score is 1 (nothing is rejected without evidence); labels that
contradict each other for a doc_id, null labels and null doc_ids are not learned from; of several texts under one
doc_id each is learned from, with SAMPLE texts at most; repeated rows and ties score alike; very long texts are
taken whole, about 60 bytes of memory a character; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.common import table, whole_text

SAMPLE = 4000
BUCKETS = 1 << 18
UNIT = 1 << 28
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features: buckets in the order of the texts, their places, and where each text's places begin."""
    raw, offsets = tb.joined([t.encode("utf-8", "surrogatepass") for t in texts])
    starts, ends = tb.word_spans(raw)
    words = tb.span_hashes(raw, starts, ends)
    yield (words & np.uint64(BUCKETS - 1)).astype(np.int64), starts, offsets
    owner = np.repeat(np.arange(len(texts)), tb.words_per_text(starts, offsets))
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    yield np.zeros(len(again), dtype=np.int64), starts[again], offsets
    # code points, each text between two blanks of its own: no n-gram reaches from one text to the next
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2)])
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(space, np.uint32(32), points)
    for n in (3, 4):
        last = len(points) - n + 1
        if last < 1:
            continue
        ok = ~space[1 : last + 1]
        for k in range(2, n - 1):
            ok &= ~space[k : k + last]
        at = np.flatnonzero(ok)
        gram = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            gram = (gram ^ points[at + k]) * np.uint32(2654435761)
            gram ^= gram >> np.uint32(15)
        yield (gram & np.uint32(BUCKETS - 1)).astype(np.int64), at, offsets


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    return np.unique(np.concatenate([b for b, _, _ in features([text])]), return_counts=True)


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and their counts in some three bytes each: the low 16 bits of the buckets, then the counts in one
    byte each, or eight where one does not fit; before them where the high bits change, and the bytes of a count."""
    width = 1 if not len(counts) or counts.max() < 256 else 8
    head = [*np.searchsorted(buckets, np.arange(1 << 16, BUCKETS, 1 << 16)), width]
    return np.array(head, "<i8").tobytes() + buckets.astype("<u2").tobytes() + counts.astype(f"<u{width}").tobytes()


def unpacked(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """What packed() was given."""
    *changes, width = np.frombuffer(data, "<i8", BUCKETS >> 16).tolist()
    begin = 8 * (BUCKETS >> 16)
    number = (len(memoryview(data)) - begin) // (2 + width)
    buckets = np.frombuffer(data, "<u2", number, begin).astype(np.int64)
    for at in changes:
        buckets[at:] += 1 << 16
    return buckets, np.frombuffer(data, f"<u{width}", number, begin + 2 * number)


class Samples(Sequence):
    """(buckets, counts, label) of each labelled text, unpacked when it is read."""

    def __init__(self, data: list[pa.Buffer], labels: list[int]):
        self.data, self.labels = data, labels

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        return *unpacked(self.data[i]), self.labels[i]


@dataclass
class Model:
    """logit of label 1 = bias + mean of weights over the features; weights in units of 1 / UNIT."""

    weights: np.ndarray
    bias: float
    trained: bool = True

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.ones(len(texts))
        total, number = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for buckets, at, offsets in features(texts):
            cuts = np.searchsorted(at, offsets)
            sums = np.concatenate([[0], np.cumsum(self.weights[buckets])])
            total += sums[cuts[1:]] - sums[cuts[:-1]]
            number += np.diff(cuts)
        logits = self.bias + total / (np.maximum(number, 1) * float(UNIT))
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def train(samples: Sequence[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 8, rate: float = 0.3, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label) samples."""
    if not samples:
        return Model(np.zeros(1, np.int64), 0.0, trained=False)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    share = (sum(y for _, _, y in samples) + 0.5) / (len(samples) + 1)
    out, bias = rng.normal(0, 0.1, (dim, 2)), np.array([np.log(1 - share), np.log(share)])
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            buckets, counts, label = samples[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            mine = vectors[buckets]
            shares = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = shares @ mine
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            mine -= shares[:, None] * (back * lr * min(len(buckets), 50)).astype(np.float32)
            vectors[buckets] = mine
    direction = out[:, 1] - out[:, 0]
    return Model(np.rint(vectors @ direction * UNIT).astype(np.int64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that are not held out."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    rows = rows.filter(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    rows = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample).select("id", "y")
    # at most `sample` rows on each broadcast: of ids, then of distinct texts under them
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("version", F.xxhash64("text"))
    versions = texts.join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select("id", "y", "version").distinct()
    versions = versions.orderBy(F.md5(F.col("id").cast("string")), "id", "version").limit(sample).withColumnRenamed("version", "its")
    texts = texts.join(F.broadcast(versions), (F.col("doc_id") == F.col("id")) & (F.col("version") == F.col("its"))).select("id", "y", "version", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in tb.str_chunks(batch.column(3)):
                found = pa.array([packed(*bucket_counts(t)) for t in chunk], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(chunk)) for k in (0, 1, 2)), found], ["id", "y", "version", "packed"])

    found = texts.mapInArrow(count, f"id {texts.schema['id'].dataType.simpleString()}, y int, version long, packed binary")
    # rows alike count once, and the order is fixed: the training is the same each time
    found = found.groupBy("id", "version").agg(F.first("y").alias("y"), F.first("packed").alias("packed"))
    found = found.orderBy(F.md5(F.col("id").cast("string")), "id", "version").select("y", "packed").toArrow()
    return train(Samples([x.as_buffer() for x in found["packed"]], found["y"].to_pylist()))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, with the model's one number a bucket broadcast."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in tb.str_chunks(batch.column(1)):
                found = shared.value.scores(chunk)
                columns = [batch.column(0).slice(at, len(chunk)), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return scored(docs, fit(docs, labels, **options)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, in one pass without a join."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            good = [s >= threshold for _, chunk in tb.str_chunks(column) for s in model.value.scores(chunk)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
