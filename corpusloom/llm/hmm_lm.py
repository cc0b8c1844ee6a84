"""Scoring texts with a hidden Markov language model.

Tokens are the words, A-Z lower-cased, and one end. Words are hashed into CLASSES classes (the end has its
own); the hidden Markov model has STATES latent states over class sequences, and a word's share of its class
follows its smoothed count; a class's unknown words are one token of count 0.5. So log10 P(text) = base -
sum log10 share(class) + log10 P_HMM(classes), where base is the smoothed unigram score and share(class) the
class's part of the smoothed mass.

* Counts. Tasks count the distinct words of their batches; a group-by on the word's hash (64 bits and 32 of a second
  hash) adds them up over all training texts.
* Training. The states begin as clusters of classes that keep the same company: a text's signature is the mean of its
  tokens' random signs (DIM of them for each class), tasks add up the signatures of the texts around each class, over
  every training text, and k-means parts the class means. Each
  Baum-Welch round then covers every training text: tasks run scaled forward and backward recursions over whole texts
  and emit expected counts, which Spark adds up by state and class. What reaches the driver has a fixed size, a few
  numbers a class.
* Scoring. The scaled forward recursion gives the exact likelihood of each whole text. The HEAD most frequent
  words' counts are broadcast (fixed size); the other occurrences are joined to the count table by hash, after
  being counted per document.

Texts are processed side by side, sorted by length, so a step of the recursion handles all texts of a batch
that are still running.

Defined cases: null counts as empty, which has the end token only; without training texts N and V are 0, the
base of a token is log10(0.5 / 0.5) = 0 and the model is uniform; rows with a null doc_id count as training
rows; repeated rows are counted and scored each, alike; words of equal counts are alike; very long texts are scored
whole, about 100 bytes of memory a word; an empty table gives no rows; other columns are ignored.

Scores are computed in double precision; expected counts of the training are kept in single precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.common import cut, stored, table, whole_text
from corpusloom.llm.quality import held_out

STATES = 8
CLASSES = 4096
END = CLASSES
DIM = 16
#: At the start a class belongs to its cluster by OWN, and a state goes on with STAY to 1 for each other one.
OWN, STAY = 0.7, 1000
HEAD = 65536
#: Fixed value: the hash that stands for the end token.
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)
CHUNK = 4_000_000


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, 32 bits of a second hash, and the number of tokens of each text; each ends with the end token."""
    found, tails, numbers, at = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    while at < len(texts):  # pieces that fit a processor's cache
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < 500_000):
            size, stop = size + len(texts[stop]), stop + 1
        raw, offsets = tb.joined(texts[at:stop])
        raw = tb.LOWER[raw]
        starts, ends = tb.word_spans(raw)
        counts = tb.words_per_text(starts, offsets)
        found.append(np.insert(tb.span_hashes(raw, starts, ends), np.cumsum(counts), END_HASH))
        tails.append(np.insert(tb.span_hashes(raw, starts, ends, 1).astype(np.uint32).view(np.int32), np.cumsum(counts), 0))
        numbers.append(counts + 1)
        at = stop
    return np.concatenate(found), np.concatenate(tails), np.concatenate(numbers)


def classes_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens == END_HASH, END, (tokens >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int32)


@dataclass
class Side:
    """Token sequences laid side by side: step t of the recursion covers rows cut[t] to cut[t + 1]."""

    order: np.ndarray
    classes: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(classes: np.ndarray, counts: np.ndarray) -> Side:
        order = np.argsort(-counts, kind="stable")
        begins = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        steps = int(length[0]) if len(length) else 0
        running = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # texts of at least t tokens
        cuts = np.concatenate([[0], np.cumsum(running)])
        at = begins[Side(order, classes, cuts).columns()]
        at += np.repeat(np.arange(steps), running)
        return Side(order, classes[at], cuts)

    def columns(self) -> np.ndarray:
        """Which sequence each place is of."""
        return np.arange(self.cuts[-1]) - np.repeat(self.cuts[:-1], np.diff(self.cuts))


@dataclass
class Hmm:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # (classes + 1, states)

    def forward(self, side: Side, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """log10 likelihood by column, if asked for the scaled forward values, and their scales."""
        n = int(side.cuts[1]) if len(side.cuts) > 1 else 0
        alpha = np.empty((len(side.classes), len(self.start)), np.float32) if keep else None
        scales = np.empty(len(side.classes))
        now = np.tile(self.start, (n, 1))
        ones, cuts = np.ones(len(self.start)), side.cuts.tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                now = now[: b - a] @ self.moves
            now *= self.emits[side.classes[a:b]]
            scale = now @ ones
            now /= scale[:, None]
            scales[a:b] = scale
            if keep:
                alpha[a:b] = now
        return np.bincount(side.columns(), weights=np.log10(scales), minlength=n), alpha, scales

    def expected(self, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts: starts, moves, emissions; and the log10 likelihood."""
        k = len(self.start)
        total, alpha, scales = self.forward(side, keep=True)
        moves, beta, back = np.zeros((k, k)), np.empty((0, k)), self.moves.T
        cuts = side.cuts.tolist()
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            here = np.ones((b - a, k))
            if len(beta):
                here[: len(beta)] = beta @ back
                moves += alpha[a : a + len(beta)].T @ beta
            alpha[a:b] *= here  # from here on the share of each state
            beta = here
            beta *= self.emits[side.classes[a:b]]
            beta /= scales[a:b, None]
        starts = alpha[: side.cuts[1]].sum(axis=0, dtype=np.float64) if len(side.cuts) > 1 else np.zeros(k)
        emits = np.stack([np.bincount(side.classes, weights=alpha[:, s], minlength=CLASSES + 1) for s in range(k)], axis=1)
        return starts, moves * self.moves, emits, float(total.sum())

    @staticmethod
    def from_counts(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Hmm:
        """Normalised counts. A state's emissions lean on the shares of all states, by as many counts as it has
        classes (Witten and Bell), so that nothing is impossible."""
        starts, moves = starts + 0.1, moves + 0.1
        overall = emits.sum(axis=1) + 0.5
        emits = emits + (overall / overall.sum())[:, None] * np.maximum((emits > 0.5).sum(axis=0), 1)
        return Hmm(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0, keepdims=True))


def first_model(company: np.ndarray, states: int = STATES, rounds: int = 20) -> Hmm:
    """States as clusters of classes by the texts they are in: rows of company_sums(), one a class.

    k-means weighted by the classes' counts, from centres far apart; what of a class is not its cluster's is shared by
    all of them."""
    counts = company[:, 0]
    if not counts.sum():
        return Hmm.from_counts(np.ones(states), np.ones((states, states)), np.ones((CLASSES + 1, states)))
    means = company[:, 1:] / np.maximum(counts, 1)[:, None]
    means -= counts @ means / counts.sum()
    weight = np.sqrt(counts)
    centres = [means[np.argmax(weight * (means**2).sum(axis=1))]]
    while len(centres) < states:
        apart = ((means[:, None] - np.array(centres)) ** 2).sum(axis=2).min(axis=1)
        centres.append(means[np.argmax(weight * apart)])
    centres = np.array(centres)
    for _ in range(rounds):
        own = ((means[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        size = np.bincount(own, weights=counts, minlength=states)
        sums = np.stack([np.bincount(own, weights=counts * means[:, d], minlength=states) for d in range(means.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    share = np.full((len(counts), states), (1 - OWN) / states)
    share[np.arange(len(counts)), own] += OWN
    return Hmm.from_counts(np.ones(states), np.eye(states) * STAY + 1, counts[:, None] * share)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out(parts=5, part=1).alias("held_out"), whole_text().alias("text"))


def token_counts(texts: DataFrame) -> DataFrame:
    """word, tail (hashes) and n over the given texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in tb.text_chunks(batch.column(0), CHUNK):
                words, tails, _ = tokens_of(chunk)
                order = np.argsort(words, kind="stable")
                words, tails = words[order], tails[order]
                first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (tails[1:] != tails[:-1])]))
                n = np.diff(np.concatenate([first, [len(words)]]))
                yield pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(tails[first]), pa.array(n)], ["word", "tail", "n"])

    return texts.select("text").mapInArrow(count, "word long, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def company_sums(texts: DataFrame, dim: int = DIM, seed: int = 11) -> np.ndarray:
    """For each class its count and, summed over its occurrences, the mean of its text's random signs, `dim` a class.

    All given texts count; a row a class reaches the driver."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (CLASSES + 1, dim))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES + 1, 1 + dim))
        for batch in batches:
            for _, chunk in tb.text_chunks(batch.column(0)):
                sums += company(chunk, signs)
        there = np.flatnonzero(sums[:, 0])
        values = pa.FixedSizeListArray.from_arrays(pa.array(sums[there].ravel()), 1 + dim).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), values], ["at", "sums"])

    rows = texts.select("text").mapInArrow(add, "at int, sums array<double>")
    out = np.zeros((CLASSES + 1, 1 + dim))
    for at, *values in rows.groupBy("at").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(1 + dim))).toPandas().itertuples(index=False):
        out[at] = values
    return out


def company(texts: list[bytes], signs: np.ndarray) -> np.ndarray:
    """What company_sums() adds up, of some texts."""
    tokens, _, lengths = tokens_of(texts)
    classes, text = classes_of(tokens), np.repeat(np.arange(len(texts)), lengths)
    parts = [np.bincount(classes, minlength=CLASSES + 1)]
    for column in signs.T:
        mean = np.bincount(text, weights=column[classes], minlength=len(texts)) / lengths
        parts.append(np.bincount(classes, weights=mean[text], minlength=CLASSES + 1))
    return np.stack(parts, axis=1)


def baum_welch(texts: DataFrame, model: Hmm) -> Hmm:
    """One round over all given texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        for batch in batches:
            for _, chunk in tb.text_chunks(batch.column(0), CHUNK):
                tokens, _, counts = tokens_of(chunk)
                s, m, e, _ = shared.value.expected(Side.of(classes_of(tokens), counts))
                starts, moves, emits = starts + s, moves + m, emits + e
        for kind, values in (("start", starts[None, :]), ("move", moves), ("emit", emits)):
            names = [pa.array([kind] * len(values)), pa.array(np.arange(len(values), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*names, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), states).cast(pa.list_(pa.float64()))], ["kind", "at", "counts"])

    rows = texts.select("text").mapInArrow(expect, "kind string, at int, counts array<double>")
    sums = rows.groupBy("kind", "at").agg(*(F.sum(F.col("counts")[s]).alias(f"s{s}") for s in range(states))).toPandas()
    parts = {k: np.zeros((n, states)) for k, n in (("start", 1), ("move", states), ("emit", CLASSES + 1))}
    for kind, at, *values in sums.itertuples(index=False):
        parts[kind][at] = values
    return Hmm.from_counts(parts["start"][0], parts["move"], parts["emit"])


@dataclass
class Fitted:
    hmm: Hmm
    shares: np.ndarray  # log10 of each class's share of the smoothed mass
    train_tokens: int
    vocabulary: int
    head: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted hashes of frequent words, their second ones and counts

    def unit(self) -> float:
        return self.train_tokens + 0.5 * (self.vocabulary + 1)


def frequent_words(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent words, HEAD at most: those above a count under which too many would qualify.

    The bound comes from a histogram of the counts' logarithms, of some hundred rows for any corpus."""
    most = HEAD if most is None else most
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for row in bins:
        total += row["words"]
        if total > most:
            break
        least = row["bin"]
    return counts.filter(F.lit(False) if least is None else F.floor(F.log2("n") * 16) >= least)


def fit(texts: DataFrame, counts: DataFrame, rounds: int = 2) -> Fitted:
    """The model from the training texts and their token counts (a checkpointed table)."""
    hmm = first_model(company_sums(texts))
    for _ in range(rounds):
        hmm = baum_welch(texts, hmm)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unsigned = F.expr(f"if(word = {int(END_HASH.view(np.int64))}, {END}, cast(pmod(shiftrightunsigned(word, 20), {CLASSES}) as int))")
    mass = np.zeros(CLASSES + 1)
    for at, value in counts.groupBy(unsigned.alias("class")).agg(F.sum(F.col("n") + 0.5)).collect():  # at most CLASSES + 1 rows
        mass[at] = float(value)
    mass[:CLASSES] += 0.5  # for the class's unknown words, which are one token
    mass[END] = max(mass[END], 1e-300)
    head = frequent_words(counts).toPandas().sort_values(["word", "tail"])
    fitted = Fitted(hmm, np.zeros(0), int(total[0]), int(total[1]), tuple(head[c].to_numpy(kind) for c, kind in (("word", np.int64), ("tail", np.int32), ("n", np.int64))))
    fitted.shares = np.log10(mass / fitted.unit())
    return fitted


def scores(texts: DataFrame, counts: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = texts.sparkSession.sparkContext.broadcast(fitted)
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.withColumn("version", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words_of_head, tails_of_head, counts_of_head = model.head
        unit = np.log10(model.unit())
        for batch in batches:
            for row, chunk in tb.text_chunks(batch.column(2), CHUNK):
                tokens, tails, lengths = tokens_of(chunk)
                classes = classes_of(tokens)
                side = Side.of(classes, lengths)
                likelihood = np.empty(len(chunk))
                likelihood[side.order] = model.hmm.forward(side)[0]
                text = np.repeat(np.arange(len(chunk)), lengths)
                likelihood -= np.bincount(text, weights=model.shares[classes], minlength=len(chunk))
                signed = tokens.view(np.int64)
                at = np.minimum(np.searchsorted(words_of_head, signed), max(len(words_of_head) - 1, 0))
                frequent = (words_of_head[at] == signed) & (tails_of_head[at] == tails) if len(words_of_head) else np.zeros(len(tokens), bool)
                base = np.bincount(text[frequent], weights=np.log10(counts_of_head[at[frequent]] + 0.5) - unit, minlength=len(chunk))
                known = np.bincount(text[frequent], minlength=len(chunk))
                rare = np.flatnonzero(~frequent)
                rare = rare[np.lexsort((tails[rare], signed[rare], text[rare]))]
                key = np.stack([text[rare], signed[rare], tails[rare]])
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
                first = np.flatnonzero(new)
                rare_text, rare_word, rare_tail = key[:, first]
                rare_n = np.diff(np.concatenate([first, [len(rare)]]))
                ends = np.searchsorted(rare_text, np.arange(len(chunk) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(row, len(chunk)) for k in (0, 1, 3)),
                        pa.array(lengths),
                        pa.array(known),
                        pa.array(base),
                        pa.array(likelihood),
                        pa.ListArray.from_arrays(ends, pa.array(rare_word)),
                        pa.ListArray.from_arrays(ends, pa.array(rare_tail.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(rare_n)),
                    ],
                    ["doc_id", "held_out", "version", "n_tokens", "known", "base", "model", "words", "tails", "times"],
                )

    fields = f"doc_id {kind}, held_out boolean, version long, n_tokens long, known long, base double, model double"
    scanned = stored(rows.select("doc_id", "held_out", "text", "version").mapInArrow(scan, fields + ", words array<long>, tails array<int>, times array<long>"), "scanned")
    # rows alike in id and text must count once below, as sums come back to each of them
    repeated = not scanned.groupBy("doc_id", "version").count().filter("count > 1").isEmpty()
    rare = scanned.select("doc_id", "version", F.explode(F.arrays_zip("words", "tails", "times")).alias("x"))
    rare = rare.select("doc_id", "version", F.col("x.words").alias("word"), F.col("x.tails").alias("tail"), F.col("x.times").alias("times"))
    rare = rare.distinct() if repeated else rare
    unit = fitted.unit()
    joined = rare.join(counts, ["word", "tail"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.groupBy("doc_id", "version").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(float(np.log10(unit))))).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    sums = sums.select(F.col("doc_id").alias("its"), F.col("version").alias("its_version"), "rare_base", "rare_known")
    whole = scanned.drop("words", "tails", "times").join(sums, F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("version") == F.col("its_version")), "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(fitted.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("model")).alias("score"),
    )


def hmm_scores(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    texts = _texts(docs)
    training = texts.filter(~F.col("held_out"))
    counts = cut(token_counts(training))
    return scores(texts, counts, fit(training, counts, rounds))


def op10(spark, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))
