"""Removal of passages that an earlier document has, exact at the level of 50-word windows.

1. Confirm. Every window of 50 words has an anchor: its 8-word phrase with the least hash (winnowing; the last of
   equals). Equal windows have equal anchors, so a passage of 50 words or more that recurs across documents has an
   anchor in each of them. One aggregation over (phrase, doc_id) confirms the phrases that are anchors in two
   documents or more.
2. Deal. The confirmed phrases are dealt by hash into shards of about SHARD, sorted and stored in the shared folder as
   numbers. A word is two letters of an automaton's text (8 bits of its hash), so a phrase is 16 letters, whatever language
   or length its words have.
3. Locate. Of a block of BLOCK words, usually all that a task has, all phrases meet the shards: those confirmed phrases
   that are said anywhere in the block go into its Aho-Corasick automata, AUTOMATON in each, and all words of all of its
   documents stream through them as letters. What they find are all occurrences of all confirmed phrases, as the ones left
   out are said nowhere in the block. A window is compared if the least of its phrases is an occurrence: no other window
   can recur. Consecutive windows with one such occurrence form a segment, and a document without any is done. Nothing
   else decides which windows are compared.
4. Compare. A segment is known by its anchor's hash and a hash of all its words. The smallest doc_id of each distinct
   segment owns it; every other document loses all of its windows. Distinct segments of one anchor are compared window
   by window, by (anchor, window) hashes.
5. Remove. Each document gets its segments' bits, one a window, and drops the words they cover.

Words are hashed twice, with seeds drawn anew for each call: the first hash gives letters and anchors, the second what
is compared, 64 bits each. Texts that exist before the seeds are drawn cannot be made to collide; by chance two
segments or windows of one anchor do with 2^-64.

The letters only locate: two phrases with the same letters cost a comparison and never a word. Nothing is sampled or
capped. A block passes its own automata only, a number that its words bound; what grows with the square of the input is
the reading of the shards, eight bytes for each confirmed phrase and block.

Defined cases: a null or empty text has no words; texts under 50 words lose nothing; a null doc_id neither
loses words nor takes them from others; rows that share a doc_id (repeated rows, too) do not take words from each
other; of equal windows the smallest doc_id's stays, wherever in its text; a text longer than a block is a block of
its own, so memory follows the longest text and a block's texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.common import cut, fresh_dir, stored, whole_text

PHRASE = 8
#: Confirmed phrases of one file (8 MB) and of one automaton (about 40 MB), and words that stream through it at a time, two
#: bytes each.
SHARD = 1_000_000
AUTOMATON = 100_000
BLOCK = 8_000_000


@dataclass
class Anchored:
    """Runs of windows that share an anchor: first window, number of windows, the anchor's letters (as a number) and
    hash, the text they are of, and the anchor's first word."""

    first: np.ndarray
    windows: np.ndarray
    phrase: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    anchor: np.ndarray

    @staticmethod
    def of(words: np.ndarray, per_text: np.ndarray, window: int) -> Anchored:
        """All runs of some texts."""
        last = len(words) - window + 1
        if last < 1:
            none = np.empty(0, np.int64)
            return Anchored(none, none, none, none.view(np.uint64), none, none)
        phrases = tb.run_hashes(words, PHRASE)
        chosen = tb.sliding_argmin(phrases, window - PHRASE + 1)
        text = np.repeat(np.arange(len(per_text)), per_text)
        fits = text[:last] == text[window - 1 :]
        at = np.flatnonzero(fits)
        anchor = chosen[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        starts = np.flatnonzero(new)
        anchor = anchor[starts]
        return Anchored(at[starts], np.diff(np.concatenate([starts, [len(at)]])), phrase_keys(words, anchor), phrases[anchor], text[at[starts]], anchor)

    def located(self, occurs: np.ndarray) -> Anchored:
        """The runs whose anchor occurs, given where in the letters of the texts phrases begin."""
        some = occurs[2 * self.anchor + self.owner]
        return Anchored(*(getattr(self, f.name)[some] for f in fields(self)))


Seeds = tuple[int, int]


def drawn() -> Seeds:
    """Seeds for one call."""
    return secrets.randbits(62), secrets.randbits(62)


def _word_hashes(texts: list[bytes], *seeds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A hash of each word for each seed, and the number of words of each text."""
    raw, offsets = tb.joined(texts)
    starts, ends = tb.word_spans(raw)
    return [tb.span_hashes(raw, starts, ends, seed) for seed in seeds], tb.words_per_text(starts, offsets)


def phrase_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A phrase's letters as one number: the low bytes of its words' hashes."""
    low = words.astype(np.uint8)
    return np.stack([low[at + k] for k in range(PHRASE)], axis=1).view("<i8").ravel() if len(at) else np.empty(0, np.int64)


def _pairs(low: np.ndarray) -> np.ndarray:
    """Two letters for each byte: one of A to P, one of a to p."""
    return np.stack([65 + (low >> 4), 97 + (low & 15)], axis=-1).astype(np.uint8)


def letters(phrases: np.ndarray) -> list[str]:
    """The letters of phrases."""
    low = np.ascontiguousarray(phrases, dtype="<i8").view(np.uint8).reshape(-1, PHRASE)
    return [row.tobytes().decode("ascii") for row in _pairs(low).reshape(len(low), 2 * PHRASE)]


def spelled(words: np.ndarray, per_text: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The letters of all words of some texts, a full stop after each text, and where each word begins."""
    place = 2 * np.arange(len(words)) + np.repeat(np.arange(len(per_text)), per_text)
    out = np.full(2 * len(words) + len(per_text), ord("."), dtype=np.uint8)
    out[place], out[place + 1] = _pairs(words.astype(np.uint8)).T
    return out.tobytes(), place


def automaton_of(phrases: np.ndarray) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton of phrases."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word in letters(phrases):
        automaton.add_word(word, 1)
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, text: str) -> np.ndarray:
    """Where phrases of the automaton begin in a text of letters: every occurrence."""
    if not len(automaton):
        return np.empty(0, np.int64)
    return np.fromiter((end for end, _ in automaton.iter(text)), dtype=np.int64) - (2 * PHRASE - 1)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, version (tells rows of one doc_id apart) and text."""
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", F.xxhash64("text").alias("version"), "text")


def recurring_phrases(rows: DataFrame, window: int, seeds: Seeds) -> DataFrame:
    """The phrases (column phrase) that are anchors in several documents."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in tb.text_chunks(batch.column(1)):
                (words,), per_text = _word_hashes(texts, seeds[0])
                found = Anchored.of(words, per_text, window)
                yield pa.RecordBatch.from_arrays([pa.array(found.phrase), batch.column(0).take(pa.array(found.owner + row))], ["phrase", "doc_id"])

    pairs = rows.filter("doc_id is not null").select("doc_id", "text").mapInArrow(scan, f"phrase long, doc_id {kind}")
    return pairs.groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("phrase")


def compiled(phrases: DataFrame, folder: str, shard: int = SHARD) -> list[str | None]:
    """Stores the (checkpointed) phrases in the folder, in shards of about `shard` sorted numbers; the files by shard,
    which is the phrase modulo their number.

    Names are unique to the attempt, and only those that Spark committed count."""
    shards = -(-phrases.count() // shard)
    if not shards:
        return []
    dealt = phrases.withColumn("shard", F.pmod("phrase", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard")

    def save_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)

        def saved(at: int, keys: list[np.ndarray]) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(np.sort(np.concatenate(keys)).astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([name])], ["shard", "file"])

        at, held = None, []  # the phrases of one shard
        for batch in batches:
            keys, of = batch["phrase"].to_numpy(), batch["shard"].to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if len(part) and of[part[0]] != at:
                    if held:
                        yield saved(at, held)
                    at, held = of[part[0]], []
                held.append(keys[part])
        if held:
            yield saved(at, held)

    files = stored(dealt.mapInArrow(save_shards, "shard long, file string"), "phrases")
    names = {r["shard"]: r["file"] for r in files.collect()}  # a name a shard
    return [names.get(k) for k in range(shards)]


def in_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers that two ascending arrays of distinct numbers share; the smaller is looked up in the larger."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if not len(few):
        return few
    return few[many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few]


SEGMENT = "struct<anchor: bigint, content: bigint, first: int, windows: int, hashes: array<bigint>>"


@dataclass
class Chunk:
    """Some rows of a block."""

    doc_id: pa.Array
    version: pa.Array
    texts: list[bytes]
    per_text: np.ndarray
    anchored: Anchored

    def rows(self, occurs: np.ndarray, window: int, texts: bool, seed: int) -> pa.RecordBatch:
        """What streamed() returns of them, given where in their letters confirmed phrases begin."""
        found, number = self.anchored.located(occurs), len(self.texts)
        bounds = np.searchsorted(found.owner, np.arange(number + 1))
        some = np.diff(bounds) > 0
        (compared,), _ = _word_hashes([t for t, s in zip(self.texts, some, strict=True) if s], seed)
        begin, hashed = np.cumsum(self.per_text) - self.per_text, np.where(some, self.per_text, 0)
        first = found.first - begin[found.owner]  # in its text
        start = first + (np.cumsum(hashed) - hashed)[found.owner]  # among the words hashed
        content = tb.range_hashes(compared, start, start + found.windows + window - 1)
        segment = np.repeat(np.arange(len(start)), found.windows)
        ends = np.cumsum(found.windows)
        at = start[segment] + np.arange(len(segment)) - (ends - found.windows)[segment]
        each = pa.array(tb.range_hashes(compared, at, at + window).view(np.int64))
        values = [found.hashes.view(np.int64), content.view(np.int64), first.astype(np.int32), found.windows.astype(np.int32)]
        windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), each)
        inner = pa.StructArray.from_arrays([*map(pa.array, values), windows], ["anchor", "content", "first", "windows", "hashes"])
        kept = [t.decode("utf-8", "surrogatepass") if s or texts else None for t, s in zip(self.texts, some, strict=True)]
        digests = [None if s else hashlib.sha256(b" ".join(t.split())).hexdigest() for t, s in zip(self.texts, some, strict=True)]
        columns = [self.doc_id, self.version, pa.array(self.per_text), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), inner), pa.array(kept, pa.string()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_words", "segments", "text", "digest"])


def streamed(rows: DataFrame, folder: str, files: list[str | None], window: int, seeds: Seeds, texts: bool = False, block: int = BLOCK) -> DataFrame:
    """Every row after the automata of its block: doc_id, version, n_words, segments (with located anchors), text (of rows
    with segments, or of all) and digest (SHA-256 of all words, of rows without)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)

        def passed(held: list[Chunk], spelt: list[bytes], said: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own, there = np.unique(np.concatenate(said)), []
            said.clear()
            for name in filter(None, files):
                with system.open_input_stream(f"{path}/{name}", compression=None) as saved:
                    there.append(in_both(own, np.frombuffer(saved.read(), "<i8")))
            del own
            phrases = np.concatenate(there or [np.empty(0, np.int64)])
            text = b"".join(spelt).decode("ascii")
            occurs = np.zeros(len(text) + 1, dtype=bool)
            for some in range(0, len(phrases), AUTOMATON):
                automaton = automaton_of(phrases[some : some + AUTOMATON])
                occurs[occurrences(automaton, text)] = True
                del automaton
            del text
            at = 0
            for chunk, part in zip(held, spelt, strict=True):
                yield chunk.rows(occurs[at : at + len(part)], window, texts, seeds[1])
                at += len(part)

        held, spelt, said, size = [], [], [], 0
        for batch in batches:
            for row, found in tb.text_chunks(batch.column(2)):
                (words,), per_text = _word_hashes(found, seeds[0])
                own = (pa.concat_arrays([batch.column(k).slice(row, len(found))]) for k in (0, 1))
                held.append(Chunk(*own, found, per_text, Anchored.of(words, per_text, window)))
                spelt.append(spelled(words, per_text)[0])
                said.append(np.unique(phrase_keys(words, np.arange(len(words) - PHRASE + 1))))
                size += len(words)
                if size >= block:
                    yield from passed(held, spelt, said)
                    held, spelt, said, size = [], [], [], 0
        if held:
            yield from passed(held, spelt, said)

    return rows.mapInArrow(scan, f"doc_id {kind}, version long, n_words long, segments array<{SEGMENT}>, text string, digest string")


def repeated_windows(located_rows: DataFrame) -> DataFrame:
    """doc_id, version, first, bits: bit k tells that the window at word first + k goes.

    `located_rows` are those of streamed() with a doc_id."""
    every = located_rows.select("doc_id", "version", F.explode("segments").alias("s")).select("doc_id", "version", "s.*")
    narrow = every.select("doc_id", "version", "anchor", "content", "first", "windows")
    distinct = cut(narrow.groupBy("anchor", "content").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")))
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("owner").alias("low"), F.max("last").alias("high"))
    anchors = cut(anchors.filter("kinds > 1 and low < high").select("anchor"))
    # windows of each contested segment, as its owner has them
    contested = cut(distinct.join(anchors, "anchor", "left_semi").select("anchor", "content", F.col("owner").alias("doc_id")))
    windows = every.select("doc_id", "anchor", "content", "hashes").join(contested, ["anchor", "content", "doc_id"], "left_semi")
    windows = stored(windows.select("doc_id", "anchor", "content", F.posexplode("hashes").alias("offset", "window")), "windows")
    shared = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    shared = cut(shared.filter("earliest < latest").drop("latest"))
    lost = windows.join(shared, ["anchor", "window"]).filter("earliest < doc_id")
    lost = lost.groupBy("anchor", "content").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("part"))
    marks = distinct.join(lost, ["anchor", "content"], "left").filter("owner < last or part is not null")
    marks = cut(marks.select("anchor", "content", "owner", F.coalesce("part", F.lit(0)).alias("part")))
    whole = F.expr("shiftleft(1L, windows) - 1")
    hit = narrow.join(marks, ["anchor", "content"])
    hit = hit.select("doc_id", "version", "first", F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(F.col("part")).alias("bits"))
    return hit.filter("bits <> 0")


def without_repeats(docs: DataFrame, window: int = 50, text: bool = False, seeds: Seeds | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words that stay, by one blank).

    Without seeds they are drawn at random, which no result depends on."""
    if not PHRASE <= window < 64 + PHRASE - 1:
        raise ValueError("a window has 8 to 70 words: a segment's windows are the bits of a long")
    rows, seeds = _rows(docs), seeds or drawn()
    folder = fresh_dir(docs.sparkSession, "automata")
    files = compiled(cut(recurring_phrases(rows, window, seeds)), folder)
    passed = stored(streamed(rows, folder, files, window, seeds, text), "streamed")
    hit = passed if text else passed.filter("size(segments) > 0")
    marks = repeated_windows(passed.filter("doc_id is not null")).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "bits")).alias("marks"))
    hit = hit.select("doc_id", "version", "text", "n_words").join(marks, ["doc_id", "version"], "left")
    left = hit.select("doc_id", "text", F.expr("marks.first").alias("first"), F.expr("marks.bits").alias("bits"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for value, first, bits in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = value.as_py().encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if first.is_valid:
                    goes = np.unpackbits(np.array(bits.values).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    segment, offset = np.nonzero(goes)
                    at = np.array(first.values)[segment] + offset
                    change = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
                    words = [w for w, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n]
                n_removed.append(n_words[-1] - len(words))
                line = b" ".join(words)
                digests.append(hashlib.sha256(line).hexdigest())
                if text:
                    kept.append(line.decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    some = left.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
    if text:
        return some
    untouched = passed.filter("size(segments) = 0")
    return some.unionByName(untouched.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")))
