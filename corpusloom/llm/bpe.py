"""BPE encoding and decoding of whole texts with batched numpy merge rounds.

The vocabulary file (path is a parameter) is read once on the driver and broadcast; its size is fixed by the
file. In a task the distinct words that are new to it are encoded together: their symbols lie in one flat
array, adjacent pairs become keys a * size + b, a binary search over the sorted merge keys gives ranks, each
word's lowest rank is found by a segmented minimum, and all words merge at once, round by round. Finished
words leave the array. Words seen before come from a table that starts anew beyond WORDS entries. Words of more than
LONG symbols would keep the array for as many rounds as they have merges: each is merged by itself, lowest rank and
then leftmost first, from a heap of its pairs, in time n log n of its length.

All occurrences of a word's lowest pair merge in one round. That equals merging one at a time, as every pair
that holds a merged symbol ranks after the merge that makes it; a file for which this fails is refused.

Defined cases: null counts as the empty text, which has no ids; strings of special tokens in a text become
their ids; repeated rows and ties give repeated rows; a very long text is encoded whole, in a chunk of its own, so memory
follows the longest text; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.common import whole_text

WORDS = 300_000
LONG = 256
CHUNK_CHARS = 500_000
#: Code points whose letters and digits came after Unicode 16.
AFTER_16 = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Lower case of capitals that came with Unicode 16 and 17.
NEW_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Combining marks that the tokenizers library's normalisation table does not have. It neither reorders
#: nor composes them, so they stand like letters between what is before and after them.
NEW_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF),
    (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A),
    (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: The tables above complete this version of the interpreter's data, and a regex module that knows letters of Unicode
#: 17 (the first) and none of a later version (the second is not assigned in it).
MADE_FOR = ("15.1.0", "\U00016EA0", "\U0003347A")
NO_RANK = np.iinfo(np.int64).max
NEW_MARK = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEW_MARKS) + "])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def normalized(text: str) -> str:
    """NFC as the library's table has it."""
    if text.isascii() or unicodedata.is_normalized("NFC", text) and not NEW_MARK.search(text):
        return text
    return "".join(unicodedata.normalize("NFC", part) for part in NEW_MARK.split(text))


def check_tables() -> None:
    """Warns where the interpreter's or the regex module's data are of another version than the tables here."""
    version, last, beyond = MADE_FOR
    if unicodedata.unidata_version != version or not regex.match(r"\p{L}", last) or regex.match(r"\p{L}", beyond):
        warnings.warn(f"the tables of rare characters are for Unicode {version} and a regex module of Unicode 17; characters newer than Unicode 9 may be encoded otherwise", stacklevel=2)


def newer_letters() -> str:
    """Letters and digits of the regex module that the tokenizers library's older table does not know."""
    every = "".join(chr(c) for first, last in AFTER_16 for c in range(first, last + 1))
    return "".join(regex.findall(r"[\p{L}\p{N}]", every))


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE file with word ends."""

    tokens: list[str]
    specials: dict[str, int]
    pattern: str
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    newer: str
    #: rank and made symbol by key, for long words; filled when a worker first meets one
    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)

    @staticmethod
    def read(path: str) -> Vocabulary:
        check_tables()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, i in vocab.items():
            tokens[i] = text
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in specials.items():
            tokens[i] = text
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        born: dict[int, int] = {}
        for rank, (_, _, made) in enumerate(pairs):
            if made in born:
                raise ValueError("two merges make one token; merging all occurrences at once would not be exact")
            born[made] = rank
        if any(max(born.get(a, -1), born.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(pairs)):
            raise ValueError("a merge ranks before one of its parts")
        keys = np.array([a * len(tokens) + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        symbols = byte_symbols()
        return Vocabulary(
            tokens,
            specials,
            split["pattern"]["Regex"],
            keys[order],
            order.astype(np.int64),
            np.array([m for _, _, m in pairs], dtype=np.int64)[order],
            np.array([vocab[s] for s in symbols], dtype=np.int64),
            np.array([vocab[s + end] for s in symbols], dtype=np.int64),
            newer_letters(),
        )

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each word (none may be empty)."""
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self.merge_rounds(words)
        flat, counts = self.merge_rounds([w for i, w in enumerate(words) if i not in long])
        ends = iter(np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else [])
        each = [long[i] if i in long else next(ends) for i in range(len(words))]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, by a heap of its adjacent pairs over a linked list of symbols."""
        if not self.pairs:
            self.pairs.update(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        raw, size, pairs = np.frombuffer(word, dtype=np.uint8), len(self.tokens), self.pairs
        ids = [*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            found = pairs.get(key := ids[i] * size + ids[i + 1])
            if found:
                heap.append((found[0], i, key))
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] * size + ids[j] != key:
                continue  # one of the two has been merged since
            ids[i], ids[j] = pairs[key][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    found = pairs.get(key := ids[left] * size + ids[after[left]])
                    if found:
                        heapq.heappush(heap, (found[0], left, key))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of any length, all at once."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[raw]
        lasts = np.cumsum(lengths) - 1
        ids[lasts] = self.final[raw[lasts]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        size = len(self.tokens)
        while len(ids):
            keys = ids[:-1] * size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(ids), NO_RANK)
            rank[:-1] = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(ids)]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), counts)
            over = least == NO_RANK
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
            hit = (rank == least) & ~over
            # of overlapping occurrences (a a a) every other one, from the left
            where = np.flatnonzero(hit)
            if len(where):
                new_run = np.concatenate([[True], np.diff(where) > 1])
                run_start = where[new_run][np.cumsum(new_run) - 1]
                where = where[(where - run_start) % 2 == 0]
                ids[where] = self.made[at[where]]
                keep = ~over
                keep[where + 1] = False
                ids, owner = ids[keep], owner[keep]
            else:
                break
        flat_owner = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
        order = np.argsort(flat_owner, kind="stable")
        flat = np.concatenate(done_ids)[order] if done_ids else np.empty(0, np.int64)
        return flat, np.bincount(flat_owner, minlength=len(words))


class Encoder:
    """Encodes texts, keeping the ids of the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")")
        self.newer = set(vocabulary.newer)
        self.rare = regex.compile(r"[^\x00-\u0557]")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, text: str) -> list[str]:
        text = normalized(text)
        text = text.replace("Σ", "σ").lower()  # one character at a time: no final sigma
        rare = self.rare.findall(text)
        if not rare:
            return self.find(text)
        text = text.translate(NEW_CAPITALS)
        odd = self.newer.intersection(text)
        if not odd:
            return self.find(text)
        free = (c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in text)  # private characters are no letters
        there = dict(zip(map(ord, sorted(odd)), free, strict=False))
        back = {ord(v): k for k, v in there.items()}
        return [w.translate(back) for w in self.find(text.translate(there))]

    def _learn(self, words: list[str]) -> None:
        flat, counts = self.vocabulary.merge([w.encode("utf-8") for w in words])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        if len(self.known) > WORDS:
            self._forget()
        parts = [[p if i % 2 else self._words(p) for i, p in enumerate(self.special.split(t))] for t in texts]
        new = dict.fromkeys(w for text in parts for p in text if isinstance(p, list) for w in p if w not in self.known)
        if new:
            self._learn(list(new))
        return [np.concatenate([self._ids(p) for p in text]).astype("<u4") for text in parts]

    def _ids(self, part: str | list[str]) -> np.ndarray:
        if isinstance(part, str):
            return np.array([self.vocabulary.specials[part]], dtype=np.int64)
        known = self.known
        index = np.fromiter((known[w] for w in part), dtype=np.int64, count=len(part))
        counts = self.counts[index]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[index] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by blanks, as the file names no decoder; ids without a token are left out."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded (text)."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path or default_path()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                found = encoder.encode(texts)
                back = [encoder.decode(x) for x in found]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32)))
                    names.append("ids")
                if decoded:
                    columns.append(pa.array(back))
                    names.append("decoded")
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(scan, schema + ", ids array<int>" * ids + ", decoded string" * decoded)
