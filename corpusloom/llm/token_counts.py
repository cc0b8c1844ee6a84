"""Token counts by a byte-level BPE vocabulary, without moving a pre-token.

1. Split. Texts are cut into the library's pre-tokens by numpy over all their characters at once: runs of letters,
   digits, blanks and other characters, a leading blank, contractions. The class of a character is asked of the
   library itself when a worker first meets it.
2. Frequent pre-tokens. One pass over all texts: each task counts pre-tokens of up to 15 bytes in a bounded table and
   emits its HEAD most frequent as one packed row; such summaries are merged FAN at a time until few are left. They are
   all that moves. Counts of rare pre-tokens may get lost on the way, which decides nothing but speed.
3. First tier. The lengths in tokens of the most frequent pre-tokens, at most TABLE of them, are broadcast as one open
   hash table of numpy arrays. A pre-token of up to 15 bytes and its length are two 64-bit words, so a hit is certain and
   not a matter of hashes.
4. Second tier. What is not found goes to the worker's own cache of at most CACHE pre-tokens, and what is not there
   through the library's merges.

Nothing is sampled or capped; whatever the table holds, counts are the library's.

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of special tokens in a text count as one token
each; repeated rows give repeated rows; a very long text is cut before a blank after PIECE characters, which always
begins a pre-token, so that memory follows the longest word; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import textbytes as tb
from corpusloom.llm.common import stored, table, whole_text

HEAD = 16_384
TABLE = 65_536
FAN = 16
CACHE = 200_000
CHUNK = 400_000
PIECE = 1_000_000
#: Pre-tokens that a task counts before it forgets the rarer ones.
COUNTED = 1 << 18
SHORT = 15
OTHER, LETTER, DIGIT, BLANK, END, UNKNOWN = range(6)
#: The contractions that begin a pre-token.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
CUT = re.compile(r"(?<=\S)[ \n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def checked(spec: str) -> tuple[str, ...]:
    """The special tokens of a tokenizer's JSON; a file that splits texts in another way is refused."""
    parts = json.loads(spec)
    split = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or parts["model"].get("ignore_merges"):
        raise ValueError("a byte-level tokenizer without normaliser and prefix blanks is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
        raise ValueError("added tokens must stand for their own strings only")
    return tuple(t["content"] for t in parts["added_tokens"])


class Splitter:
    """Cuts texts into pre-tokens and knows how many tokens one has."""

    def __init__(self, spec: str, specials: tuple[str, ...]):
        self.library = Tokenizer.from_str(spec)
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.symbols = bytes_to_symbols()

    def tokens(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        return len(self.library.model.tokenize(word.decode("latin-1").translate(self.symbols)))

    def _class(self, code: int) -> int:
        whole = lambda before: len(self.library.pre_tokenizer.pre_tokenize_str(before + chr(code))) == 1
        return next((kind for before, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)) if whole(before)), BLANK)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """What is between special tokens, in pieces, and the number of special tokens."""
        parts = [text] if self.special is None else self.special.split(text)
        out = []
        for part in parts:
            at = 0
            while len(part) - at > PIECE and (cut := CUT.search(part, at + PIECE)):
                out.append(part[at : cut.start()])
                at = cut.start()
            out.append(part[at:] if at else part)
        return out, len(parts) - 1

    def split(self, pieces: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes, the starts and ends of all pre-tokens in them, and the number of pre-tokens of each piece."""
        joined = "\n".join(pieces) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        for new in np.unique(code[kind == UNKNOWN]).tolist():
            self.classes[new] = self._class(new)
            kind = self.classes[code]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        kind[ends] = END
        before = np.concatenate([[END], kind[:-1]])
        after_space = np.concatenate([[False], (code[:-1] == 32) & (kind[:-1] == BLANK)])
        begins = kind != before
        blank = kind == BLANK
        start = begins & ((kind == END) | blank | ~after_space)
        # the last blank before a word is not part of the blanks before it
        start[:-1] |= blank[:-1] & (kind[1:] < BLANK)
        # an apostrophe alone, not after a space, and what follows it
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
        if len(quote):
            padded = np.concatenate([code, np.zeros(2, np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            for tail in CONTRACTIONS:
                hit = quote[(one == ord(tail[0])) & (len(tail) == 1 or two == ord(tail[-1]))]
                start[hit + 1] = False
                following = hit + 1 + len(tail)
                start[following[kind[following] == LETTER]] = True
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        bounds = np.flatnonzero(start)
        at = (np.cumsum(width) - width)[bounds]
        real = kind[bounds] != END
        first, last = at[:-1][real[:-1]], at[1:][real[:-1]]
        return joined.encode("utf-8"), first, last, np.diff(np.searchsorted(bounds[real], np.concatenate([[0], ends])))


def bytes_to_symbols() -> dict[int, int]:
    """The character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}


def short_keys(raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each span of at most SHORT bytes, which no other span has."""
    spare = np.frombuffer(raw + bytes(16), np.uint8)
    eights = np.ndarray((len(raw) + 8,), "<u8", buffer=spare, strides=(1,))
    size = last - first
    low = eights[first] & tb.MASKS[np.minimum(size, 8)]
    high = eights[first + 8] & tb.MASKS[np.clip(size - 8, 0, 8)]
    return low, high | (size.astype(np.uint64) << np.uint64(56))


def slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return tb.mixed(low ^ tb.mixed(high))


def word_of(low: int, high: int) -> bytes:
    """The span that two words stand for."""
    return (low.to_bytes(8, "little") + high.to_bytes(8, "little"))[: high >> 56]


class Summary:
    """Counts of short pre-tokens, of which the rarer ones are forgotten beyond COUNTED."""

    def __init__(self):
        self.held = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        self.new: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            _, at, counts = np.unique(slots(low, high), return_index=True, return_counts=True)
            low, high = low[at], high[at]
        self.new.append([low, high, counts])
        self.size += len(low)
        if self.size > 2 * COUNTED:
            self.shrink(COUNTED)

    def shrink(self, most: int) -> None:
        low, high, counts = (np.concatenate([h, *(n[i] for n in self.new)]) for i, h in enumerate(self.held))
        _, at, of = np.unique(slots(low, high), return_index=True, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, of, counts)
        best = np.lexsort((low[at], high[at], -total))[:most]
        self.held, self.new, self.size = [low[at][best], high[at][best], total[best]], [], 0

    def row(self, most: int) -> pa.RecordBatch:
        self.shrink(most)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in self.held], ["low", "high", "counts"])

    def add_row(self, row: dict) -> None:
        self.add(np.frombuffer(row["low"], np.uint64), np.frombuffer(row["high"], np.uint64), np.frombuffer(row["counts"], np.int64))


SUMMARY = "low binary, high binary, counts binary"


def chunks(splitter: Splitter, column: pa.Array) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Rows, pieces of text and special tokens of each piece's row, by chunks of about CHUNK characters.

    A row has one piece or more; special tokens are noted at its first."""
    rows, held, extra, size = [], [], [], 0
    for row, value in enumerate(column):
        pieces, specials = splitter.pieces(value.as_py() or "")
        for i, piece in enumerate(pieces):
            rows.append(row)
            held.append(piece)
            extra.append(specials if i == 0 else 0)
            size += len(piece) + 1
            if size >= CHUNK:
                yield rows, held, extra
                rows, held, extra, size = [], [], [], 0
    if held:
        yield rows, held, extra


def frequent(texts: DataFrame, spec: str, specials: tuple[str, ...]) -> list[bytes]:
    """The most frequent pre-tokens of up to SHORT bytes in a column of texts, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, summary = Splitter(spec, specials), Summary()
        for batch in batches:
            for _, pieces, _ in chunks(splitter, batch.column(0)):
                raw, first, last, _ = splitter.split(pieces)
                short = last - first <= SHORT
                summary.add(*short_keys(raw, first[short], last[short]))
        yield summary.row(HEAD)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary()
        for batch in batches:
            for row in batch.to_pylist():
                summary.add_row(row)
        yield summary.row(TABLE)

    summaries = stored(texts.mapInArrow(count, SUMMARY), "pre-tokens")
    while (n := summaries.count()) > FAN:
        summaries = stored(summaries.repartition(-(-n // FAN)).mapInArrow(merge, SUMMARY), "pre-tokens")
    total = Summary()
    for row in summaries.collect():  # FAN packed rows at most
        total.add_row(row.asDict())
    total.shrink(TABLE)
    return [word_of(a, b) for a, b in zip(total.held[0].tolist(), total.held[1].tolist(), strict=True)]


class Lengths:
    """An open hash table from short pre-tokens to their numbers of tokens; a key is in its slot or the next one."""

    def __init__(self, words: list[bytes], tokens: list[int]):
        self.mask = np.uint64((1 << max(4, (2 * len(words)).bit_length())) - 1)
        size = int(self.mask) + 1
        self.low, self.high, self.tokens = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        if not words:
            return
        raw, ends = b"".join(words), np.cumsum([len(w) for w in words])
        low, high = short_keys(raw, np.concatenate([[0], ends[:-1]]), ends)
        for place, a, b, n in zip((slots(low, high) & self.mask).tolist(), low.tolist(), high.tolist(), tokens, strict=True):
            for at in (place, (place + 1) % size):
                if not self.high[at]:
                    self.low[at], self.high[at], self.tokens[at] = a, b, n
                    break

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of tokens, 0 where the table has none."""
        at = (slots(low, high) & self.mask).astype(np.int64)
        out = np.where((self.low[at] == low) & (self.high[at] == high), self.tokens[at], 0)
        rest = np.flatnonzero(out == 0)
        at = (at[rest] + 1) & int(self.mask)
        out[rest] = np.where((self.low[at] == low[rest]) & (self.high[at] == high[rest]), self.tokens[at], 0)
        return out


class Counter:
    """Counts tokens of texts by both tiers."""

    def __init__(self, spec: str, specials: tuple[str, ...], lengths: Lengths):
        self.splitter, self.lengths = Splitter(spec, specials), lengths
        self.cache: dict[bytes, int] = {}

    def of(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece."""
        raw, first, last, per_piece = self.splitter.split(pieces)
        found = np.zeros(len(first), np.int64)
        short = np.flatnonzero(last - first <= SHORT)
        found[short] = self.lengths.of(*short_keys(raw, first[short], last[short]))
        missed = np.flatnonzero(found == 0)
        cache, tokens = self.cache, self.splitter.tokens
        if len(cache) > CACHE:
            cache.clear()
        for i, a, b in zip(missed.tolist(), first[missed].tolist(), last[missed].tolist(), strict=True):
            word = raw[a:b]
            n = cache.get(word)
            if n is None:
                n = tokens(word)
                if b - a <= 256:
                    cache[word] = n
            found[i] = n
        upto = np.concatenate([[0], np.cumsum(found)])
        bounds = np.concatenate([[0], np.cumsum(per_piece)])
        return upto[bounds[1:]] - upto[bounds[:-1]]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of every row."""
    with open(path or default_path(), encoding="utf-8") as file:
        spec = file.read()
    specials = checked(spec)
    text = whole_text().alias("text")
    words = frequent(docs.select(text), spec, specials)
    count = Splitter(spec, specials).tokens
    shared = docs.sparkSession.sparkContext.broadcast((spec, specials, Lengths(words, [count(w) for w in words])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            total = np.zeros(len(batch), np.int64)
            for rows, pieces, extra in chunks(counter.splitter, batch.column(2)):
                np.add.at(total, rows, counter.of(pieces) + extra)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op12(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
