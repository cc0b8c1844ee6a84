"""Words and n-grams of many texts at once as numpy arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: splitmix64's constants.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: Spans of more bytes are hashed one by one with XXH3.
LONG = 256
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, a bijection: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each between two blanks of its own, and where each text begins (and the last ends)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    raw = np.frombuffer(b" " + b"  ".join(texts) + b" " if texts else b"", dtype=np.uint8)
    return raw, np.concatenate([[0], np.cumsum(lengths)])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    space = IS_SPACE[raw]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each (non-empty) span of bytes; equal spans, equal hashes. Another seed, another hash.

    Spans are taken eight bytes at a time: the state, begun from the length and the seed, is xored with them and mixed,
    so spans of one length up to eight bytes never share a hash. Longer ones can be made to if the seed is known: where
    a collision would decide a result, the seed is drawn at random. Spans beyond LONG bytes are hashed with XXH3."""
    lengths = ends - starts
    state = mixed(lengths.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64))
    if not len(starts):
        return state
    spare = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", buffer=spare, strides=(1,))
    state = mixed(state ^ (eights[starts] & MASKS[np.minimum(lengths, 8)]))
    todo = np.flatnonzero((lengths > 8) & (lengths <= LONG))
    at, left = starts[todo] + 8, lengths[todo] - 8
    while len(todo):
        state[todo] = mixed(state[todo] ^ (eights[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        state[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return state


def words_per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    return np.diff(np.searchsorted(starts, offsets))


def run_hashes(hashes: np.ndarray, width: int, multiplier: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of every run of `width` consecutive values, len(hashes) - width + 1 of them."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    m = pow(multiplier | 1, 1, 2**64)
    up = np.full(n, m, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(m, -1, 2**64), dtype=np.uint64)
    down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])


def str_chunks(column: pa.Array, most: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column with the first one's row, in pieces of about `most` characters; null is empty."""
    held: list[str] = []
    first = size = 0
    for row, value in enumerate(column):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held


def text_chunks(column: pa.Array, most: int = 500_000) -> Iterator[tuple[int, list[bytes]]]:
    """The same in UTF-8, in pieces of about `most` characters."""
    for first, texts in str_chunks(column, most):
        yield first, [t.encode("utf-8", "surrogatepass") for t in texts]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each range of consecutive values."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(hashes)
    up = np.full(n, multiplier, dtype=np.uint64)
    down = np.full(n, pow(multiplier, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every `width` consecutive values is, the last of equals."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        if len(best) <= step:
            return np.empty(0, np.int64)
        take = best[step:] <= best[:-step]
        best = np.where(take, best[step:], best[:-step])
        at = np.where(take, at[step:], at[:-step])
        span += step
    return at
