"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A batch of texts is one byte array with offsets. Words are byte ranges, hashed
eight bytes at a time; the hashes of windows of words are differences of a
running polynomial sum modulo 2**64: the cost is a few passes over the words,
whatever the width of a window. Two hashes of one window are independent if
their words were hashed with different seeds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M64 = (1 << 64) - 1
CHUNK = 4 << 20  # bytes of text handled at once
BLOCK = 1 << 18  # words whose windows are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 0x9E3779B97F4A7C15 & M64], np.uint64))[0]) | 1


class _Powers:
    """base**i and base**-i modulo 2**64, grown when longer arrays are asked for."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()

            def run(b: int) -> np.ndarray:
                x = np.full(size, b, np.uint64)
                x[0] = 1
                return np.multiply.accumulate(x)

            self.up, self.down = run(self.base), run(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_WORDS = {0: _Powers(23), 1: _Powers(37)}
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256  # bytes of a word that is hashed by itself

_code = np.arange(256)
#: Bytes of words: all but white space (space, tab to carriage return).
NOT_SPACE = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))
#: Bytes of words: ASCII letters and digits, and all that is not ASCII.
ALNUM = ((_code >= 48) & (_code <= 57)) | ((_code >= 97) & (_code <= 122)) | ((_code >= 65) & (_code <= 90)) | (_code >= 128)
#: A-Z to a-z.
LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # of no chunks
        col = pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK):
    """Runs of whole texts of about limit bytes: (first, last+1, bytes, offsets)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def find_words(data: np.ndarray, offs: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words end with their text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = of_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    full = offs[:-1] < offs[1:]
    at = offs[:-1][full]
    first[at] = w[at]
    at = offs[1:][full] - 1
    last[at] = w[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


class Words:
    """Eight bytes at a time from any place of a byte array (zeros after its end)."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        held = np.zeros((len(data) + 31) // 8 * 8, np.uint8)
        held[: len(data)] = data if fold is None else fold[data]
        self.raw, self.whole = held, held.view("<u8")

    def load(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n (0 to 8) bytes at `at`, as integers."""
        i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # a shift by 64 in two steps, as one is not defined
        x = self.whole[i] >> shift | (self.whole[i + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return x & _MASKS[n]


def hasher(data: np.ndarray, fold: np.ndarray | None = None, seed: int = 0):
    """A function of starts and ends that gives 64-bit hashes of byte ranges;
    fold maps bytes before. A hash chains the finaliser over blocks of eight
    bytes, so no inputs collide for every seed."""
    words, first = Words(data, fold), np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & M64)

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix(mix(size.astype(np.uint64) ^ first) ^ words.load(starts, np.clip(size, 0, 8)))
        more, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            h[more] = mix(h[more] * first ^ words.load(starts[more] + k, np.minimum(size[more] - k, 8)))
            k += 8
            more = more[size[more] > k]
        for i in np.flatnonzero(size > _LONG).tolist():
            own = hashlib.blake2b(words.raw[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(own.digest(), "little")
        return h

    return of


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    return hasher(data, fold, seed)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def windows(h: np.ndarray, doc: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of k words inside one text."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    return at, window_at(h, at, k, which)


def _running(h: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _WORDS[which].get(len(h) + 1)
    run = np.empty(len(h) + 1, np.uint64)
    run[0] = 0
    np.cumsum(h * up[: len(h)], out=run[1:])
    return run, down


def window_at(h: np.ndarray, at: np.ndarray, lengths, which: int = 0) -> np.ndarray:
    """Hashes of the windows of given lengths at given places, which ascend. A
    hash doesn't depend on where the sum begins: sums run over blocks of words."""
    out, sizes = np.empty(len(at), np.uint64), np.broadcast_to(lengths, len(at))
    edge = np.searchsorted(at, np.arange(0, len(h) + BLOCK, BLOCK))
    for first, x, y in zip(range(0, len(h), BLOCK), edge, edge[1:]):
        if x < y:
            k = sizes[x:y]
            run, down = _running(h[first : first + BLOCK + int(k.max())], which)
            own = at[x:y] - first
            out[x:y] = mix((run[own + k] - run[own]) * down[own] + k.astype(np.uint64))
    return out


def hashed_words(data: np.ndarray, offs: np.ndarray, of_word: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of a whole batch, chunk by chunk."""
    hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, _, part, o in chunks(data, offs):
        s, e, d = find_words(part, o, of_word)
        hs.append(hash_ranges(part, s, e, fold, seed))
        ds.append(d + a)
    return np.concatenate(hs), np.concatenate(ds)
