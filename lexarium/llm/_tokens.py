"""Token ids of whole texts, by the tokenizers library, each distinct word once.

A text is cut before white space that follows a visible character. Neither
vocabulary's pre-tokeniser lets a token cross such a cut, nor looks across it,
so the ids of a text are those of its cuts, one after the other. A bounded
table of cuts already encoded lives in the Python worker across tasks; it
compares the cuts' bytes, not hashes.
"""

from __future__ import annotations

import os

import numpy as np

from lexarium.llm._words import NOT_SPACE, Words, chunks, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SLOTS = 1 << 20  # cuts remembered at most
_POOL = 12 << 20  # ids remembered, about
_LONG = 1 << 16  # longer cuts remembered, about
_TEXT = 1 << 19  # bytes of text encoded at once: some 60 bytes of arrays and strings stand beside each
_RUN = 256  # cuts encoded as one string
_MARK = " \ue000"  # stands between them: a character of its own, after white space
_LOADED: dict = {}


def _cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of cuts. White space outside ASCII also counts as white space,
    told by its last two bytes (those of other characters may do so too: then
    a cut is merely longer)."""
    space = ~NOT_SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    odd = np.flatnonzero(cut[2:] & (data[1:-1] >= 0x80)) + 2
    if len(odd):
        last, before = data[odd - 1], data[odd - 2]
        wide = ((last <= 0x8A) | np.isin(last, (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))) & np.isin(before, (0xC2, 0x9A, 0x80, 0x81))
        cut[odd[wide]] = False
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts. A cut of up to 16 bytes is found again by its bytes in
    a table with one place for each slot; longer ones in a dictionary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.kind = np.uint16 if self.tok.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.low, self.high = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.size, self.n = np.zeros(_SLOTS, np.uint8), np.zeros(_SLOTS, np.uint16)
        self.at = np.zeros(_SLOTS, np.uint32)
        self._empty()

    def _empty(self) -> None:
        self.pool, self.used, self.long = np.zeros(1 << 20, self.kind), 0, {}
        self.size[:] = 0  # no cut has no bytes

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _groups(self, cuts: list[str]):
        """For runs of cuts, their ids and how many each has: a run is encoded as
        one string, a mark of its own between cuts. Where a cut holds the mark,
        each is encoded by itself."""
        k, m = _RUN, len(self.mark)
        runs = [cuts[i : i + k] for i in range(0, len(cuts), k)]
        for i in range(0, len(runs), 64):
            some = runs[i : i + 64]
            done = self.tok.encode_batch_fast([_MARK.join(r) for r in some], add_special_tokens=False)
            for run, e in zip(some, done):
                ids = np.array(e.ids, np.uint32)
                hit = np.ones(max(0, len(ids) - m + 1), bool)
                for j, x in enumerate(self.mark):
                    hit &= ids[j : len(ids) - m + 1 + j] == x
                at = np.flatnonzero(hit)
                if len(at) == len(run) - 1:
                    inner = np.ones(len(ids), bool)
                    inner[at[:, None] + np.arange(m)] = False
                    size = np.diff(np.concatenate([[-m], at, [len(ids)]])) - m
                    yield ids[inner], size
                else:
                    lists = [x.ids for x in self.tok.encode_batch_fast(run, add_special_tokens=False)]
                    yield np.array([x for ids in lists for x in ids], np.uint32), np.array([len(x) for x in lists], np.int64)

    def _new(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool has the ids of cuts that weren't known, and how many."""
        ids, size = zip(*self._groups([c.decode("utf-8", "replace") for c in cuts]))
        size = np.concatenate(size)
        return self._keep(np.concatenate(ids)) + np.cumsum(size) - size, size

    def _chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > _POOL:
            self._empty()
        starts = _cuts(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        size, words = ends - starts, Words(data)
        low, high = words.load(starts, np.minimum(size, 8)), words.load(starts + 8 if len(data) > 8 else starts, np.clip(size - 8, 0, 8))
        slot = (mix(low ^ mix(high + size.astype(np.uint64))) >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        new = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high) | (self.size[slot] != size))
        raw = data.tobytes() if len(new) else b""
        brief = new[size[new] <= 16]
        if len(brief):
            key = np.empty(len(brief), [("l", "<u8"), ("h", "<u8"), ("s", "<i8")])
            key["l"], key["h"], key["s"] = low[brief], high[brief], size[brief]
            order = np.lexsort((key["s"], key["h"], key["l"]))
            differs = np.ones(len(brief), bool)
            differs[1:] = key[order][1:] != key[order][:-1]
            back = np.empty(len(brief), np.int64)
            back[order] = np.cumsum(differs) - 1
            first = brief[order[differs]]
            where, many = self._new([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
            own = slot[first]
            # of cuts that share a slot the last one stays, in all columns alike
            own, last = np.unique(own[::-1], return_index=True)
            last = len(first) - 1 - last
            self.low[own], self.high[own], self.size[own], self.at[own], self.n[own] = low[first][last], high[first][last], size[first][last], where[last], many[last]
            at[brief], n[brief] = where[back], many[back]
        rest = new[size[new] > 16]
        if len(rest):
            cuts = [raw[s:e] for s, e in zip(starts[rest].tolist(), ends[rest].tolist())]
            unknown = [c for c in dict.fromkeys(cuts) if c not in self.long]
            here = dict(zip(unknown, zip(*(x.tolist() for x in self._new(unknown))))) if unknown else {}
            found = [here.get(c) or self.long[c] for c in cuts]
            at[rest], n[rest] = np.array(found, np.int64).T
            self.long |= {c: x for c, x in here.items() if len(c) <= 64} if len(self.long) < _LONG else {}
        total = np.cumsum(n)
        ids = self.pool[np.repeat(at - (total - n), n) + np.arange(total[-1])].astype(np.uint32)
        doc = np.searchsorted(offs, starts, "right") - 1
        return ids, np.bincount(doc, n, len(offs) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """For each run of whole texts: number of the first, ids, ids in each."""
        for a, _, part, o in chunks(data, offs, _TEXT):
            yield a, *self._chunk(part, o)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with an end id after each text, and the offsets of the texts."""
    offs = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(offs[-1], end, np.uint32)
    inner = np.ones(offs[-1], bool)
    inner[offs[1:] - 1] = False
    out[inner] = ids
    return out, offs


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
