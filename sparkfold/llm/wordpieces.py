"""Token ids of whole texts with the `tokenizers` library, each distinct chunk encoded once per worker.

The vocabulary drops white space and never joins across it, so a text's ids are those of its white-space-separated
chunks. Chunks of ASCII and Latin-1 letters, digits and plain punctuation are cut into runs of one kind, and each distinct
run goes to the library's BPE model; all others take its whole pipeline. A chunk is known by a 64-bit hash of its bytes, kept in
an open-addressing table of numpy arrays, so all chunks of a slice are looked up at once.
"""

from __future__ import annotations

import os
import re

import numpy as np

from sparkfold.llm.common import ranges, words_of

_LETTERS = "a-zA-Z" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
#: Runs that the vocabulary's own rule would cut alike, and the blank that ends a chunk.
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+| ")

#: ASCII bytes of plain chunks; the apostrophe begins contractions, which the library must see.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0x27] = False


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ..."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of plain characters: ASCII but white space, controls and the apostrophe, and the two bytes of a Latin-1 letter."""
    ok = _PLAIN[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    ok[lead] = ok[lead + 1] = True
    return ok


class Lists:
    """Lists of ids laid end to end, in arrays that double."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.ids = self.count = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        own = slice(self.count, self.count + len(sizes))
        self.flat[self.ids : self.ids + len(ids)] = ids
        self.size[own] = sizes
        self.start[own] = self.ids + np.cumsum(sizes) - sizes
        self.ids, self.count = self.ids + len(ids), self.count + len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists one after another, size of each)."""
        sizes = self.size[which].astype(np.int64)
        return self.flat[ranges(self.start[which], sizes)], sizes


class WordEncoder:
    """encode(data, offs) -> (ids of all texts, number of ids of each). `most` bounds the chunks remembered, `most_runs` the runs,
    which take more room."""

    def __init__(self, path: str, most: int = 500_000, most_runs: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = _byte_letters()
        self.most, self.most_runs = most, most_runs
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bits = (2 * most - 1).bit_length()
        self.forget_runs()
        self.forget_chunks()

    def forget_runs(self) -> None:
        self.known_runs: dict[str, int] = {}
        self.runs = Lists()

    def forget_chunks(self) -> None:
        self.keys = np.zeros((1 << self.bits) + 8, np.uint64)  # 0: a free place; the last 8 end the probes
        self.value = np.zeros(len(self.keys), np.int32)
        self.chunks = Lists()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the chunks with these hashes; -1 for those not known."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for _ in range(8):
            there = self.keys[at]
            same = there == h[open_]
            out[open_[same]] = self.value[at[same]]
            more = ~same & (there != 0)
            open_, at = open_[more], at[more] + 1
            if not len(open_):
                break
        return out

    def remember(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct new hashes into free places; those that find none within 8 probes are learnt again when next seen."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for _ in range(8):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]  # of several that want one place, one stays
            self.value[at[free]] = number[free]
            lost = self.keys[at] != h
            h, number, at = h[lost], number[lost], at[lost] + 1
            if not len(h):
                break

    def _runs_of(self, runs: list[str]) -> np.ndarray:
        got = list(map(self.known_runs.get, runs))
        if None in got:
            fresh = [r for r in dict.fromkeys(runs) if r not in self.known_runs]
            letters, lists = self.alphabet.__getitem__, []
            for r in fresh:
                s = r if r.isascii() else "".join(map(letters, r.encode()))
                lists.append([] if r == " " else [t.id for t in self.model.tokenize(s)])
            first = self.runs.count
            self.runs.add(np.array([i for x in lists for i in x], np.uint32), np.array(list(map(len, lists)), np.int64))
            self.known_runs.update(zip(fresh, range(first, first + len(fresh))))
            got = list(map(self.known_runs.get, runs))
        return np.array(got, np.int64)

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Adds the ids of the chunks, plain ones first. A plain chunk has no blank, so blanks part them."""
        if plain:
            runs = _PARTS.findall(" ".join(plain).lower())
            which = self._runs_of(runs)
            ids, sizes = self.runs.take(which)
            chunk = np.cumsum(which == self.known_runs.get(" ", -1))
            self.chunks.add(ids, np.bincount(chunk, weights=sizes, minlength=len(plain)).astype(np.int64))
        if other:
            lists = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
            self.chunks.add(np.array([i for x in lists for i in x], np.uint32), np.array(list(map(len, lists)), np.int64))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data, offs: UTF-8 bytes of the texts and where each begins, as bytes_of() gives them."""
        if self.chunks.count > self.most:
            self.forget_chunks()
        if self.runs.count > self.most_runs:
            self.forget_runs()
        n = len(offs) - 1
        starts, ends, row, h = words_of(data, offs)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        h[h == 0] = 1
        which = self.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            u, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            lo, hi = starts[new[first]], ends[new[first]]
            odd = np.concatenate([[0], np.cumsum(~plain_bytes(data))])
            plain = odd[hi] == odd[lo]
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist())]
            if b"<|" in raw:
                plain &= ~np.array(["<|" in w and any(s in w for s in self.special) for w in words])
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            number = np.empty(len(u), np.int64)
            number[order] = self.chunks.count + np.arange(len(u))
            cut = int(plain.sum())
            self._learn([words[k] for k in order[:cut].tolist()], [words[k] for k in order[cut:].tolist()])
            self.remember(u, number)
            which[new] = number[back]
        ids, lens = self.chunks.take(which)
        return ids, np.bincount(row, weights=lens, minlength=n).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file; workers are reused, and so is what it has learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
