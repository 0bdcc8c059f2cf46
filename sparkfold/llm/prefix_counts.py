"""Token counts by prefix dynamic programming over a byte-pair vocabulary with byte fallback.

A sequence of pieces is what byte-pair encoding gives for its string exactly if each two neighbours are what it gives
for theirs. So every prefix of a string has one last piece: the one whose left neighbour, the last piece of the prefix
before it, goes with it. The number of tokens of every prefix follows in one pass, and with it the exact count of any
truncation and the longest prefix within a budget, without encoding again.

Pieces cross no line feed, and none holds a space mark after another character, so a text is the concatenation of
units: a run of spaces with what follows up to the next space or line feed. Counts of units are remembered per worker
(by a 64-bit hash of their bytes); a document's count is their sum.

Null and empty texts have no tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfold.llm import common

MARK = "▁"
_UNITS = re.compile(f"\n|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")


class PrefixCounter:
    """most: units and pairs remembered before they are forgotten."""

    def __init__(self, path: str, most: int = 1_000_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        usable = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in usable}
        self.longest = max(map(len, self.score))
        self.pieces = {p for p in self.score if len(self._merge(p)) == 1}  # those that encoding can give
        self.most, self.pairs, self.units = most, {}, {}

    def _merge(self, s: str) -> list[str]:
        """Byte-pair encoding of a short string: the best-scored neighbours join first, leftmost on ties."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def go_together(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            got = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return got

    def prefixes(self, unit: str) -> list[int]:
        """Exact token counts of unit[:0], unit[:1], ..., the whole unit, spaces written as marks."""
        pieces, longest, pairs = self.pieces, self.longest, self.pairs
        last: list[str] = [""]
        count = [0]
        for end in range(1, len(unit) + 1):
            for begin in range(max(0, end - longest), end):
                p = unit[begin:end]
                if p in pieces or begin == end - 1:
                    before = last[begin]
                    if not before or (pairs[before, p] if (before, p) in pairs else self.go_together(before, p)):
                        last.append(p)
                        count.append(count[begin] + (1 if p in pieces else len(p.encode())))
                        break
        return count

    def unit(self, text: str) -> int:
        return self.prefixes(text.replace(" ", MARK))[-1]

    def text_prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:k] for every k from 0 to its length."""
        out, total = [0], 0
        for m in _UNITS.finditer(" " + text if text else ""):
            got = self.prefixes(m[0].replace(" ", MARK))
            out += [total + c for c in got[1:]]
            total += got[-1]
        out = out[1:] if text else out  # the first character is the space that the library puts before a text
        out[0] = 0
        return np.array(out)

    def within(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        ok = np.flatnonzero(self.text_prefixes(text) <= budget)
        return text[: int(ok[-1])]

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text; data, offs as bytes_of() gives them."""
        n = len(offs) - 1
        out = np.zeros(n, np.int64)
        starts, ends, row, h, spaces, lines, odd = _units(data, offs)
        out += lines
        if len(h):
            u, first, back = np.unique(h * common._M1 + spaces.astype(np.uint64), return_index=True, return_inverse=True)
            if len(self.units) > self.most:
                self.units.clear()
            keys = u.tolist()
            got = list(map(self.units.get, keys))
            if None in got:
                raw = data.tobytes()
                for j, c in enumerate(got):
                    if c is None:
                        k = first[j]
                        got[j] = self.units[keys[j]] = self.unit(" " * int(spaces[k]) + raw[starts[k] : ends[k]].decode())
            out += np.bincount(row, weights=np.array(got, np.int64)[back], minlength=n).astype(np.int64)
        for k in np.flatnonzero(odd):
            t = data[offs[k] : offs[k + 1]].tobytes().decode()
            out[k] = sum(self.unit(u) for u in _UNITS.findall(" " + t))
        return out


def _units(data: np.ndarray, offs: np.ndarray):
    """Units whose spaces are none or one: start, end, row, hash, spaces; per row the line feeds, and whether it is odd:
    it has other gaps, and is to be taken whole."""
    n = len(offs) - 1
    starts, ends, row, h = common.words_of(data, offs, space=_GAP)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    lines = feeds[offs[1:]] - feeds[offs[:-1]]
    odd = (offs[1:] > offs[:-1]) & (np.bincount(row, minlength=n) == 0)
    marks = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)  # a mark in a text is as good as a space
    marks = marks[(data[marks + 1] == 0x96) & (data[marks + 2] == 0x81)]
    odd[np.searchsorted(offs, marks, "right") - 1] = True
    if len(h):
        head = np.concatenate([[True], row[1:] != row[:-1]])
        tail = np.concatenate([row[1:] != row[:-1], [True]])
        gap = starts - np.where(head, offs[row], np.concatenate([[0], ends[:-1]]))
        feed = feeds[starts] - feeds[starts - gap]
        spaces = np.where(head, 1, 1 - feed)
        odd[row[head & (gap > 0) | ~head & (gap != 1)]] = True
        rest = offs[row + 1] - ends
        odd[row[tail & ((rest > 1) | (rest == 1) & (feeds[offs[row + 1]] == feeds[ends]))]] = True
        keep = ~odd[row]
        starts, ends, row, h, spaces = (x[keep] for x in (starts, ends, row, h, spaces))
    else:
        spaces = np.zeros(0, np.int64)
    lines[odd] = 0
    return starts, ends, row, h, spaces, lines, odd


_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True

_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in common.slices(batches):
            data, offs = common.bytes_of(b.column(1))
            n = c.counts(data, offs)
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(np.diff(offs)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))
