"""SentencePiece encoding and decoding.

The ids that the library gives for a byte-pair vocabulary (Merges), or, reading the model as a unigram one, the segmentation of a
text with the greatest sum of piece scores, by batched numpy Viterbi (Pieces). Pieces cross no space mark that follows another
character, so units (marks with what follows up to the next) are segmented apart and remembered per worker. Units of
equal length advance together: at each end position, the hashes of all substrings that end there are looked up in the
sorted hashes of the pieces, and a vectorised maximum over the begin positions stores the score and the backpointer.
A character that no piece covers costs ten below the worst score and is written as its bytes; on equal scores the longer
last piece wins. Scores are summed in doubles, which is exact for this vocabulary's whole-number scores.

Decoding joins pieces and bytes, turns marks into spaces and drops the one put before the text. It gives back every
text that has no mark of its own; a byte sequence that is no UTF-8 becomes replacement characters.

The vocabulary's own merge order is another rule than the sum of scores. Under it a path through the pieces is admitted only where
neighbours go together (prefix_counts.py), which leaves one. The library gives the ids of the sum of scores when told that the
model is a unigram one, apart from the rounding of its single floats.

Null and empty texts have no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfold.llm import common, prefix_counts

MARK = 0x2581
#: Units longer than this advance alone, in the same way.
_U = np.uint64


class Pieces:
    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.raw = [bytes([int(t[1:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else t.replace("▁", " ").encode() for i, t in enumerate(self.text)]
        self.longest = max(len(self.text[i]) for i in normal)
        key = np.array([self._key(self.text[i]) for i in normal], _U)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array(normal, np.int64)[order]
        self.scores = np.array([lib.get_score(int(i)) for i in self.ids], np.float64)
        self.missing = self.scores.min() - 10
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.units: dict[int, int] = {}
        self.flat, self.start, self.size = array("I"), array("q"), array("i")

    def _key(self, s: str) -> int:
        c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(_U)
        return int(self._hashes(c[None, :], 0, len(c))[0])

    @staticmethod
    def _hashes(codes: np.ndarray, begin: int, end: int) -> np.ndarray:
        h = np.full(len(codes), common._BASE, _U)
        for k in range(begin, end):
            h = (h ^ codes[:, k]) * common._M1
            h ^= h >> _U(29)
        return h

    def segment(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of an array of code points, all of one length."""
        n, length = codes.shape
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int64)
        # prefix[b]: running hash of the substrings that begin at b, for those that can still be pieces
        run: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            run[end - 1] = np.full(n, common._BASE, _U)
            run.pop(end - 1 - self.longest, None)
            c = codes[:, end - 1]
            for begin in range(max(0, end - self.longest), end):
                h = (run[begin] ^ c) * common._M1
                h ^= h >> _U(29)
                run[begin] = h
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[k] == h
                score = np.where(hit, best[begin] + self.scores[k], best[begin] + self.missing if begin == end - 1 else -np.inf)
                better = score > best[end]
                best[end] = np.where(better, score, best[end])
                back[end] = np.where(better, begin, back[end])
                piece[end] = np.where(better, np.where(hit, self.ids[k], -1), piece[end])
        out = []
        ends, backs = piece.T.tolist(), back.T.tolist()
        for j in range(n):
            ids: list[int] = []
            at = length
            while at:
                p = ends[j][at]
                if p >= 0:
                    ids.append(p)
                else:
                    ids += self.byte[np.frombuffer(chr(int(codes[j, at - 1])).encode(), np.uint8)][::-1].tolist()
                at = backs[j][at]
            out.append(ids[::-1])
        return out

    def learn(self, units: list[str]) -> list[int]:
        """Segment new units, those of equal length together; their numbers."""
        by: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by.setdefault(len(u), []).append(k)
        got: list[list[int]] = [[]] * len(units)
        for length, own in by.items():
            for lo in range(0, len(own), 8192):
                part = own[lo : lo + 8192]
                codes = np.frombuffer("".join(units[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), length).astype(_U)
                for k, ids in zip(part, self.segment(codes)):
                    got[k] = ids
        first = len(self.size)
        for ids in got:
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)
        return list(range(first, len(self.size)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each); data, offs as bytes_of() gives them."""
        if len(self.units) > self.most:
            self.clear()
        n = len(offs) - 1
        starts, ends, row, before = _spans(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        up, down = common._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(common._LUT[data] * up[: len(data)], out=sums[1:], dtype=_U)
        h = common.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * common._M2 + before.astype(_U))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        keys = u.tolist()
        got = list(map(self.units.get, keys))
        new = [j for j, i in enumerate(got) if i is None]
        if new:
            raw = data.tobytes()
            texts = [("▁" if before[first[j]] else "") + raw[starts[first[j]] : ends[first[j]]].decode().replace(" ", "▁") for j in new]
            for j, i in zip(new, self.learn(texts)):
                got[j] = self.units[keys[j]] = i
        which = np.array(got, np.int64)[back]
        lens = np.array(self.size, np.int64)[which]
        ids = np.array(self.flat, np.uint32)[common.ranges(np.array(self.start, np.int64)[which], lens)]
        return ids, np.bincount(row, weights=lens, minlength=n).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Merges(Pieces):
    """Units are segmented as byte-pair merges do: of the pieces that end at a place, the one that goes with the last piece before it."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__(path, most)
        self.counter = prefix_counts.counter(path)
        self.own = {self.text[i]: i for i in self.ids.tolist()}

    def merged(self, unit: str) -> list[int]:
        c = self.counter
        usable, longest, pairs = c.pieces, c.longest, c.pairs
        last = [""]
        for end in range(1, len(unit) + 1):
            for begin in range(max(0, end - longest), end):
                p = unit[begin:end]
                if p in usable or begin == end - 1:
                    before = last[begin]
                    if not before or (pairs[before, p] if (before, p) in pairs else c.go_together(before, p)):
                        last.append(p)
                        break
        ids: list[int] = []
        at = len(unit)
        while at:
            p = last[at]
            if p in usable:
                ids.append(self.own[p])
            else:
                ids += self.byte[np.frombuffer(p.encode(), np.uint8)][::-1].tolist()
            at -= len(p)
        return ids[::-1]

    def learn(self, units: list[str]) -> list[int]:
        first = len(self.size)
        for u in units:
            ids = self.merged(u)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)
        return list(range(first, len(self.size)))


def _spans(data: np.ndarray, offs: np.ndarray):
    """Units of each text: start, end, row, and whether the mark before a text goes before it. A unit begins at a space that
    follows another byte (but not a mark), at a text's begin, and at a line feed and the byte after one (no piece holds a line feed)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    space, feed = data == 0x20, data == 0x0A
    begins = offs[:-1][offs[:-1] < offs[1:]]
    cut = feed.copy()
    blank = space.copy()  # a mark in a text is as good as a space
    blank[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    cut[1:] |= space[1:] & ~blank[:-1] | feed[:-1]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    before = np.zeros(n, np.int64)
    before[begins] = 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, before[starts]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


_MERGES: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id and ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = merges(model)
        for b in common.slices(batches):
            ids, n = p.encode(*common.bytes_of(b.column(1)))
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))})

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array([p.decode(x or []) for x in b.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip of every whole text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = merges(model)
        for b in common.slices(batches):
            ids, n = p.encode(*common.bytes_of(b.column(1)))
            ends = np.cumsum(n)
            rows = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
            same = [p.decode(r.tolist()) == (t or "").replace("▁", " ") for r, t in zip(rows, b.column(1).to_pylist())]
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()), "round_trip": pa.array(same, pa.bool_())})

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_crc32 long, round_trip boolean")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))
