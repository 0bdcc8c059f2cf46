"""Substring dedup by suffix automata of reference shards.

Passages: runs of windows (50 words) that share an anchor which other documents have too. They are the only places where
a window can repeat. Equal passages become one row with the least document id (grouped with partial sums, so copies never
meet), and passages are dealt to shards by anchor, about SHARD_WORDS words each: equal windows have equal anchors, so a
shard needs no other. A shard's automaton is built once over its distinct passages, every state knowing the least document
it occurs in, and passages stream through it for matching statistics: at each word, the state of the longest match,
cut to the window's length, says whether the last `window` words start in an earlier document. Runs of such windows
are the removed spans.

The automaton of a shard stays in the task that gets the shard's passages, which is all that need it: sent to every task by
the driver, automata would grow with the corpus.

Words are compared by 64-bit hashes. Null and empty texts have no words; nothing is removed from rows without doc_id,
nor because of them; rows that share a doc_id do not remove each other's words. Copies of a whole text (of at least
one window) lose all words but in the row with the least doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common
from sparkfold.llm.passages import corpus, repeated, sliding_min

#: Words of an anchor's gram; passage words that a shard is meant to hold.
GRAM, SHARD_WORDS = 16, 60_000
_U = np.uint64


class Automaton:
    """Suffix automaton over several word sequences, each with a document number; states keep the least of their documents."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:  # the path is there already, from an earlier sequence
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.least.append(1 << 62)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.least.append(self.least[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def add(self, words: list[int], document: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            if document < self.least[last]:
                self.least[last] = document

    def finish(self) -> None:
        """Every state also occurs where its longer extensions do."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def earlier(self, words: list[int], document: int, window: int) -> list[int]:
        """Starts of the windows of `words` that occur in a document before `document`."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = size = 0
        out = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            while length[link[state]] >= window:  # only the last `window` words count
                state = link[state]
                size = length[state]
            if size >= window and least[state] < document:
                out.append(i - window + 1)
        return out


def _window_keys(w: np.ndarray, window: int) -> np.ndarray:
    """The anchor hash of each window of one document's words."""
    if len(w) < window:
        return w[:0]
    g = np.zeros(len(w) - GRAM + 1, _U)
    for k in range(GRAM):
        g = (g ^ w[k : k + len(g)]) * common._M1 + common._BASE
    return sliding_min(common.mix(g), window - GRAM + 1)


def _keys(window: int):
    def keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, row, w = common.words_of(data, offs)
        at = np.searchsorted(row, np.arange(len(offs)))
        out = [np.unique(_window_keys(w[at[r] : at[r + 1]], window)) for r in range(len(offs) - 1)]
        return (np.concatenate(out) if out else np.zeros(0, _U)), np.array([len(x) for x in out], np.int64)

    return keys


def _passages(texts: DataFrame, window: int) -> DataFrame:
    """key, doc_id, h1, start (first window's word), words (64-bit hashes) and cid (a hash of these) of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            _, _, row, w = common.words_of(*common.bytes_of(b.column(2)))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            rows: list[list] = [[], [], [], [], [], []]
            for r, (d, h1) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own = w[at[r] : at[r + 1]]
                m = _window_keys(own, window)
                wanted = np.array(b.column(3)[r].as_py(), np.int64).view(_U)
                hit = np.isin(m, wanted)
                edge = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1])]))
                for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(m)]):
                    if hit[lo]:
                        part = own[lo : hi + window - 1]
                        raw = part.tobytes()
                        for k, v in enumerate((int(m[lo].view(np.int64)), d, h1, lo, raw, int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))):
                            rows[k].append(v)
            kinds = (pa.int64(), b.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds)], names=["key", "doc_id", "h1", "start", "words", "cid"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "h1", "text", "keys").mapInArrow(run, f"key long, doc_id {kind}, h1 long, start long, words binary, cid long")


def _matched(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """key, cid, and `lo`, `hi`: runs of its windows, by their first words' places, that start in an earlier document than `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            a = Automaton()
            for _, _, first, words in held:
                a.add(words, first)
            a.finish()
            rows: list[list] = [[], [], [], []]
            for key, cid, first, words in held:
                starts = a.earlier(words, first, window)
                lo = 0
                while lo < len(starts):
                    hi = lo
                    while hi + 1 < len(starts) and starts[hi + 1] == starts[hi] + 1:
                        hi += 1
                    for k, v in enumerate((key, cid, starts[lo], starts[hi] + 1)):
                        rows[k].append(v)
                    lo = hi + 1
            return pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=["key", "cid", "lo", "hi"])

        held: list[tuple[int, int, int, list[int]]] = []
        shard = None
        for b in batches:
            for s, key, cid, first, words in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard and held:
                    yield flush()
                    held.clear()
                shard = s
                held.append((key, cid, first, np.frombuffer(words, np.int64).tolist()))
        if held:
            yield flush()

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "first").select("shard", "key", "cid", "first", "words").mapInArrow(run, "key long, cid long, lo long, hi long")


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text-digest (kept_sha256) of every row; spans(docs) gives the removed spans themselves."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    c = corpus(docs, {"n_words": F.size(words).cast("long"), "whole": F.sha2(F.array_join(words, " "), 256)}, text)
    hit = common.stored(repeated(c, _keys(window)))
    found = common.stored(_passages(hit, window))
    distinct = found.groupBy("key", "cid").agg(F.min("doc_id").alias("first"), F.first("words").alias("words"))
    total = found.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    matched = _matched(distinct, max(1, total // 8 // SHARD_WORDS), window)
    # In the first document of a passage, the matched runs go; in later ones, the whole passage.
    firsts = found.groupBy("key", "cid").agg(F.min("doc_id").alias("first"))
    placed = found.select("key", "cid", "doc_id", "h1", "start", F.expr("octet_length(words) div 8").alias("n")).join(firsts, ["key", "cid"])
    later = placed.where("doc_id > first").select("doc_id", "h1", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    some = placed.where("doc_id = first").join(matched, ["key", "cid"]).select("doc_id", "h1", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + (window - 1)).alias("hi"))
    spans = later.unionByName(some).groupBy("doc_id", "h1").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            gone_n, sums = [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = t.encode().translate(_BLANK).split(b" ")
                own = [x for x in own if x]
                gone = common.covered(len(own), np.array([x["lo"] for x in s]), np.array([x["hi"] for x in s]))
                gone_n.append(int(gone.sum()))
                sums.append(hashlib.sha256(b" ".join([x for x, g in zip(own, gone.tolist()) if not g])).hexdigest())
            yield pa.record_batch({"doc_id": b.column(0), "h1": b.column(1), "gone": pa.array(gone_n, pa.int64()), "sha": pa.array(sums, pa.string())})

    kind = dict(c.texts.dtypes)["doc_id"]
    changed = common.stored(hit.select("doc_id", "h1", "text").join(spans, ["doc_id", "h1"]).select("doc_id", "h1", "text", "spans").mapInArrow(cut, f"doc_id {kind}, h1 long, gone long, sha string"))
    common.discard(hit)
    common.discard(found)
    c.drop()
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
    out = c.rows.join(changed, ["doc_id", "h1"], "left")
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


_BLANK = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS d FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT k.doc_id, k.i FROM k JOIN f ON f.h = k.h WHERE f.d < k.doc_id)),
a AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) > 0),
r AS (SELECT a.doc_id, string_agg(CASE WHEN g.p IS NULL THEN a.x END, ' ' ORDER BY a.p) AS kept, count(g.p) AS gone FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
