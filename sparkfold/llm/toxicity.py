"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters and digits, lower-cased; its vector is the mean of the vectors of its whole form and of its
character n-grams, so an unseen misspelling shares most of the vectors of the word it comes from. A document's vector
is the mean over its words, and a softmax over two classes gives the score. Vectors and softmax are fitted together by
Adam on cross-entropy over a bounded sample of labelled rows (`most` per class and common.SAMPLE_BYTES of text in all, whole texts,
weighted back to their shares).

Scoring needs one number per vector, its product with the softmax weights, so what is sent to the tasks is `buckets`
floats whatever the corpus. Every whole text is scored; an empty or null one gets the score of a zero vector.
Documents without a label are scored alike; rows whose doc_id is null count as not held out. Repeated rows are scored each; of rows that share
an id, training takes the least text, and the greater label. An empty table gives no rows; only doc_id and text are read, whatever other columns
there are. A sample of one class, or of none, gives all documents one score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common

#: Everything that ends a word here: all ASCII but letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_GRAMS = (3, 4, 5)

#: Words of zero vector that each average takes besides: a document of three words is no verdict on a rare word.
NEUTRAL = 15


@dataclass
class Model:
    bucket: np.ndarray  # each vector's share of the logit
    bias: float
    scale: float


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the vectors of each word, number of them): the whole word, then its n-grams with ends marked."""
    lens = ends - starts
    size = lens + 2
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), 1, np.uint8)  # byte 1 marks both ends
    text[common.ranges(at + 1, lens)] = common._LOWER[data[common.ranges(starts, lens)]]
    up, down = common._powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(common._LUT[text] * up[: len(text)], out=sums[1:], dtype=np.uint64)
    owner, found = [np.arange(len(starts))], [whole]
    for n in _GRAMS:
        k = np.maximum(size - n + 1, 0)
        p = common.ranges(at, k)
        owner.append(np.repeat(np.arange(len(starts)), k))
        found.append(common.mix((sums[p + n] - sums[p]) * down[p] + np.uint64(n)))
    owner_all, found_all = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner_all, kind="stable")
    return (found_all[order] % np.uint64(buckets)).astype(np.int32), np.bincount(owner_all, minlength=len(starts))


class _Bags:
    """Texts as counts of distinct words, words as lists of vectors."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, buckets: int):
        starts, ends, row, h = common.words_of(data, offs, lower=True, space=_BREAK)
        self.n = len(offs) - 1
        u, first, word = np.unique(h, return_index=True, return_inverse=True)
        self.word, self.row = word.astype(np.int32), row.astype(np.int32)  # half the room: all batches of a sample are held at once
        self.length = np.bincount(row, minlength=self.n) + NEUTRAL
        self.gram, self.grams = _grams(data, starts[first], ends[first], u, buckets) if len(u) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.gram_at = np.cumsum(self.grams) - self.grams


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, buckets: int = 1 << 17, size: int = 8, epochs: int = 4, least_steps: int = 400, least_docs: int = 3, least_sure: float = 3.0, start: float = 1.0, batch: int = 32, rate: float = 0.01, decay: float = 0.3, seed: int = 7) -> Model:
    """Fit vectors and softmax together. The texts are a bounded sample (see sample())."""
    rng = np.random.default_rng(seed)
    scale = 30.0
    e = rng.normal(0, 0.003, (buckets, size)).astype(np.float32)  # nearly nothing: a vector that no training row has says nothing
    w = rng.normal(0, 0.3, (size, 2)).astype(np.float32)
    base = np.log((weights * labels).sum() + 1) - np.log((weights * (1 - labels)).sum() + 1)
    b = np.array([0, base], np.float32)
    me, ve = np.zeros_like(e), np.zeros_like(e)
    small = [np.zeros_like(x) for x in (w, w, b, b)]
    weights = weights / weights.mean()
    bags = []
    order = rng.permutation(len(texts))
    for lo in range(0, len(texts), batch):
        own = order[lo : lo + batch]
        col = pa.array([texts[k] for k in own], pa.large_string())
        bags.append((_Bags(*common.bytes_of(col), buckets), labels[own], weights[own]))
    seen = np.zeros((2, buckets))  # documents of each class that hold each vector
    for x, y, _ in bags:
        pair = np.unique(x.row.astype(np.int64) * max(1, len(x.grams)) + x.word)
        r, word = pair // max(1, len(x.grams)), pair % max(1, len(x.grams))
        n = x.grams[word]
        own = np.unique(np.repeat(r, n) * buckets + x.gram[common.ranges(x.gram_at[word], n)])
        for c in (0, 1):
            seen[c] += np.bincount(own[y[own // buckets] == c] % buckets, minlength=buckets)
    # Vectors that tell the classes apart by more than chance are fitted; the rest, and rare ones, could only memorise
    # documents, and stay zero. The first component starts from the log-odds of the classes' document counts.
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    sure = np.abs(odds) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    known = ((seen.sum(0) >= least_docs) & (sure >= least_sure)).astype(np.float32)[:, None]
    e *= known
    e[:, 0] += known[:, 0] * start * odds
    w[0] = -0.5, 0.5
    epochs = max(epochs, -(-least_steps // max(1, len(bags))))  # a small sample is gone through more often
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(bags)):
            x, y, wt = bags[k]
            if not len(x.gram):
                continue
            step += 1
            key = x.row.astype(np.int64) * len(x.grams) + x.word
            pair, n = np.unique(key, return_counts=True)
            r, word = pair // len(x.grams), pair % len(x.grams)
            share = (n / x.length[r]).astype(np.float32)[:, None] * scale
            rows, inv = np.unique(x.gram, return_inverse=True)
            vec = np.add.reduceat(e[x.gram], x.gram_at, 0) / x.grams[:, None].astype(np.float32)
            doc = np.zeros((x.n, size), np.float32)
            at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            doc[r[at]] = np.add.reduceat(vec[word] * share, at, 0)
            z = doc @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(x.n), y] -= 1
            g *= (wt / x.n)[:, None]
            g = g.astype(np.float32)
            gw, gb, gd = doc.T @ g, g.sum(0), g @ w.T
            by_word = np.argsort(word, kind="stable")
            gv = np.zeros_like(vec)
            ws = word[by_word]
            at = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
            gv[ws[at]] = np.add.reduceat((gd[r] * share)[by_word], at, 0)
            gv /= x.grams[:, None]
            each = np.repeat(gv, x.grams, 0)
            ge = np.stack([np.bincount(inv, weights=each[:, j], minlength=len(rows)) for j in range(size)], 1).astype(np.float32)
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * epoch / epochs)
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            me[rows] = 0.9 * me[rows] + 0.1 * ge  # Adam, lazily: only vectors of this batch move
            ve[rows] = 0.999 * ve[rows] + 0.001 * ge * ge
            e[rows] *= 1 - lr * decay
            e[rows] -= lr * known[rows] * (me[rows] / c1) / (np.sqrt(ve[rows] / c2) + 1e-8)
            for v, gr, m1, m2 in ((w, gw, small[0], small[1]), (b, gb, small[2], small[3])):
                m1[:] = 0.9 * m1 + 0.1 * gr
                m2[:] = 0.999 * m2 + 0.001 * gr * gr
                v -= lr * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]), scale)


def score(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    bags = _Bags(data, offs, len(model.bucket))
    z = np.full(bags.n, model.bias)
    if len(bags.gram):
        word = np.add.reduceat(model.bucket[bags.gram].astype(np.float64), bags.gram_at) / bags.grams
        z += model.scale * np.bincount(bags.row, weights=word[bags.word], minlength=bags.n) / bags.length
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int, text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most `most` training rows of each class, by the order of a hash of doc_id, and of at most common.SAMPLE_BYTES."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = {}
    for y in (0, 1):
        for r in own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            ids[r.doc_id] = y
    if not ids:
        return [], np.zeros(0, np.int64), np.zeros(0)
    rows = common.sample_texts(docs, list(ids), text=text)
    y = np.array([ids[r.doc_id] for r in rows], np.int64)
    weight = np.array([shares[k] / max(1, (y == k).sum()) for k in y.tolist()], np.float64)
    return [r.text for r in rows], y, weight


def train(docs: DataFrame, labels: DataFrame, most: int = 2500, text: str = "text") -> Model:
    texts, y, weight = sample(docs, labels, most, text)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: every score is the share of the one class, or one half
        return Model(np.zeros(1 << 10, np.float32), 0.0 if not len(y) else float(np.where(y[0], 5, -5)), 1.0)
    model = fit(texts, y, weight)
    common.release()
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            s = score(model, *common.bytes_of(b.column(1)))
            held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in b.column(0).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "held_out": pa.array(held, pa.bool_()), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def civil_only(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield b.filter(pa.array(score(model, *common.bytes_of(b.column(b.schema.get_field_index("text")))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, common.table(spark, sf_dir, "labels")))
