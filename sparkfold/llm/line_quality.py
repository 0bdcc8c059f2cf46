"""Quality rules: base rules on words, and a linear-chain conditional random field over lines.

The field labels every line that has a word as content or boilerplate from a few binary features; Viterbi decoding
gives the best labelling, all documents of a batch advancing one line at a time together. The share of a document's
words that lie in content lines decides whether it is kept (`least`, one half), unless a base rule has rejected it.

The field is fitted by gradient ascent (forward-backward in numpy) on a bounded sample of labelled documents (`most`
per class); every line of a document takes the document's quality label. Weights are a few dozen numbers.

Null and empty texts have no words, so a base rule rejects them. Repeated rows are judged each; of rows that share an id, training takes the least
text, and the greater label. Of two equally good labels content wins. A text of one very long line, or of very many lines, is decoded whole. An empty
table gives no rows, other columns play no part. Without labels of both kinds, the field says content everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Features of a line, in the order of the weights.
FEATURES = ("always", "one or two words", "three to five words", "twenty words or more", "a symbol in ten words", "a symbol in two words", "mostly capitals", "an exclamation mark in two words", "words like the one before", "bars", "equal to an earlier line", "ends a sentence", "many digits", "mostly repeated passages", "very long words")


@dataclass
class Field:
    emit: np.ndarray  # log-odds of content by feature
    step: np.ndarray  # from label, to label; 0 is boilerplate
    start: np.ndarray


@dataclass
class Lines:
    """Counts by document, and the lines that have a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray  # of each line
    words: np.ndarray  # of each line
    features: np.ndarray  # lines x features


def describe(data: np.ndarray, offs: np.ndarray, window: int = 8) -> Lines:
    n = len(offs) - 1
    starts, ends, row, h = common.words_of(data, offs)
    symbol = np.flatnonzero(_SYMBOL[data])
    row_of = lambda p: np.searchsorted(offs, p, "right") - 1
    lead = ((data & 0xC0) != 0x80) & ~common._SPACE[data]
    chars = np.concatenate([[0], np.cumsum(lead)])
    # lines: from each text's begin, and after each line feed
    feeds = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), row_of(feeds)]), kind="stable")
    stops = np.minimum(np.append(begins[1:], len(data)), offs[line_doc + 1])
    stops = np.where((stops > begins) & (stops > 0) & (data[np.maximum(stops - 1, 0)] == 10 if len(data) else False) & (np.append(line_doc[1:], -1) == line_doc), stops - 1, stops)
    n_lines = len(begins)
    word_line = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(word_line, minlength=n_lines)
    up, down = common._powers(len(data) + 2)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(common._LUT[data] * up[: len(data)], out=sums[1:], dtype=_U)
    line_hash = common.mix((sums[stops] - sums[begins]) * down[begins] + (stops - begins).astype(_U) * common._M2)
    own = common.mix(line_hash ^ common.mix(line_doc.astype(_U)))
    _, first, back = np.unique(own, return_index=True, return_inverse=True)  # first: stable, so the earliest
    again = first[back] != np.arange(n_lines)
    with_word = words > 0
    # windows of words found twice
    repeated = np.zeros(len(h), bool)
    if len(h) >= window:
        w = np.zeros(len(h) - window + 1, _U)
        for k in range(window):
            w = w * common._BASE + h[k : len(h) - window + 1 + k]
        inside = np.flatnonzero(row[: len(w)] == row[window - 1 :])
        key = common.mix(w[inside] ^ common.mix(row[inside].astype(_U)))
        _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
        at = inside[times[inv] > 1]
        repeated = common.covered(len(h), at, at + window)
    line_sum = lambda places: np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=n_lines)
    size = np.maximum(1, words)
    symbols = line_sum(symbol)
    upper = line_sum(np.flatnonzero((data >= 65) & (data <= 90)))
    lower = line_sum(np.flatnonzero((data >= 97) & (data <= 122)))
    bang, bars = line_sum(np.flatnonzero(data == 0x21)), line_sum(np.flatnonzero(data == 0x7C))
    digits = line_sum(np.flatnonzero((data >= 48) & (data <= 57)))
    like = np.zeros(len(h), bool)
    if len(h):
        like[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    like = np.bincount(word_line[like], minlength=n_lines)
    rep = np.bincount(word_line[repeated], minlength=n_lines)
    length = stops - begins
    final = data[np.maximum(stops - 1, 0)] if len(data) else np.zeros(n_lines, np.uint8)
    f = np.stack([
        np.ones(n_lines, bool), words <= 2, (words >= 3) & (words <= 5), words >= 20, symbols * 10 >= size, symbols * 2 >= size, upper > lower, bang * 2 >= size,
        like * 10 >= 3 * size, bars * 4 >= size, again, (final == 0x2E) & (length > 0), digits * 3 >= np.maximum(1, length), rep * 2 >= size, length >= 20 * size,
    ], 1)
    return Lines(
        np.bincount(row, minlength=n).astype(np.int64), chars[offs[1:]] - chars[offs[:-1]], common.counts_of(row_of(symbol), n),
        common.counts_of(line_doc[again & with_word], n), common.counts_of(row[repeated], n), line_doc[with_word], words[with_word], f[with_word],
    )


def _grid(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines, their first lines and numbers of lines."""
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    return order, first[order], count[order]


def viterbi(field: Field, doc: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """The best label (1 is content) of each line."""
    odds = features @ field.emit
    out = np.zeros(len(doc), np.int64)
    order, first, count = _grid(doc, n)
    active = np.searchsorted(-count, -np.arange(1, int(count.max(initial=0)) + 1), "right")
    if not len(active):
        return out
    best = np.zeros((2, active[0]))
    best[0] = field.start[0]
    best[1] = field.start[1] + odds[first[: active[0]]]
    backs = []
    for t in range(1, len(active)):
        a = active[t]
        from_0, from_1 = best[0, :a], best[1, :a]
        to_0 = np.stack([from_0 + field.step[0, 0], from_1 + field.step[1, 0]])
        to_1 = np.stack([from_0 + field.step[0, 1], from_1 + field.step[1, 1]])
        backs.append((to_0[1] > to_0[0], to_1[1] >= to_1[0]))
        best[0, :a] = to_0.max(0)
        best[1, :a] = to_1.max(0) + odds[first[:a] + t]
    label = (best[1] >= best[0]).astype(np.int64)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        out[first[:a] + t] = label[:a]
        if t:
            b0, b1 = backs[t - 1]
            label[:a] = np.where(label[:a] == 1, b1, b0)
    return out


def fit(doc: np.ndarray, features: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, rounds: int = 120, rate: float = 0.1) -> Field:
    """Maximum conditional likelihood (with a small penalty on weights), by Adam on full gradients."""
    x = features.astype(np.float64)
    theta = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    order, first, count = _grid(doc, n)
    active = np.searchsorted(-count, -np.arange(1, int(count.max(initial=0)) + 1), "right")
    w_line = weight[doc]
    heads = first[: active[0]]
    nexts = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    pair = label[nexts] * 2 + label[nexts + 1]
    seen_step = np.bincount(pair, weights=w_line[nexts], minlength=4)
    seen_start = np.bincount(label[heads], weights=w_line[heads], minlength=2)
    seen_emit = x.T @ (w_line * label)
    total = w_line.sum()
    for it in range(1, rounds + 1):
        emit, step, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.stack([np.zeros(len(x)), x @ emit], 1)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[heads] = start + e[heads]
        for t in range(1, len(active)):
            i = first[: active[t]] + t
            fwd[i] = np.logaddexp(fwd[i - 1][:, :1] + step[0], fwd[i - 1][:, 1:] + step[1]) + e[i]
        for t in range(len(active) - 1, 0, -1):
            i = first[: active[t]] + t
            z = bwd[i] + e[i]
            bwd[i - 1] = np.logaddexp(step[:, 0] + z[:, :1], step[:, 1] + z[:, 1:])
        post = fwd + bwd
        norm = np.logaddexp(post[:, 0], post[:, 1])
        p = np.exp(post - norm[:, None])
        joint = np.exp(fwd[nexts][:, :, None] + step + (e[nexts + 1] + bwd[nexts + 1])[:, None, :] - norm[nexts][:, None, None])
        g = np.concatenate([seen_emit - x.T @ (w_line * p[:, 1]), seen_step - (joint * w_line[nexts][:, None, None]).sum(0).ravel(), seen_start - (p[heads] * w_line[heads][:, None]).sum(0)]) / total - 1e-4 * theta
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Field(theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame, most: int = 1500, text: str = "text") -> Field:
    """Fit the field on at most `most` labelled documents of each quality, by the order of a hash of doc_id, and at most common.SAMPLE_BYTES of text."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = {}
    for y in (0, 1):
        for r in own.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            ids[r.doc_id] = y
    flat = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    if len(set(ids.values())) < 2:
        return flat
    rows = common.sample_texts(docs, list(ids), text=text)
    if not rows:
        return flat
    y = np.array([ids[r.doc_id] for r in rows], np.int64)
    doc, features, before = [], [], 0
    for part in common.slices(iter([pa.record_batch({"text": pa.array([r.text for r in rows], pa.large_string())})])):
        seen = describe(*common.bytes_of(part.column(0)))
        doc.append(seen.doc + before)
        features.append(seen.features)
        before += part.num_rows
    doc, features = np.concatenate(doc), np.concatenate(features)
    lines = np.bincount(doc, minlength=len(rows))
    if not len(doc):
        return flat
    field = fit(doc, features, y[doc], 1 / np.maximum(1, lines), len(rows))
    common.release()
    return field


def judge(docs: DataFrame, field: Field, least: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, content_words and kept of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = describe(*common.bytes_of(b.column(1)))
            label = viterbi(field, x.doc, x.features, b.num_rows)
            content = np.bincount(x.doc, weights=x.words * label, minlength=b.num_rows).astype(np.int64)
            failed = (x.n_words < 20) | (100 * x.n_repeat_words > 30 * x.n_words)
            yield pa.record_batch({
                "doc_id": b.column(0), "n_words": pa.array(x.n_words), "word_chars": pa.array(x.word_chars), "n_symbols": pa.array(x.n_symbols), "n_dup_lines": pa.array(x.n_dup_lines),
                "n_repeat_words": pa.array(x.n_repeat_words), "base_failed": pa.array(failed), "content_words": pa.array(content), "kept": pa.array(~failed & (content >= least * x.n_words)),
            })

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, kept boolean"
    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}")


def content_only(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that judge() keeps, all columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = describe(*common.bytes_of(b.column(b.schema.get_field_index("text"))))
            label = viterbi(field, x.doc, x.features, b.num_rows)
            content = np.bincount(x.doc, weights=x.words * label, minlength=b.num_rows)
            yield b.filter(pa.array((x.n_words >= 20) & (100 * x.n_repeat_words <= 30 * x.n_words) & (content >= least * x.n_words)))

    return docs.mapInArrow(run, docs.schema)


def op3_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels")))
