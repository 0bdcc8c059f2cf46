import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkfold.llm import common, line_quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(t):
    w = WORD.findall(t)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    cov = [False] * len(w)
    for i, x in enumerate(win):
        if c[x] > 1:
            cov[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(cov)


def _labels(spark, rows):
    return spark.createDataFrame([(i, int(k % 3 != 0), int(k % 4 == 0)) for k, (i, t) in enumerate(rows)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_base_counts(spark, docs, rows):
    got = line_quality.judge(docs, line_quality.train(docs, _labels(spark, rows))).collect()
    counts = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert counts == Counter((i, *_base(t or "")) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def _brute(field, features):
    """Best labelling by trying all."""
    best = None
    for code in range(1 << len(features)):
        y = [code >> k & 1 for k in range(len(features))]
        s = field.start[y[0]] + sum(f @ field.emit for f, v in zip(features, y) if v) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, y)
    return best[0]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    field = line_quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [1, 4, 0, 7, 2]
    doc = np.repeat(np.arange(5), sizes)
    x = rng.random((len(doc), 3)) < 0.5
    got = line_quality.viterbi(field, doc, x, 5)
    for d in range(5):
        y, f = got[doc == d], x[doc == d]
        if len(y):
            s = field.start[y[0]] + (f @ field.emit)[y == 1].sum() + sum(field.step[a, b] for a, b in zip(y, y[1:]))
            assert abs(s - _brute(field, f)) < 1e-9


def test_field_tells_boilerplate_from_content():
    good = ["A plain sentence of several words ends here.\n" * 3, "Another one that reads well enough to keep.\n" * 2]
    bad = ["BUY!! NOW!! CHEAP!! ***\n" * 3, "a | b | c | d\ne | f | g | h\n" * 2]
    x = line_quality.describe(*common.bytes_of(pa.array(good + bad, pa.large_string())))
    y = np.array([1, 1, 0, 0])
    field = line_quality.fit(x.doc, x.features, y[x.doc], np.ones(4), 4)
    assert (line_quality.viterbi(field, x.doc, x.features, 4) == y[x.doc]).all()


def test_without_labels_all_lines_are_content(spark, docs):
    field = line_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.kept or r.base_failed for r in line_quality.judge(docs, field).collect())


def test_content_only_keeps_what_judge_keeps(spark, docs, rows, empty):
    field = line_quality.train(docs, _labels(spark, rows))
    kept = Counter(r.doc_id for r in line_quality.judge(docs, field).collect() if r.kept)
    out = line_quality.content_only(docs, field)
    assert Counter(r.doc_id for r in out.collect()) == kept and out.columns == docs.columns
    assert line_quality.content_only(empty, field).collect() == []


def test_misspelt_words_are_caught():
    rng = np.random.default_rng(3)
    plain = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "minim"]
    texts, labels = [], []
    for k in range(300):
        w = list(rng.choice(plain, 30))
        if k % 3 == 0:
            w[5] = "blockhead"
            w[9] = "nitwit"
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    m = toxicity.fit(texts, np.array(labels), np.ones(300))
    base = " ".join(plain * 3)
    score = lambda t: toxicity.score(m, *common.bytes_of(pa.array([t], pa.large_string())))[0]
    assert score(base) < 0.3 <= score(base + " blockhead nitwit") and score(base + " blockheads blokhead nitwitz") > score(base)


def test_scores(spark, docs, rows, empty):
    m = toxicity.train(docs, _labels(spark, rows))
    got = toxicity.score_documents(docs, m).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score_documents(empty, m).collect() == []
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, none).count() == len(rows)


def test_held_out_rows_teach_nothing(spark):
    """held_out is the checksum's, and labels of held-out rows change no score; labels of others do."""
    import zlib

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words, 40)) + (" slur" if k % 3 == 0 else "")) for k in range(200)] + [(None, "slur"), (7, "another text"), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda flip: spark.createDataFrame([(k, 1, int(k % 3 == 0) ^ int(flip(k))) for k in range(200)], "doc_id long, quality int, toxic int")
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    scored = lambda flip: sorted((r.doc_id or -1, r.held_out, r.score) for r in toxicity.score_documents(docs, toxicity.train(docs, told(flip))).collect())
    first = scored(lambda k: False)
    assert all(h == (i >= 0 and out(i)) for i, h, _ in first) and len(first) == len(rows)
    assert first == scored(out) and first != scored(lambda k: not out(k))
    empty = [s for i, _, s in first if i in (300, 301)]
    assert empty[0] == empty[1] and 0 <= empty[0] <= 1


def test_scores_against_plain_python(spark):
    """The score as a mean of means over words and their n-grams, one number at a time."""
    rng = np.random.default_rng(6)
    m = toxicity.Model(rng.normal(size=1 << 8).astype(np.float32), 0.3, 2.0)
    text = "Some words, some MORE words; x"
    one = lambda t: toxicity._Bags(*common.bytes_of(pa.array([t], pa.large_string())), 1 << 8)
    words = re.findall("[a-z0-9]+", text.lower())
    total = sum(float(np.mean([m.bucket[g].astype(np.float64) for g in one(w).gram])) for w in words)
    z = m.bias + m.scale * total / (len(words) + toxicity.NEUTRAL)
    assert abs(toxicity.score(m, *common.bytes_of(pa.array([text], pa.large_string())))[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert len(one("word").gram) == 1 + sum(len("word") + 2 - n + 1 for n in (3, 4, 5))


def test_mixed_documents_change_label_at_the_seam():
    good = "A plain sentence of several words ends here.\nAnother one that reads well enough to keep.\nAnd a third of the same kind follows it.\n"
    bad = "BUY!! NOW!! ***\nCHEAP!! SALE!!\na | b | c | d\n"
    x = line_quality.describe(*common.bytes_of(pa.array([good, bad] * 4, pa.large_string())))
    y = np.array([1, 0] * 4)
    field = line_quality.fit(x.doc, x.features, y[x.doc], np.ones(8), 8)
    mixed = line_quality.describe(*common.bytes_of(pa.array([good + bad, bad + good], pa.large_string())))
    label = line_quality.viterbi(field, mixed.doc, mixed.features, 2)
    assert label[mixed.doc == 0].tolist() == [1, 1, 1, 0, 0, 0] and label[mixed.doc == 1].tolist() == [0, 0, 0, 1, 1, 1]


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)] + [(3, "a"), (None, "y")], "doc_id long, text string")
    rows = common.sample_texts(docs, list(range(50)), most_bytes=1000)
    assert len(rows) == 10 and all(r.text in ("x" * 100, "a") for r in rows)
    assert {r.doc_id: r.text for r in common.sample_texts(docs, [3, 4])} == {3: "a", 4: "x" * 100} and common.sample_texts(docs, []) == [] and common.sample_texts(docs, [99]) == []


def test_rules_on_an_empty_table(spark, empty):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert line_quality.judge(empty, line_quality.train(empty, labels)).collect() == [] and toxicity.score_documents(empty, toxicity.train(empty, labels)).collect() == []
