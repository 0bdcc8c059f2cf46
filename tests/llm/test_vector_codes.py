import hashlib
import math
import random

import numpy as np
import pytest

from sparkfold.llm import vector_codes


def _brute(rows, parts=4, entries=256, rounds=4):
    """Codes, errors, label sums and the digest by all distances in Python integers. `rows`: (id, label, vector) with vectors of one length."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    found = [[near(cut[p][j], books[p]) for p in range(parts)] for j in range(len(kept))]
    cap = lambda x: min(x, (1 << 63) - 1)
    errors = [cap(sum(d for d, _ in f)) for f in found]
    by_label = {}
    for (_, lab, _), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, cap(by_label[lab]), digest) for (i, lab, _), f, e in zip(kept, found, errors)), key=repr)


def _got(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, lab, v, "c", 1) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string, error int").repartition(3)
    monkeypatch.setattr(vector_codes.common, "table", lambda *_: df)
    return sorted((tuple(r) for r in vector_codes.op12_vector_codes(spark, "").collect()), key=repr)


def _rows(rng, n, dims, value):
    rows = [(k, rng.choice([0, 0, 0, 1, None]), [value() for _ in range(dims)]) for k in range(n)]
    rows += [(3, 1, rows[3][2]), (n, 2, rows[5][2]), (None, 2, rows[7][2]), (n + 1, 1, [0.0] * dims), (n + 2, 1, [0.0] * dims)]
    return rows + [(n + 3, 1, None), (n + 4, 1, [None] + [0.5] * (dims - 1)), (n + 5, 1, [float("nan")] * dims), (n + 6, 1, [float("inf")] * dims), (n + 7, 1, []), (n + 8, 1, [0.25] * (dims + 4))]


@pytest.mark.parametrize("dims", [8, 20])
def test_codes_against_all_distances(spark, monkeypatch, dims):
    rng = random.Random(dims)
    rows = _rows(rng, 420, dims, lambda: rng.choice([rng.gauss(0, 0.4), 0.25, -0.125]))
    assert _got(spark, rows, monkeypatch) == _brute([r for r in rows if r[2] is None or len(r[2]) == dims])


def test_huge_components(spark, monkeypatch):
    rng = random.Random(9)
    rows = _rows(rng, 70, 8, lambda: rng.choice([1e30, -3e29, 0.5, 7e18, -1e-3, 2.0**40]))
    assert _got(spark, rows, monkeypatch) == _brute([r for r in rows if r[2] is None or len(r[2]) == 8])


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    rows = _rows(rng, 60, 8, rng.random)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    assert _got(spark, rows, monkeypatch) == _brute([r for r in rows if r[2] is None or len(r[2]) == 8])


def test_empty_and_unusable_tables(spark, monkeypatch):
    assert _got(spark, [], monkeypatch) == []
    assert _got(spark, [(1, 1, None), (2, None, [])], monkeypatch) == []


def test_nearest_by_annulus_alone():
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(-40, 40, (200, 3)), rng.integers(-3, 3, (56, 3))])
    x = rng.integers(-60, 60, (3000, 3)).astype(float)
    near, d = vector_codes.Annulus(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (near == every.argmin(1)).all() and (d == every.min(1)).all()


def test_cuts():
    assert vector_codes.cuts(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
