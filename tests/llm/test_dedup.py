import hashlib
import random
import re

import numpy as np
import pytest

from sparkfold.llm import minhash_dedup, substring_dedup, suffix_dedup
from sparkfold.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _once(rows):
    """Rows by doc_id; equal rows are one."""
    return sorted({(i, t or "") for i, t in rows if i is not None})


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == linked
    for a in linked:
        assert got[a] == min(b for b in parent if find(b) == find(a))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, rows, words):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash_dedup.near_duplicates(docs, words=words).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == comp[r.doc_id] and r.kept == (r.component_id == r.doc_id) and r.n_shingles in {len(x) for x in sets[r.doc_id]}
        else:
            assert not r.kept


def test_mixed_buckets_are_settled_by_postings():
    a, b, c, d = (np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [7, 8, 9, 10], [7, 8, 9, 10, 11]))
    got = minhash_dedup._postings([(1, 1, a), (2, 2, b), (3, 3, c), (4, 4, d)], 80)
    assert {tuple(sorted(x)) for x in got} == {(3, 4)}


def test_suffix_dedup(docs, rows):
    seen, want = set(), {}
    for i, t in _once(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if k in seen:
                gone[s : s + 100] = True
            seen.add(k)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


def test_loser_tree_orders_runs_and_their_prefixes():
    rng = random.Random(4)
    runs = []
    for _ in range(5):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 12)))
        lcp = [0] + [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(keys, keys[1:])]
        runs.append((keys, lcp[: len(keys)]))
    order, shared = suffix_dedup.merge(runs, 6)
    keys = [runs[r][0][k] for r, k in order]
    assert keys == sorted(x for r in runs for x in r[0])
    assert shared[1:] == [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(keys, keys[1:])]


def test_front_coding_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(97, 99, (50, 8)).astype(np.uint8).view("S8").ravel()).view(np.uint8).reshape(50, 8)
    lcp, rest = suffix_dedup.front_code(keys)
    assert (suffix_dedup.front_decode(lcp, rest, 8) == keys).all() and len(rest) < keys.size


def test_cleaned_texts(docs, rows):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    total = sum(len(r.text or "") for r in out.collect())
    assert 0 < total < sum(len(t or "") for _, t in rows)


def test_substring_dedup(docs, rows):
    seen, want = {}, {}
    for i, t in _once(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, x in enumerate(own):
            if seen.get(x, i) < i:
                gone[k : k + 50] = [True] * 50
        for x in own:
            seen.setdefault(x, i)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


def test_automaton_against_all_windows():
    rng = random.Random(7)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(8)]
    a = substring_dedup.Automaton()
    for d, t in enumerate(texts):
        a.add(t, d)
    a.finish()
    for d, t in enumerate(texts):
        want = [k for k in range(len(t) - 4) if any(t[k : k + 5] == u[j : j + 5] for u in texts[:d] for j in range(len(u) - 4))]
        assert a.earlier(t, d, 5) == want


def test_empty_tables(empty):
    assert minhash_dedup.near_duplicates(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert suffix_dedup.cleaned(empty).collect() == []
    assert substring_dedup.remove_repeats(empty).collect() == []
