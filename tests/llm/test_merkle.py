import hashlib
import zlib

import pytest

from sparkfold.llm import common, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string, pos long, root string"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(doc_id, source, lang, n, text):
    return _h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))


def _climb(nodes):
    """Siblings (left, right) of every node, level by level, and the last node."""
    paths = [[] for _ in nodes]
    members = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for lo in range(0, len(nodes), 3):
            run = nodes[lo : lo + 3]
            for j in range(len(run)):
                for k in members[lo + j]:
                    paths[k].append((run[:j], run[j + 1 :]))
            up.append(_h("".join(run)))
            held.append([k for m in members[lo : lo + 3] for k in m])
        nodes, members = up, held
    return paths, nodes[0]


def _brute(rows):
    groups = {}
    for doc_id, source, lang, n, text in rows:
        groups.setdefault(source, []).append((doc_id, _leaf(doc_id, source, lang, n, text), text, lang, n))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _climb([x[1] for x in groups[g]])
    upper, root = _climb([trees[g][1] for g in order])
    out = []
    for g, high in zip(order, upper):
        for (doc_id, leaf, text, lang, n), path in zip(groups[g], trees[g][0]):
            path = path + high
            h = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                h = _leaf(doc_id, g, lang, n, text.replace("\n", "") if text is not None else None)
            for left, right in path:
                h = _h("".join(left) + h + "".join(right))
            out.append((doc_id, leaf, trees[g][1], root, _h("".join("".join(a) + "".join(b) for a, b in path)), h, h == root))
    return sorted(out, key=repr)


def _got(spark, rows, monkeypatch, top):
    df = spark.createDataFrame([(i, t, lang, s, n, "x", "y", 3, "z") for i, s, lang, n, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(merkle.common, "table", lambda *_: df)
    monkeypatch.setattr(merkle, "TOP", top)
    inner = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda leaves: inner(leaves, top))
    out = merkle.op13_merkle_manifest(spark, "")
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("top", [merkle.TOP, 2])
def test_manifest_against_a_walk(spark, monkeypatch, top):
    rows = [(k, "hot", "en", 5, f"text {k}\nline") for k in range(800)]
    rows += [(k, s, None, None, "a\n" * (k % 3)) for k, s in enumerate([None, "é", "z", "Z", "", "ab", "a", None, "z"])]
    rows += [(5, "z", "de", 1, None), (None, "z", None, None, None), (None, "z", None, None, None), (7, "dup", "en", 2, "same\n"), (7, "dup", "en", 2, "same\n"), (6, "long", "en", 1, "é\n" * 200_000)]
    assert _got(spark, rows, monkeypatch, top) == _brute(rows)


def test_tree_over_many_groups(spark, monkeypatch):
    rows = [(k, f"s{k}", "en", k, f"t\n{k}") for k in range(750)]
    assert _got(spark, rows, monkeypatch, 1) == _brute(rows)


def test_empty_table(spark, monkeypatch):
    assert _got(spark, [], monkeypatch, merkle.TOP) == []


def test_blocks_are_bounded(spark):
    leaves = common.stored(spark.range(1000).selectExpr("id", "'one' as grp", "sha2(string(id), 256) as leaf"))
    assert merkle._blocks(merkle.placed(leaves, "id", "leaf")).selectExpr("max(size(members))").first()[0] == merkle.BLOCK
