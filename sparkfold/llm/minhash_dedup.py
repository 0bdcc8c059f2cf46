"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles; documents with equal sets are one class from the start, whatever their
number. One hash of each shingle gives both its bin and its value; a bin's least value is the sketch there, and an empty
bin takes the value of the bin that its own sequence of probes reaches first. Bands of `rows` bins make bucket keys.

Candidates of a bucket are a star, each class with one centre of the bucket (of four, by band), so a bucket of n gives n - 1
pairs; a pair is confirmed on the full sets. Buckets whose classes the confirmed links leave in different components give
further stars, the centres drawn anew. What is still apart after these rounds is settled exactly: a bucket's sets go to one
task, which counts shared shingles by postings and gives back only links that join components, so no link between bucket
mates is lost and nothing grows with the square of a bucket. With 32 bands of 4 rows, two sets at the threshold
share no bucket about once in ten million times.

Null and empty texts (and those without words) have the empty set: linked with nothing, their own component, kept. A row
without doc_id is in its class's component but never kept. Of rows that share a doc_id, each is judged by its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common
from sparkfold.llm.components import components

_U = np.uint64


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each row, ascending; how many each row has). A-Z are lower-cased."""
    n = len(offs) - 1
    _, _, row, w = common.words_of(data, offs, lower=True)
    count = np.bincount(row, minlength=n)
    at = np.cumsum(count) - count
    full = np.zeros(max(0, len(w) - size + 1), _U)
    for k in range(size):
        full = (full ^ w[k : k + len(full)]) * common._M1 + common._BASE
    full = common.mix(full)
    own, sizes = [], np.zeros(n, np.int64)
    for r in range(n):
        c = count[r]
        if not c:
            continue
        if c < size:
            h = _U(c)
            with np.errstate(over="ignore"):
                for x in w[at[r] : at[r] + c]:
                    h = (h ^ x) * common._M2 + common._BASE
            got = common.mix(np.array([h], _U))
        else:
            got = np.unique(full[at[r] : at[r] + c - size + 1])
        sizes[r] = len(got)
        own.append(got)
    return (np.concatenate(own) if own else np.zeros(0, _U)), sizes


def sketch(hashes: np.ndarray, sizes: np.ndarray, bins: int = 128) -> np.ndarray:
    """rows x bins; rows without shingles are zero. `bins` is a power of two."""
    n = len(sizes)
    bits = bins.bit_length() - 1
    row = np.repeat(np.arange(n), sizes)
    bin_ = (hashes >> _U(64 - bits)).astype(np.int64)
    key = row * bins + bin_
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out = np.zeros(n * bins, _U)
    have = np.zeros(n * bins, bool)
    out[key[first]] = hashes[first]  # ascending within a row: the first of a bin is its least
    have[key[first]] = True
    have = have.reshape(n, bins)
    out = out.reshape(n, bins)
    rows, empty = np.nonzero(~have & (sizes > 0)[:, None])
    for probe in range(4 * bins):
        if not len(rows):
            break
        to = (common.mix(empty.astype(_U) * common._BASE + _U(probe + 1)) >> _U(64 - bits)).astype(np.int64)
        if probe >= 2 * bins:  # hardly any bin is filled: the next one round the circle
            to = (empty + probe - 2 * bins + 1) % bins
        ok = have[rows, to]
        out[rows[ok], empty[ok]] = out[rows[ok], to[ok]]
        rows, empty = rows[~ok], empty[~ok]
    return out


def band_keys(sketches: np.ndarray, rows: int = 4) -> np.ndarray:
    n, bins = sketches.shape
    s = sketches.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=_U), s.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ s[:, :, k]) * common._M2 + common._BASE
    return common.mix(key)


def _profile(docs: DataFrame, size: int, bins: int, rows: int, text: str) -> DataFrame:
    """doc_id, n_shingles, node (a hash of the whole set, null where empty) and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            h, n = shingles(*common.bytes_of(b.column(1)), size)
            keys = band_keys(sketch(h, n, bins), rows).view(np.int64)
            some = n > 0
            at = (np.cumsum(n) - n)[some]
            node = np.zeros(len(n), _U)
            if len(at):
                node[some] = common.mix(np.add.reduceat(common.mix(h * common._M2), at) + n[some].astype(_U))
            offs = np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.record_batch({"doc_id": b.column(0), "n_shingles": pa.array(n), "node": pa.array(node.view(np.int64), mask=~some), "bands": pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.ravel()))})

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node long, bands array<long>")


def _sets(docs: DataFrame, size: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            h, n = shingles(*common.bytes_of(b.column(1)), size)
            at = np.cumsum(n) - n
            node = np.zeros(len(n), _U)
            some = n > 0
            if some.any():
                node[some] = common.mix(np.add.reduceat(common.mix(h * common._M2), at[some]) + n[some].astype(_U))
            yield pa.record_batch({"node": pa.array(node.view(np.int64)), "hashes": pa.ListArray.from_arrays(pa.array(np.append(at, n.sum()), pa.int32()), pa.array(h.view(np.int64)))})

    return common.texts(docs, text=text).mapInArrow(run, "node long, hashes array<long>")


def _stars(buckets: DataFrame, draw) -> DataFrame:
    """Pairs (a, b) of each bucket's members (key, node, n) with the member that has the least draw."""
    centres = buckets.groupBy("key").agg(F.min(F.struct(draw.alias("d"), "node", "n")).alias("c")).select("key", F.col("c.node").alias("cn"), F.col("c.n").alias("ck"))
    return buckets.join(centres, "key").where("node <> cn").select(F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b"), F.col("n").alias("p"), F.col("ck").alias("q"))


def _postings(members: list[tuple], similarity: int) -> list[tuple[int, int]]:
    """Links that join the components of one bucket. members: (node, root, hashes). Every member outside the largest component is
    held against all others, by the postings of its shingles."""
    parent = {m[1]: m[1] for m in members}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(m[2]) for m in members])
    _, word = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(word, kind="stable")
    posted, count = owner[order], np.bincount(word)
    at = np.cumsum(count) - count
    begin = np.cumsum(sizes) - sizes
    roots, tally = np.unique([m[1] for m in members], return_counts=True)
    main = roots[tally.argmax()]
    out = []
    for p, (node, root, _) in enumerate(members):
        if root == main:
            continue
        own = word[begin[p] : begin[p] + sizes[p]]
        shared = np.bincount(posted[common.ranges(at[own], count[own])], minlength=len(members))
        for q in np.flatnonzero(100 * shared >= similarity * (sizes[p] + sizes - shared)):
            x, y = find(root), find(members[q][1])
            if x != y:
                parent[x] = y
                out.append((node, members[q][0]))
    return out


def _settle(apart: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for b in batches:
            found = []
            for k, (key, node, root) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if key != current and held:
                    found += _postings(held, similarity)
                    held = []
                current = key
                held.append((node, root, b.column(3)[k].values.to_numpy(zero_copy_only=False)))
            yield pa.record_batch([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])
        if held:
            found = _postings(held, similarity)
            yield pa.record_batch([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    rows = apart.select("key", "node", "root").join(sets, "node").repartition("key").sortWithinPartitions("key")
    return rows.select("key", "node", "root", "hashes").mapInArrow(run, "a long, b long").distinct()


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node, n, root) of the buckets that hold more than one component. Buckets that hold the same members are one."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), mark.alias("mark")).where("lo <> hi")
    mixed = mixed.groupBy("m", "mark", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    return placed.join(mixed, "key").select("key", "node", "n", "root")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, bins: int = 128, rows: int = 4, rounds: int = 1, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`."""
    docs = docs.select("doc_id", text)
    base = common.stored(_profile(docs, words, bins, rows, text))
    classes = common.stored(base.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    fits = 100 * F.least("p", "q") >= similarity * F.greatest("p", "q")  # else the sizes alone rule it out
    buckets = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = common.stored(buckets.join(shared, "key"))
    nodes = members.select("node").distinct()
    wanted = classes.join(nodes, "node").select(F.col("least").alias("own_id")).distinct()
    own = docs.join(wanted, F.col("doc_id") == F.col("own_id"), "left_semi")
    sets = common.stored(_sets(own, words, text).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "none")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
        y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
        common_n = F.size(F.array_intersect("ha", "hb"))
        ok = 100 * common_n >= similarity * (F.size("ha") + F.size("hb") - common_n)
        return pairs.where(fits).select("a", "b").distinct().join(x, "a").join(y, "b").where(ok).select("a", "b")

    links = common.stored(confirmed(_stars(members, F.xxhash64("node", F.col("band") % 4))))
    roots = common.stored(components(links))
    apart = common.stored(_mixed(members, roots))
    for k in range(rounds):
        if apart.isEmpty():
            break
        links = common.stored(links.unionByName(confirmed(_stars(apart, F.xxhash64("node", "key", F.lit(k))).unionByName(_stars(apart, F.xxhash64("root", "node", F.lit(k)))))))
        roots = common.stored(components(links))
        apart = common.stored(_mixed(members, roots))
    if not apart.isEmpty():
        late = common.stored(_settle(apart, sets, similarity))
        if not late.isEmpty():
            roots = common.stored(components(links.unionByName(late)))
    labelled = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(component, "root").select("node", "component_id")
    out = base.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x WHERE r.c < l.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
