"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

Only suffixes at anchors are sorted: every window of `window` bytes has one (see passages.py), equal windows the same, and
anchors that the corpus holds once are left out, so the array is sparse but loses no repeat. An entry is the suffix at an
anchor, cut to the window's length, followed by the bytes before the anchor in reverse. Each task sorts its entries into
runs and writes them front-coded: how many bytes an entry shares with the one before, then the rest. Runs are exchanged by
key range, with splitters from a sample of a few keys for each range, and each range merges its runs in a loser tree that keeps, for every
run, the prefix its head is known to share with the last winner: heads with different known prefixes are ordered without
looking at their bytes, and others are compared only behind it.

In the merged order, suffixes that share n bytes stand together, and so do the reversed contexts in theirs. A window that
begins d bytes before its anchor is thus named by two class numbers, and whoever is not the first of a name starts
later than an equal window. Its bytes are removed.

Entries equal in full within a run collapse to the earliest at once, so passages that a large part of the corpus shares
are exchanged once per run. Copies of whole texts are set apart before (passages.py) and lose all their bytes.

Null and empty texts have no bytes. Nothing is removed from rows without doc_id, nor because of them. Rows that share a
doc_id but not a text are ordered by a hash of the text; equal rows are one document, its result repeated. doc_id is an integer. A very long text
is one slice of its own; an empty table gives no rows; other columns, whatever their names, stay as they are.

Copies of whole texts and entries that a run holds twice are exact classes already, by hash and by sort; the merge decides all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common
from sparkfold.llm.passages import corpus, repeated, sliding_min

#: Bytes of an anchor's gram; entries of a run and of a written chunk of it; entries that a key range is meant to hold.
GRAM, RUN, CHUNK, RANGE = 24, 100_000, 4096, 30_000
#: Keys sampled for the splitters: so many at least, and so many for each range.
SAMPLE, PER_RANGE = 20_000, 4
_U = np.uint64


def anchors(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, rows, hashes) of the anchors of all windows within the rows of text."""
    n, w = len(data), window - GRAM + 1
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U)
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", buf.data, strides=(1,))
    g = eight[: n - GRAM + 1] * common._M1
    for k in range(8, GRAM, 8):
        g = (g ^ (g >> _U(31)) ^ eight[k : k + len(g)]) * common._M2
    g ^= g >> _U(29)
    g |= _U(1)
    m = sliding_min(g, w)  # by window
    row = np.searchsorted(offs, np.arange(len(m)), "right") - 1
    m[np.arange(len(m)) + window > offs[row + 1]] = 0  # crosses the end of a text
    # A place is an anchor if one of the windows over it has its hash; greatest = -least of the negated.
    most = ~sliding_min(~np.concatenate([np.zeros(w - 1, _U), m, np.zeros(len(g) - len(m), _U)]), w)
    at = np.flatnonzero(most[: len(g)] == g)
    return at, row[np.minimum(at, len(m) - 1)] if len(m) else at, g[at]


def _keys(window: int):
    def keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, _, h = anchors(data, offs, window)
        row = np.searchsorted(offs, at, "right") - 1
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        keep = new.copy()
        keep[1:] |= new[:-1]  # twice, if the text itself holds it twice
        return h[keep], np.bincount(row[keep], minlength=len(offs) - 1).astype(np.int64)

    return keys


def shared(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row of a byte matrix has in common with the row before it; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    lcp = shared(keys)
    return lcp, keys[np.arange(keys.shape[1]) >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(lcp), width), np.uint8)
    own = np.arange(width) >= lcp[:, None]
    out[own] = np.frombuffer(rest, np.uint8)
    # Every byte comes from the last row before that wrote its place.
    source = np.where(own, np.arange(len(lcp))[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return out[source, np.arange(width)]


def _lcp(a: bytes, b: bytes, h: int, width: int) -> int:
    while h < width and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < width and a[h] == b[h]:
        h += 1
    return min(h, width)


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs of (keys, bytes shared with the key before). Returns the order as (run, place) pairs, and what
    each shares with the one before it. Ties go to the earlier run."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # bytes each head shares with the last winner
    place = [0] * k
    loser = [0] * k

    def beats(a: int, b: int) -> int:
        """The winner of two runs' heads; the loser's known prefix becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a
        if x is None:
            return b
        if known[a] != known[b]:
            return a if known[a] > known[b] else b
        h = _lcp(x, y, known[a], width)
        if h == width:
            win = min(a, b)
        else:
            win = a if x[h] < y[h] else b
        known[b if win == a else a] = h
        return win

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win = beats(a, b)
        loser[node] = b if win == a else a
        return win

    win = build(1)
    order, common_with = [], []
    while heads[win] is not None:
        i = place[win]
        order.append((win, i))
        common_with.append(known[win])
        keys, lcps = runs[win]
        i += 1
        place[win] = i
        if i < len(keys):
            heads[win], known[win] = keys[i], lcps[i]
        else:
            heads[win] = None
        node = (win + k) // 2
        while node:
            other = loser[node]
            best = beats(win, other)
            if best != win:
                loser[node], win = win, other
            node //= 2
    return order, common_with


def _runs(texts: DataFrame, window: int) -> tuple[DataFrame, int]:
    """Chunks of sorted, front-coded runs, and the entry width. Entries that a run holds twice come out as `dup` spans instead."""
    left = window - GRAM
    width = window + left

    def entries(batches):
        for b in common.slices(batches):
            data, offs = common.bytes_of(b.column(2))
            at, _, h = anchors(data, offs, window)
            row = np.searchsorted(offs, at, "right") - 1
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            keep = [np.isin(h[cut[r] : cut[r + 1]], np.array(b.column(3)[r].as_py(), np.int64).view(_U)) for r in range(b.num_rows)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            at, row = at[keep], row[keep]
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h1 = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            pos = at - offs[row]
            after = np.minimum(window, offs[row + 1] - at)
            before = np.minimum(left, pos)
            for lo in range(0, len(at), 20_000):
                s = slice(lo, lo + 20_000)
                key = np.zeros((len(at[s]), width), np.uint8)
                i, j = np.arange(window), np.arange(left)
                ok = i < after[s, None]
                key[:, :window][ok] = data[(at[s, None] + i)[ok]]
                ok = j < before[s, None]
                key[:, window:][ok] = data[(at[s, None] - 1 - j)[ok]]
                yield key, np.stack([doc[row[s]], h1[row[s]], pos[s], after[s], before[s]], 1)

    names = ["run", "chunk", "n", "lcp", "rest", "about", "first", "dup"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def flush():
            key, about = np.concatenate(keys), np.concatenate(abouts)
            order = np.lexsort((about[:, 2], about[:, 1], about[:, 0], np.ascontiguousarray(key).view(f"S{width}").ravel()))
            key, about = key[order], about[order]
            lcp = shared(key)
            same = (lcp == width) & np.concatenate([[False], (about[1:, 3:] == about[:-1, 3:]).all(1)])
            d, far, near = about[same], np.minimum(window - GRAM, about[same, 4]), np.maximum(0, window - about[same, 3])
            d, far, near = (x[far >= near] for x in (d, far, near))
            dup = np.stack([d[:, 0], d[:, 1], d[:, 2] - far, d[:, 2] - near + window], 1).astype(np.int64)
            key, about = key[~same], about[~same]
            rows = []
            for c, lo in enumerate(range(0, len(key), CHUNK)):
                part, a = key[lo : lo + CHUNK], about[lo : lo + CHUNK]
                lcp, rest = front_code(part)
                rows.append(((TaskContext.get().partitionId() << 20) + number, c, len(part), lcp.astype(np.uint8).tobytes(), rest, a.tobytes(), part[:, :GRAM][::64].tobytes(), dup.tobytes() if not lo else b""))
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        keys, abouts, size = [], [], 0
        for key, about in entries(batches):
            keys.append(key)
            abouts.append(about)
            size += len(key)
            if size >= RUN:
                yield flush()
                keys, abouts, size, number = [], [], 0, number + 1
        if size:
            yield flush()

    return texts.select("doc_id", "h1", "text", "keys").mapInArrow(run, "run long, chunk long, n long, lcp binary, rest binary, about binary, first binary, dup binary"), width


def _splitters(runs: DataFrame, ranges: int) -> np.ndarray:
    """Range ends from sampled keys, PER_RANGE for each range, so that a range holds about as many entries whatever the corpus."""
    total = (runs.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // GRAM
    if ranges < 2 or not total:
        return np.zeros(0, f"S{GRAM}")
    wanted = max(SAMPLE, PER_RANGE * ranges)
    share = min(1.0, wanted / total)
    got = runs.select("first").where(F.rand(7) <= max(share, 1e-9)).limit(wanted).collect() if share < 1 else runs.select("first").collect()
    keys = np.sort(np.concatenate([np.frombuffer(r.first, f"S{GRAM}") for r in got])) if got else np.zeros(0, f"S{GRAM}")
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]) if len(keys) else keys


def _exchange(runs: DataFrame, ends: np.ndarray, width: int, partitions: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for run, chunk, n, lcp, rest, about in zip(*(b.column(k).to_pylist() for k in range(6))):
                key = front_decode(np.frombuffer(lcp, np.uint8).astype(np.int64), rest, width)
                own = np.searchsorted(ends, np.ascontiguousarray(key[:, :GRAM]).view(f"S{GRAM}").ravel(), "right")
                a = np.frombuffer(about, np.int64).reshape(n, 5)
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist()
                for lo, hi in zip(edge, [*edge[1:], n]):
                    part_lcp, part_rest = front_code(key[lo:hi])
                    rows.append((int(own[lo]), run, chunk, part_lcp.astype(np.uint8).tobytes(), part_rest, a[lo:hi].tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["range", "run", "chunk", "lcp", "rest", "about"])

    out = runs.select("run", "chunk", "n", "lcp", "rest", "about").mapInArrow(split, "range long, run long, chunk long, lcp binary, rest binary, about binary")
    return out.repartition(partitions, "range").sortWithinPartitions("range", "run", "chunk")


def later_windows(keys: np.ndarray, lcp: np.ndarray, about: np.ndarray, window: int) -> np.ndarray:
    """Spans (doc, h1, from, to) of windows that an earlier entry has too. keys in merged order; about: doc, h1, place, bytes after, bytes before."""
    n, left = len(keys), window - GRAM
    group = np.cumsum(np.minimum(lcp, window) < GRAM)
    alone = np.bincount(group)[group] < 2
    if alone.all():
        return np.zeros((0, 4), np.int64)
    r = np.minimum(lcp, window)
    back = np.ascontiguousarray(keys[:, window:])
    by_left = np.argsort(back.view(f"S{left}").ravel(), kind="stable")
    left_lcp = shared(back[by_left])
    rank = np.lexsort((about[:, 2], about[:, 1], about[:, 0]))
    rank = rank[~alone[rank]]
    far, near = np.full(n, -1), np.full(n, window)
    for d in range(left + 1):
        mine = rank[(about[rank, 3] >= window - d) & (about[rank, 4] >= d)]
        if len(mine) < 2:
            continue
        right_class = np.cumsum(r < window - d)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_lcp < d)
        name = right_class[mine] * (n + 1) + left_class[mine]
        _, first = np.unique(name, return_index=True)
        again = np.ones(len(mine), bool)
        again[first] = False
        hit = mine[again]
        far[hit] = d
        near[hit] = np.minimum(near[hit], d)
    hit = np.flatnonzero(far >= 0)
    return np.stack([about[hit, 0], about[hit, 1], about[hit, 2] - far[hit], about[hit, 2] - near[hit] + window], 1)


def _merged(exchanged: DataFrame, width: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            runs, matrices, abouts = [], [], []
            by_run: dict[int, list] = {}
            for r in held:
                by_run.setdefault(r[1], []).append(r)
            for parts in by_run.values():
                key = np.concatenate([front_decode(np.frombuffer(p[3], np.uint8).astype(np.int64), p[4], width) for p in parts])
                raw = key.tobytes()
                lcp = shared(key) if len(parts) > 1 else np.frombuffer(parts[0][3], np.uint8)
                runs.append(([raw[i : i + width] for i in range(0, len(raw), width)], lcp.tolist()))
                matrices.append(key)
                abouts.append(np.concatenate([np.frombuffer(p[5], np.int64).reshape(-1, 5) for p in parts]))
            order, lcp = merge(runs, width)
            base = np.cumsum([0, *map(len, matrices)])
            at = np.array([base[r] + i for r, i in order])
            spans = later_windows(np.concatenate(matrices)[at], np.array(lcp), np.concatenate(abouts)[at], window)
            return pa.record_batch([pa.array(spans[:, k]) for k in range(4)], names=["doc_id", "h1", "lo", "hi"])

        held, current = [], None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != current and held:
                    yield flush()
                    held = []
                current = r[0]
                held.append(r)
        if held:
            yield flush()

    return exchanged.mapInArrow(run, "doc_id long, h1 long, lo long, hi long")


def _duplicates(runs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = np.concatenate([np.zeros((0, 4), np.int64), *[np.frombuffer(x, np.int64).reshape(-1, 4) for x in b.column(0).to_pylist() if x]])
            yield pa.record_batch([pa.array(spans[:, k]) for k in range(4)], names=["doc_id", "h1", "lo", "hi"])

    return runs.select("dup").mapInArrow(run, "doc_id long, h1 long, lo long, hi long")


def repeated_spans(c, window: int) -> DataFrame:
    """doc_id, h1 and `spans`, the byte ranges to remove, of every text that has any."""
    spark = c.texts.sparkSession
    runs, width = _runs(repeated(c, _keys(window)), window)
    runs = common.stored(runs)
    entries = runs.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, entries // RANGE)
    spans = _merged(_exchange(runs, _splitters(runs, ranges), width, partitions), width, window).unionByName(_duplicates(runs))
    return spans.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 100, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    c = corpus(docs, {"n_bytes": F.octet_length("text").cast("long"), "whole": F.sha2("text", 256)}, text)
    spans = common.stored(repeated_spans(c, window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            data, offs = common.bytes_of(b.column(2))
            n, k, sums = [], [], []
            for r, s in enumerate(b.column(3).to_pylist()):
                own = data[offs[r] : offs[r + 1]]
                gone = common.covered(len(own), np.array([x["lo"] for x in s]), np.array([x["hi"] for x in s]))
                n.append(int(gone.sum()))
                k.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                sums.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.record_batch({"doc_id": b.column(0), "h1": b.column(1), "gone": pa.array(n, pa.int64()), "runs": pa.array(k, pa.int64()), "sha": pa.array(sums, pa.string())})

    kind = dict(c.texts.dtypes)["doc_id"]
    mine = spans.select(F.col("doc_id").alias("d"), F.col("h1").alias("h"), "spans")
    changed = c.texts.join(mine, F.col("doc_id") == F.col("d")).where("h1 = h").select("doc_id", "h1", "text", "spans")
    changed = common.stored(changed.mapInArrow(cut, f"doc_id {kind}, h1 long, gone long, runs long, sha string"))
    c.drop()
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= window), F.lit(False))
    out = c.rows.join(changed, ["doc_id", "h1"], "left")
    n = F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long")
    return out.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, window: int = 100) -> DataFrame:
    """`docs`, all columns, with repeated bytes cut out of `text` (and the parts of a character that a cut leaves); documents of
    which nothing is left go. n_chars, where there is one, follows."""
    c = corpus(docs, {"n_bytes": F.octet_length("text").cast("long")})
    spans = common.stored(repeated_spans(c, window))
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= window)
    d, h, whole_copy, cuts, own_hash = common.unused(docs, "_d", "_h", "_copy", "_spans", "_own")
    change = c.rows.join(spans, ["doc_id", "h1"], "left").where(copy | F.col("spans").isNotNull()).select(F.col("doc_id").alias(d), F.col("h1").alias(h), copy.alias(whole_copy), F.col("spans").alias(cuts)).dropDuplicates([d, h])
    change = common.stored(change)
    c.drop()
    joined = docs.withColumn(own_hash, F.xxhash64(F.coalesce("text", F.lit("")))).join(change, (F.col("doc_id") == F.col(d)) & (F.col(own_hash) == F.col(h)), "left").drop(own_hash, d, h)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            k = b.schema.get_field_index("text")
            out = []
            for t, whole, s in zip(b.column(k).to_pylist(), b.column(b.schema.get_field_index(whole_copy)).to_pylist(), b.column(b.schema.get_field_index(cuts)).to_pylist()):
                if whole:
                    t = ""
                elif s:
                    own = np.frombuffer(t.encode(), np.uint8)
                    t = own[~common.covered(len(own), np.array([x["lo"] for x in s]), np.array([x["hi"] for x in s]))].tobytes().decode("utf-8", "ignore")
                out.append(t)
            cols = [pa.array(out, b.schema.field(k).type) if i == k else b.column(i) for i in range(b.num_columns - 2)]
            yield pa.record_batch(cols, names=b.schema.names[:-2])

    changed = joined.where(F.col(whole_copy).isNotNull())
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    done = changed.mapInArrow(cut, schema).where("text <> ''")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.where(F.col(whole_copy).isNull()).drop(whole_copy, cuts).unionByName(done)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
