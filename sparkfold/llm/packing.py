"""Packing: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `most` ids: whole ones first, the rest last. Full pieces are sequences of
their own. The others are packed by their length histogram alone (at most `most` - 1 numbers, whatever the corpus):
lengths are placed longest first, each into the packing pattern with the least room that still takes it, and only the
patterns' counts change. Patterns are then joined back to pieces by each piece's rank among those of its length.
Sequences that would still be padded by more than `slack` ids are taken apart, laid end to end and cut at `most`; the
few ids left at the very end fill sequences of power-of-two lengths, which need no padding.

Ranks are counted in two steps, within written parts and then over (part, length) counts, so no length, however
frequent, meets in one task.

Null text is empty: its end id is packed. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.llm import common
from sparkfold.llm.token_files import encode_ids
from sparkfold.llm.wordpieces import encoder


def pack_histogram(histogram: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: patterns that take every piece of the histogram once. At most twice as many patterns as lengths."""
    rooms: list[int] = []  # distinct rooms left, ascending
    by_room: dict[int, list[list]] = {}

    def put(count: int, pattern: tuple[int, ...], room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = most // length  # a new pattern takes as many of them as fit
                if left >= each:
                    put(left // each, (length,) * each, most - each * length)
                if left % each:
                    put(1, (length,) * (left % each), most - (left % each) * length)
                break
            room = rooms[k]
            count, pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            each = room // length
            if left < each:
                used, each = 1, left
            else:
                used = min(count, left // each)
            if used < count:
                put(count - used, pattern, room)
            put(used, pattern + (length,) * each, room - each * length)
            left -= used * each
    return [(c, p) for room in sorted(by_room) for c, p in by_room[room]]


def pieces(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int | None = 1, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece, before packing, and `part` and `local`: the task that
    made it and its number among that task's pieces of the same length. Its ids too, if asked for."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in common.slices(batches):
            ids, n = enc.encode(*common.bytes_of(b.column(1)))
            raw, at, rows = ids.astype("<u4").tobytes(), 0, []
            for d, k in zip(b.column(0).to_pylist(), n.tolist()):
                own = raw[at : at + 4 * k] + tail
                at += 4 * k
                for s in range(0, len(own), 4 * most):
                    x = own[s : s + 4 * most]
                    length = len(x) // 4
                    rows.append((d, s // 4, length, zlib.crc32(x), len(own) // 4, part, seen[length], *[x] * with_ids))
                    seen[length] += 1
            kinds = [b.column(0).type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    numbers = ", ".join(f"{c} long" for c in names[1:7])
    return common.texts(docs, text=text).mapInArrow(cut, f"doc_id {kind}, {numbers}" + ", ids binary" * with_ids)


def numbered(found: DataFrame) -> DataFrame:
    """Written pieces with `rank`: a gapless number from 0 among the rows of the same length, in no special order. `found` must be
    stored, as a second run could deal its rows to other tasks."""
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(per_part.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")


def plan(histogram: dict[int, int], most: int, slack: int) -> tuple[dict[int, list[np.ndarray]], int]:
    """For each length: arrays over its rank intervals (first rank, sequences in the pattern, first sequence, offset in the sequence),
    one interval per pattern and slot; and the number of sequences. Patterns that leave more than `slack` room are left out: loose()."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for count, pattern in pack_histogram({k: v for k, v in histogram.items() if k < most}, most):
        if most - sum(pattern) > slack:
            continue
        at = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], count, sequence, at))
            taken[length] += count
            at += length
        sequence += count
    if histogram.get(most):
        slots[most] = [(0, histogram[most], sequence, 0)]
        sequence += histogram[most]
    return {k: [np.array(x, np.int64) for x in zip(*v)] for k, v in slots.items()}, sequence


def pack(found: DataFrame, most: int = 2048, slack: int = 16) -> tuple[DataFrame, DataFrame]:
    """(whole pieces, pieces cut once more) with sequence_id and offset. The cut ones keep the length and checksum of the piece
    they come from as `of_length` and `of_crc32`; their own ids_crc32 is still to be taken from the ids (recut())."""
    found = common.stored(found)
    ranked = numbered(found)
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    slots, sequences = plan(histogram, most, slack)
    # One sorted array of (length, first rank) finds the interval of any piece; interval 0 only stands before all others.
    made = [np.concatenate([[0], *[slots[k][j] for k in sorted(slots)]]).astype(np.int64) for j in range(4)]
    of_length = np.repeat([0, *sorted(slots)], [1, *[len(slots[k][0]) for k in sorted(slots)]]).astype(np.int64)
    keys, (first, count, seq_of, at_of) = (of_length << 44) + made[0], made
    placed, spare = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
    np.maximum.at(placed, of_length, first + count)
    # What is left over lies end to end by length, then rank, and is cut at `most`: its place is arithmetic on the rank.
    total = 0
    for n in sorted(histogram):
        spare[n], total = total, total + n * (histogram[n] - int(placed[n]))
    whole = total // most
    ends = [whole * most]
    for bit in reversed(range(most.bit_length())):  # the end: sequences of power-of-two lengths
        if total % most >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    edge = np.array(ends, np.int64)
    names = [c for c in found.columns if c not in ("part", "local")]
    extra = ["sequence_id", "offset", "of_length", "of_crc32"]

    def loose_sequence(x: np.ndarray) -> np.ndarray:
        return np.where(x < whole * most, x // most, whole + np.searchsorted(edge, x, "right") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            packed, loose = np.flatnonzero(rank < placed[n]), np.flatnonzero(rank >= placed[n])
            k = np.searchsorted(keys, (n[packed] << 44) + rank[packed], "right") - 1
            lo = spare[n[loose]] + (rank[loose] - placed[n[loose]]) * n[loose]
            hi = lo + n[loose]
            begun = loose_sequence(lo)
            parts = loose_sequence(hi - 1) - begun + 1
            again = np.repeat(np.arange(len(loose)), parts)
            s = begun[again] + common.ranges(np.zeros(len(parts), np.int64), parts)
            tail = np.clip(s - whole, 0, len(edge) - 2) if len(edge) > 1 else np.zeros(len(s), np.int64)
            opens = np.where(s < whole, s * most, edge[tail])
            closes = np.where(s < whole, s * most + most, edge[np.minimum(tail + 1, len(edge) - 1)])
            x, upto = np.maximum(lo[again], opens), np.minimum(hi[again], closes)
            cut = upto - x < n[loose][again]
            rows = np.concatenate([packed, loose[again]])
            out = {c: b.column(b.schema.get_field_index(c)).take(pa.array(rows)) for c in names}
            since = np.concatenate([np.zeros(len(packed), np.int64), x - lo[again]])
            whole_piece = np.concatenate([np.ones(len(packed), bool), ~cut])
            own = {
                "start": out["start"].to_numpy() + since, "length": np.concatenate([n[packed], upto - x]), "sequence_id": np.concatenate([seq_of[k] + rank[packed] - first[k], sequences + s]),
                "offset": np.concatenate([at_of[k], x - opens]),
            }
            out |= {c: pa.array(v, pa.int64()) for c, v in own.items()} | {"of_length": pa.array(n[rows], pa.int64(), mask=whole_piece), "of_crc32": pa.array(out["ids_crc32"].to_numpy(), pa.int64(), mask=whole_piece)}
            yield pa.record_batch([out[c] for c in [*names, *extra]], names=[*names, *extra])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c in names)
    out = ranked.select(*names, "rank").mapInArrow(place, f"{schema}, " + ", ".join(f"{c} long" for c in extra))
    return out.where("of_length is null").drop("of_length", "of_crc32"), out.where("of_length is not null")


#: Cut pieces whose document ids are sent to every task (8 bytes each); more are joined by a shuffle.
FEW = 50_000


def recut(docs: DataFrame, cut: DataFrame, vocabulary: str, most: int = 2048, end_id: int | None = 1, text: str = "text") -> DataFrame:
    """`cut` with the checksums of its ids, from its documents alone, encoded again."""
    cut = common.stored(cut)
    owners = cut.select("doc_id").distinct()
    if owners.count() <= FEW:
        owners = F.broadcast(owners)
    again = pieces(docs.join(owners, docs["doc_id"].eqNullSafe(owners["doc_id"]), "left_semi"), vocabulary, most, end_id, text, with_ids=True)
    again = again.select("doc_id", F.col("start").alias("of_start"), F.col("length").alias("of_length"), F.col("ids_crc32").alias("of_crc32"), "ids").dropDuplicates(["doc_id", "of_start", "of_length", "of_crc32"])
    own = cut.withColumn("of_start", F.expr(f"cast(start div {most} * {most} as long)"))
    on = own.alias("c").join(again.alias("p"), F.expr("c.doc_id <=> p.doc_id and c.of_start = p.of_start and c.of_length = p.of_length and c.of_crc32 = p.of_crc32"))
    part = F.expr(f"substring(p.ids, cast((c.start % {most}) * 4 + 1 as int), cast(c.length * 4 as int))")
    return on.select(*[F.crc32(part).alias(c) if c == "ids_crc32" else F.col(f"c.{c}") for c in cut.columns if c not in ("of_length", "of_crc32")])


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end_id: int | None = 1, text: str = "text") -> DataFrame:
    """sequence_id, length and `ids` (little-endian 32-bit) of each packed sequence, joined from the pieces' documents. Null ids match null
    ones; of documents that share an id, a piece is taken from one whose ids there have its checksum."""
    ids = encode_ids(docs, vocabulary, end_id, text, wide=True).dropDuplicates(["doc_id", "n", "crc"]).select(F.col("doc_id").alias("own_id"), "n", "ids")
    part = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    found = packed.join(ids, F.expr("doc_id <=> own_id and doc_tokens = n")).select("sequence_id", "offset", "ids_crc32", part.alias("ids")).where("crc32(ids) = ids_crc32")
    laid = found.groupBy("sequence_id").agg(F.sort_array(F.collect_set(F.struct("offset", "ids"))).alias("parts"))
    return laid.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")).select("sequence_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("length"), "ids")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs, path = common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json")
    whole, cut = pack(pieces(docs, path))
    return whole.unionByName(recut(docs, cut, path))
