"""Merkle manifest of a dataset: one digest over all rows, a proof for each row, and the check of a row against both.

A row's leaf is a digest of its fields. The leaves of a group, by ascending id, form a tree of runs of three; the groups' roots, by ascending group, form
the tree above. Large blocks of consecutive nodes are reduced where Spark puts them, bounded groups of 3**5 nodes at a time, round after round, until few
nodes are left. The driver builds that small top tree and broadcasts the path from each of its nodes to the root (the suffix paths); the tasks complete
every row's path with those of its blocks, and fold and check the rows. Digests are native SHA-256 over column values; no Python runs in a task.

Positions come from one range exchange of narrow rows (id, group, digests), whose runs are counted per partition, so a group that holds most rows is
spread like any other. Blocks are keyed by group and position, so no task collects more than 3**5 nodes of anything.

Defined results: a null field is `-`; a null group is a group of its own, the first; rows with a null id come first in their group and are never
tampered with; rows that share an id are ordered by leaf, and repeated rows have equal leaves, each with its own place and proof. An empty text is `0:`. A
very long text is hashed as one value where it lies, and only its digest moves. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.llm import common

#: Children of a node; levels that one round reduces; nodes that the driver takes.
ARITY, LEVELS, TOP = 3, 5, 4096
BLOCK = ARITY**LEVELS

_PATH = "array<struct<l:string,r:string>>"


def digest(*fields: Column) -> Column:
    """SHA-256 in hex of the fields, each `-` if null, else UTF-8 byte count, `:` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def leaf(text: Column) -> Column:
    """The leaf of a row of documents with this text."""
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def proof(path: Column) -> Column:
    """One digest of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.l, s.r)), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s.l, h, s.r), 256))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (with a column grp) and their place `pos` in the group by `order`, and the group's size `n`."""
    at = common.stored(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = at.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    group = Window.partitionBy("grp")
    before = F.sum("k").over(group.orderBy("part")) - F.col("k")
    runs = runs.select(F.col("grp").alias("g"), "part", (before - F.col("first")).alias("shift"), F.sum("k").over(group).alias("n"))
    joined = at.join(runs, at.grp.eqNullSafe(runs.g) & (part == runs.part))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _depth(n: Column) -> Column:
    """Levels that a block of a group of n nodes is reduced by."""
    return reduce(lambda rest, d: F.when(n <= ARITY**d, d).otherwise(rest), range(LEVELS - 1, -1, -1), F.lit(LEVELS))


def _above(xs: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(xs, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """grp, block, n, members by place, the block's levels l0.. and its root, written: 3**5 nodes to a row at most."""
    own = [c for c in nodes.columns if c not in ("grp", "pos", "n")]
    out = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *own))).alias("members"), F.max("n").alias("n"))
    out = out.withColumn("d", _depth(F.col("n"))).withColumn("l0", F.col("members.leaf"))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("d") > k, _above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return common.stored(out.withColumn("root", F.element_at(f"l{LEVELS}", 1)))


def _own_path(i: Column) -> Column:
    """Siblings of member i of a block, level by level."""
    steps = []
    for k in range(LEVELS):
        nodes, at = F.col(f"l{k}"), F.floor(i / ARITY**k).cast("int")
        first = at - at % ARITY
        steps.append(F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("l"), F.array_join(F.slice(nodes, at + 2, first + ARITY - 1 - at), "").alias("r")))
    return F.slice(F.array(*steps), F.lit(1), F.col("d"))


def _below(blocks: DataFrame, upper: DataFrame, own: list[str]) -> DataFrame:
    """Members of the blocks with their whole paths; `upper` has those of the blocks."""
    up = upper.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), F.col("path").alias("up_path"), "subroot", F.col("root").alias("up_root"))
    both = blocks.join(up, blocks.grp.eqNullSafe(up.up_grp) & (blocks.block == up.up_pos))
    rows = F.transform("members", lambda m, i: F.struct(m.pos.alias("pos"), *[m[c].alias(c) for c in own], F.concat(_own_path(i), F.col("up_path")).alias("path")))
    return both.select("grp", F.explode(rows).alias("x"), "subroot", F.col("up_root").alias("root")).select("grp", "x.*", "subroot", "root")


def _steps(level: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Siblings of each node of a level, and the level above."""
    runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
    sides = [("".join(run[:j]), "".join(run[j + 1 :])) for run in runs for j in range(len(run))]
    return sides, [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]


def _tree(leaves: list[str]) -> tuple[list[list[tuple[str, str]]], str]:
    """Paths of the leaves of one tree, and its root."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        sides, level = _steps(level)
        for j, p in enumerate(paths):
            p.append(sides[at[j]])
            at[j] //= ARITY
    return paths, level[0]


def _top(nodes: DataFrame, grouped: bool) -> DataFrame:
    """Paths of at most TOP nodes, built on the driver; a broadcast of that many rows."""
    held: dict = {}
    for r in nodes.select("grp", "pos", "leaf").collect():
        held.setdefault(r.grp, []).append((r.pos, r.leaf))
    order = sorted(held, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([h for _, h in sorted(held[g])]) for g in order}
    upper, root = _tree([trees[g][1] for g in order]) if order else ([], None)
    rows = [(g, pos, path + upper[k], trees[g][1] if grouped else None, root) for k, g in enumerate(order) for (pos, _), path in zip(sorted(held[g]), trees[g][0], strict=True)]
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, f"grp string, pos long, path {_PATH}, subroot string, root string"))


def _upper(nodes: DataFrame, grouped: bool = True, top: int = TOP) -> DataFrame:
    """grp, pos, path, subroot, root of nodes (grp, pos, n, leaf). While `grouped`, the nodes are of trees of groups; later, of the tree over them."""
    size = nodes.agg(F.count("*").alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if size["all"] <= top:
        return _top(nodes, grouped)
    if size["most"] > 1:
        blocks = _blocks(nodes)
        upper = _upper(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("leaf")), grouped, top)
        return _below(blocks, upper, [])
    # One node is left of each of many groups: the tree over them is reduced in the same way.
    roots = placed(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("own_grp"), "leaf"), "own_grp")
    blocks = _blocks(roots)
    upper = _upper(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("leaf")), False, top)
    done = _below(blocks, upper, ["own_grp", "leaf"])
    return done.select(F.col("own_grp").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("leaf").alias("subroot"), "root")


def manifest(leaves: DataFrame, top: int = TOP) -> DataFrame:
    """`leaves` (id, grp as text, leaf, other columns) with each row's path, its group's root `subroot`, and `root`. Read more than once: give a table."""
    nodes = placed(leaves, "id", "leaf")
    own = [c for c in leaves.columns if c != "grp"]
    blocks = _blocks(nodes)
    upper = _upper(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("leaf")), True, top)
    return _below(blocks, upper, own)


def leaves_of(docs: DataFrame) -> DataFrame:
    """id, grp, leaf of every row, and `changed`: its leaf after tampering, null where it is not tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").cast("string").alias("grp"), leaf(F.col("text")).alias("leaf"),
        F.when(tampered, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("changed"),
    )


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    rows = manifest(common.stored(leaves_of(common.table(spark, sf_dir, "documents"))))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 14) -> str:
    """The same in SQL, level by level: enough levels for 3**14 leaves of a group and as many groups."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_sql = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [f"""
WITH bits AS (SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, source, {leaf_sql("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents LEFT JOIN bits USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
a0 AS (SELECT source, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM r)"""]
    for k in range(levels):
        parts.append(f"a{k + 1} AS (SELECT source, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, CAST(ceil(max(n) / 3) AS BIGINT) AS n FROM a{k} GROUP BY source, pos // 3)")
    parts.append(f"b0 AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, source, h, count(*) OVER () AS n FROM a{levels})")
    for k in range(levels):
        parts.append(f"b{k + 1} AS (SELECT pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, CAST(ceil(max(n) / 3) AS BIGINT) AS n FROM b{k} GROUP BY pos // 3)")
    sides = "coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r"
    steps = [f"SELECT x.source, x.pos, {k} AS lv, {sides} FROM a{k} x JOIN a{k} y ON x.source IS NOT DISTINCT FROM y.source AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.source, x.pos" for k in range(levels)]
    tops = [f"SELECT x.pos, {levels + k} AS lv, {sides} FROM b{k} x JOIN b{k} y ON x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.pos" for k in range(levels)]
    parts.append("sa AS (" + " UNION ALL ".join(steps) + ")")
    parts.append("sb AS (" + " UNION ALL ".join(tops) + ")")
    place = "CASE s.lv " + " ".join(f"WHEN {k} THEN r.pos // {ARITY**k}" for k in range(levels)) + " END"
    high = "CASE s.lv " + " ".join(f"WHEN {levels + k} THEN b.pos // {ARITY**k}" for k in range(levels)) + " END"
    parts.append(f"""p AS (SELECT r.source, r.pos, s.lv, s.l, s.r FROM r JOIN sa s ON r.source IS NOT DISTINCT FROM s.source AND s.pos = {place}
  UNION ALL SELECT r.source, r.pos, s.lv, s.l, s.r FROM r JOIN b0 b ON r.source IS NOT DISTINCT FROM b.source JOIN sb s ON s.pos = {high}),
q AS (SELECT source, pos, string_agg(l || r, '' ORDER BY lv) AS joined, list(l ORDER BY lv) AS ls, list(r ORDER BY lv) AS rs FROM p GROUP BY source, pos),
f AS (SELECT r.doc_id, r.leaf, b.h AS subroot, (SELECT h FROM b{levels}) AS root, sha256(coalesce(q.joined, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(r.changed, r.leaf), list_transform(range(1, len(coalesce(ls, [])) + 1), lambda i: ls[i] || '/' || rs[i])),
    lambda h, s: sha256(split_part(s, '/', 1) || h || split_part(s, '/', 2))) AS folded_root
  FROM r JOIN b0 b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.pos = q.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f""")
    return ",\n".join(parts)


OP13_SQL = _sql()
