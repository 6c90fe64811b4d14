"""Trie of conversation prefixes, rolled up by bands of depth.

Turns get their place in a conversation by one range sort of all turns, so a long
conversation spreads over tasks; conversations then borrow the first turns of their base.
A prefix is known by two 64-bit sums (exclusive or) of hashes of its turns with their
places, which are summed in blocks and carried from block to block. One group-by makes the nodes.

Sums over subtrees go by bands of BAND depths. A node adds its value to its ancestors
within its band only; what lies below the last depth of a band is summed for that band
root first. Band roots are a tree of their own, a BAND-th as deep, so the same step rolls
them up (bands of bands): the rounds grow with the logarithm of the depth, and no node
is ever repeated more than BAND times a level.

The digest of the conversations that end at a node reads their numbers in order. They are
joined to texts of up to CHUNK numbers in parallel by a range sort; then each node's texts
stream through its hash, one batch at a time, so a node where many conversations end holds no
list of them.

Defined results: rows without conv_id belong to no conversation; null role or text is
empty; null turns come first; turns of equal number are ordered by role and text (equal
rows are turns of their own); an empty table gives no nodes, not even a root; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import checked, release, staged, table

#: Depths of a band.
BAND = 16
#: Turns whose hashes one window sums; a multiple of BAND.
BLOCK = 1024
#: Nodes of more children are wide: their rows are broadcast to their children, if few enough.
WIDE = 1000
#: Numbers in one text of a node's digest.
CHUNK = 4096
#: Conversations of one base, and the turns they may borrow, less one.
FAMILY, BORROWED = 5, 9
KEY = ["p1", "p2"]


# ---------------------------------------------------------------- turns

def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With this task's number and each row's place among the task's rows of its conversation; rows come sorted."""
    last, n, part = None, 0, TaskContext.get().partitionId()
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(conv)), 0))
        place = np.arange(len(conv)) - start
        if conv[0] == last:
            place[start == 0] += n
        last, n = conv[-1], int(place[-1]) + 1
        yield pa.record_batch([*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())], [*b.schema.names, "place", "part"])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), x1, x2 (hashes of role and text), bytes of the text. Staged."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.xxhash64(F.lit(1), "role", "text").alias("x1"), F.xxhash64(F.lit(2), "role", "text").alias("x2"), F.octet_length("text").cast("long").alias("bytes"))
    turns = staged(rows.mapInArrow(_places, "conv_id long, x1 long, x2 long, bytes long, place long, part int"), "turns")
    # Only the first conversation of a task can go on from an earlier one, so there are at most as many of these as tasks.
    cut = turns.groupBy("part").agg(F.min("conv_id").alias("conv_id")).select("conv_id").distinct()
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(w)).filter("before > 0").select("conv_id", "part", "before")
    out = turns.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "x1", "x2", "bytes")
    out.staged_path = turns.staged_path
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, d from 1, x1, x2, bytes, total), and conversations without turns (conv_id).

    What a turn must know of its conversation is joined by conversation and block, so that a long one is no hot key.
    """
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = F.col("conv_id") % FAMILY == 0
    h = F.when(own, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("long")
    known = size.select("conv_id", "n", base.alias("base"), h.alias("h")).join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    known = known.withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = staged(known.select("conv_id", "base", "n", "h", "lent", "total"), "known")
    blocks = known.select("conv_id", "h", "lent", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("b"))
    kept = turns.withColumn("b", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv_id", "b"]).filter(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("d"), "x1", "x2", "bytes", "total")
    heads = turns.filter((F.col("pos") < BORROWED - 1) & own).select(F.col("conv_id").alias("base"), "pos", "x1", "x2", "bytes")
    lent = known.filter("lent > 0").join(heads, "base").filter(F.col("pos") < F.col("lent")).select("conv_id", (F.col("pos") + 1).alias("d"), "x1", "x2", "bytes", "total")
    none = known.filter("total = 0").select("conv_id")
    none.staged_path = known.staged_path
    return staged(kept.unionByName(lent), "rebuilt"), none


def paths(turns: DataFrame) -> DataFrame:
    """For each rebuilt turn the key (p1, p2) of the prefix that ends with it and of its parent (q1, q2). Staged."""
    rows = turns.select("conv_id", "d", "bytes", "total", F.expr(f"(d - 1) div {BLOCK}").alias("b"), F.xxhash64("x1", "d").alias("y1"), F.xxhash64("x2", "d").alias("y2"))
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.filter(F.col("total") > BLOCK).groupBy("conv_id", "b").agg(F.bit_xor("y1").alias("y1"), F.bit_xor("y2").alias("y2"))
    carried = long.select("conv_id", "b", F.bit_xor("y1").over(before).alias("o1"), F.bit_xor("y2").over(before).alias("o2")).filter("b > 0")
    w = Window.partitionBy("conv_id", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("y1").over(w).alias("l1"), F.bit_xor("y2").over(w).alias("l2")).join(carried, ["conv_id", "b"], "left")
    for k in "12":
        rows = rows.withColumn(f"p{k}", F.col(f"l{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0)))).withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"y{k}")))
    return staged(rows.select("conv_id", "d", "bytes", "p1", "p2", "q1", "q2", (F.col("d") == F.col("total")).alias("ends")), "paths")


# ---------------------------------------------------------------- bands

def rollup(ways: DataFrame, values: DataFrame, deepest: int, of: list[str]) -> DataFrame:
    """p1, p2 and the sums of the columns `of` over each node's subtree.

    ways: conv_id, d (from 1 without gaps), p1, p2, q1, q2 (the row before, or the root); values: one row for each node, by a conversation through it: conv_id, d, `of`.
    """
    key, root = F.struct(*KEY), F.struct(F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    w = Window.partitionBy("conv_id", "band").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    up = ways.withColumn("band", F.expr(f"(d - 1) div {BAND}")).select("conv_id", "d", F.first(root).over(w).alias("top"), F.collect_list(key).over(w).alias("up"))
    nodes = staged(values.join(up, ["conv_id", "d"]), "band")
    sums = [F.sum(c).alias(c) for c in of]
    done = [nodes]
    if deepest > BAND:
        # Below each band root, in its own band; then the band roots as a tree.
        below = nodes.groupBy("top").agg(*sums)
        roots = ways.filter(F.col("d") % BAND == 0).join(up.select("conv_id", "d", "top"), ["conv_id", "d"])
        roots = staged(roots.select("conv_id", F.expr(f"d div {BAND}").alias("d"), *KEY, F.col("top.p1").alias("q1"), F.col("top.p2").alias("q2")), "roots")
        ends = nodes.filter(F.col("d") % BAND == 0).select("conv_id", "d", F.element_at("up", -1).alias("top"))
        held = staged(ends.join(below, "top", "left").select(F.expr(f"d div {BAND}").alias("d"), "conv_id", "top", *[F.coalesce(c, F.lit(0)).alias(c) for c in of]), "held")
        deep = rollup(roots, held.drop("top"), deepest // BAND, of)
        full = ends.join(deep.select(F.struct(*KEY).alias("top"), *of), "top", "left").select("conv_id", "d", *[F.coalesce(c, F.lit(0)).alias(f"_{c}") for c in of])
        added = nodes.filter(F.col("d") % BAND == 0).join(full, ["conv_id", "d"]).select("conv_id", "d", "top", "up", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in of])
        nodes = nodes.filter(F.col("d") % BAND > 0).unionByName(added.select(nodes.columns))
        done += [roots, held]
    total = nodes.select(F.explode("up").alias("node"), *of).groupBy("node").agg(*sums)
    out = staged(total.select("node.p1", "node.p2", *of), "totals")
    release(*done)
    return out


# ---------------------------------------------------------------- digests

def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, conv_id) -> the numbers of a node as comma-joined texts of at most CHUNK numbers, with their first number."""
    for b in batches:
        p1, p2, conv = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        if not len(conv):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]))
        cuts = np.unique(np.concatenate([cuts, np.arange(0, len(conv), CHUNK)]))
        ends = [*cuts[1:], len(conv)]
        words = [str(x) for x in conv.tolist()]
        yield pa.record_batch([pa.array(p1[cuts]), pa.array(p2[cuts]), pa.array(conv[cuts]), pa.array([",".join(words[i:j]) for i, j in zip(cuts, ends)], pa.string())], ["p1", "p2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, first, ids) -> SHA-256 of a node's texts, joined by commas; only the hash's state is held."""
    node, state = None, None
    for b in batches:
        out = []
        for p1, p2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if (p1, p2) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.record_batch([pa.array(list(x), kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["p1", "p2", "sha"])
    if node is not None:
        yield pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["p1", "p2", "sha"])


def digests(ends: DataFrame) -> DataFrame:
    """p1, p2, conv_id -> p1, p2, sha: of the decimal numbers in numeric order."""
    order = [*KEY, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_texts, "p1 long, p2 long, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "p1 long, p2 long, sha string")


# ---------------------------------------------------------------- trie

def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: see the module."""
    turns = placed_turns(conversations)
    built, none = rebuilt(turns)
    way = paths(built)
    release(turns, built)
    found = way.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("d").alias("d"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    # The root is the one node without a turn; it has the key (0, 0).
    all_convs = way.filter("d = 1").select("conv_id").unionByName(none)
    root = all_convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "n_convs", "conv_id", *[F.lit(v).cast("long").alias(c) for c, v in (("d", 0), ("bytes", 0), ("q1", None), ("q2", None))])
    found = staged(found.unionByName(root.select(found.columns)), "found")
    children = found.filter("d > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, KEY, "left").fillna(0, ["n_children"])
    nodes = staged(nodes.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "nodes")
    of = ["n_leaves", "saved_tokens"]
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    totals = rollup(way.select("conv_id", "d", *KEY, "q1", "q2"), nodes.filter("d > 0").select("conv_id", "d", *of), deepest, of)
    # The root's sums are those of its children, or it is a leaf itself.
    top = nodes.filter("d = 1").select(*KEY).join(totals, KEY).agg(*[F.sum(c).alias(c) for c in of]).select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    sha = digests(way.filter("ends").select(*KEY, "conv_id").unionByName(none.select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id")))
    parent = nodes.filter("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    full = nodes.drop(*of).join(totals.unionByName(top), KEY).join(sha, KEY, "left")
    wide, few = checked(parent.filter(F.col("n_children") > WIDE).drop("n_children")), parent.filter(F.col("n_children") <= WIDE).drop("n_children")
    # Children of wide nodes meet them by broadcast; the others have at most WIDE children a key.
    full = full.join(wide, ["q1", "q2"], "left")
    met = full.filter("parent_conv_id IS NULL AND d > 0").drop("parent_conv_id").join(few, ["q1", "q2"])
    full = full.filter("parent_conv_id IS NOT NULL OR d = 0").unionByName(met.select(full.columns))
    return full.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", *of, F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, count(*) AS n, CASE WHEN conv_id % {FAMILY} = 0 THEN 0 ELSE xor({_CRC}, 4294967295) % {BORROWED} END AS h FROM t GROUP BY conv_id),
i AS (SELECT k.*, least(k.h, coalesce(b.n, 0)) AS lent FROM k LEFT JOIN k b ON b.conv_id = k.base),
r AS (
  SELECT i.conv_id, pos - h + lent + 1 AS d, role, text FROM t JOIN i USING (conv_id) WHERE pos >= h
  UNION ALL SELECT i.conv_id, pos + 1, role, text FROM t JOIN i ON t.conv_id = i.base WHERE pos < lent),
p AS (SELECT conv_id, d, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY d) AS way FROM r UNION ALL SELECT conv_id, 0, '', [] FROM k),
n AS (SELECT way, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(octet_length(encode(text))) AS saved FROM p GROUP BY way, d),
c AS (SELECT way[:-2] AS way, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN c USING (way)),
s AS (SELECT p.way, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.way),
e AS (SELECT way, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, way FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY way)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM v JOIN s USING (way) LEFT JOIN e USING (way) LEFT JOIN n q ON v.d > 0 AND q.way = v.way[:-2]"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}
