"""Similarity join of documents on distinct word shingles (Jaccard) and its components.

Multiple-global-order prefix filtering. If a set of n shingles shares t*n or more
with another, then of its first n - ceil(t*n) + l shingles under any global order
it shares l or more with the other's (l: a tenth of the smaller set, 1 at least).

* Order 1 gives the candidates: shingles are ordered by a hash of their anchor (the
  lesser hash of a shingle without its last or first word), so that neighbouring
  shingles come together, and a set emits each anchor of its prefix once, with the
  number of its shingles there. Anchors of one set only are dropped after a count, then
  sets whose shared anchors do not hold l shingles.
* Order 2 puts rare anchors first. It is made for the sets that order 1 leaves open,
  from counts of all their anchors, and drops those of which less than t*n can be
  shared with anyone. Each row keeps its place: a pair whose first common anchor stands
  at places i and j shares min(n - i, m - j) at most, which must reach what its sizes
  need. Anchors that are late in a set can therefore meet smaller sets only, and
  rows are joined by anchor and band of sizes. What is still open then is ordered once
  more by single shingles in place of anchors.
* Orders 3 and 4 (other hashes of the shingles): narrow prefixes, which must both have a
  common token, are joined to the candidate pairs first; only sets of pairs that pass
  all orders are moved and compared.

Texts with equal sets are one class and emit once. Under each anchor a class is first
paired with one class only (a star, so hot anchors give as many pairs as rows), the
most central one, whose shingles are in most other sets; most groups come together
that way, under order 1 and then under order 2. Last come all pairs under order 2 that can
still be similar and of which one at least is outside the component of the anchor's
pivot.

A document's links end in components: component_id is the smallest doc_id reachable.

Defined results: null texts and texts without words have no shingles and stand
alone; texts of fewer words than a shingle are one shingle; rows that share a
doc_id are one node, whatever their texts; rows without a doc_id link nothing, but get
the component of an equal set; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import Words, blocks, checked, flat, fold_ascii, grams, mix, release, staged, table

WORDS = 5
#: Similarity in hundredths.
LEAST = 80
#: Sizes of a band differ by this factor at most.
BAND = 1.05
_SHORT = np.uint64(0xA0761D6478BD642F)
_ORDERS = [np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)]


#: Shingles that two prefixes share at least: one for each so many of the smaller set, and one at least.
PER_SHARED = 10


def prefix_length(n: int, least: int = LEAST, more: int = 1) -> int:
    return n - (least * n + 99) // 100 + more


def shared_least(n: int) -> int:
    return max(1, n // PER_SHARED)


def shingles(b: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row: its distinct shingles in order 1, and their anchors."""
    w = Words(fold_ascii(b), offsets)
    h = w.hashes()
    shingle = grams(h, words)
    short = grams(h, words - 1)
    anchor = np.minimum(short[: len(shingle)], short[1 : len(shingle) + 1])
    # Order 1: 24 bits of the anchor, then 40 of the shingle. The value stands for the shingle.
    key = (anchor & np.uint64(0xFFFFFF0000000000)) | (shingle >> np.uint64(24))
    before = w.before
    for i in range(len(offsets) - 1):
        first, n = before[i], before[i + 1] - before[i]
        if n >= words:
            own, at = np.unique(key[first : first + n - words + 1], return_index=True)
            yield own, anchor[first : first + n - words + 1][at]
        elif n:
            one = mix(h[first : before[i + 1]] * np.arange(1, 2 * n, 2, dtype=np.uint64) + _SHORT).sum(dtype=np.uint64, keepdims=True)
            yield mix(one), mix(one)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def prefixes(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, digest of the set, anchors of the prefix in order 1 and how many of its shingles each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = flat(batch.column(1))
            for i, j in blocks(offsets):
                n, digest, held, count = [], [], [], []
                for own, anchor in shingles(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words):
                    n.append(len(own))
                    digest.append(_digest(own))
                    u, c = np.unique(anchor[: prefix_length(len(own), least, shared_least(len(own)))] if len(own) else anchor, return_counts=True)
                    held.append(u)
                    count.append(c)
                cols = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(held), _lists(count)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "anchors", "weights"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, anchors array<bigint>, weights array<int>")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """A list column: 64-bit hashes as longs, counts and 32-bit tokens as ints."""
    cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32))
    flat_rows = np.concatenate(rows)
    return pa.ListArray.from_arrays(cut, pa.array(flat_rows.view(np.int64) if flat_rows.dtype == np.uint64 else flat_rows.astype(np.int32)))


def later_prefix(own: np.ndarray, order: np.uint64, least: int = LEAST) -> np.ndarray:
    """32 bits of each shingle of the prefix under another order."""
    length = prefix_length(len(own), least) if len(own) else 0
    x = mix(own ^ order)
    if length < len(x):
        x = np.partition(x, length - 1)[:length]
    return (x >> np.uint64(3)).astype(np.uint32).view(np.int32)


def sets_of(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id and digest; all shingles as bytes of 64-bit values in order 1; all anchors and how many shingles each has; prefixes under orders 3 and 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = flat(batch.column(1))
            for i, j in blocks(offsets):
                digest, held, anchors, weights, later = [], [], [], [], [[] for _ in _ORDERS]
                for own, anchor in shingles(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words):
                    held.append(own.tobytes())
                    digest.append(_digest(own))
                    u, c = np.unique(anchor, return_counts=True)
                    anchors.append(u)
                    weights.append(c)
                    for rows, order in zip(later, _ORDERS):
                        rows.append(later_prefix(own, order, least))
                cols = [batch.column(0).slice(i, j - i), pa.array(digest, pa.binary()), pa.array(held, pa.binary()), _lists(anchors), _lists(weights), *map(_lists, later)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "held", "anchors", "weights", "third", "fourth"])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, held binary, anchors array<bigint>, weights array<int>, third array<int>, fourth array<int>")


def similar(a: bytes, b: bytes, least: int = LEAST) -> bool:
    """Whether two sets reach the similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= least * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Those pairs (a, b) that pass orders 3 and 4 and whose sets are similar. Staged."""
    pairs = staged(pairs, "pairs")
    if pairs.isEmpty():
        return pairs

    def both(pairs: DataFrame, *cols: str) -> DataFrame:
        """Pairs with these columns of either set; no other set is moved."""
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "ids")
        own = sets.select("set_id", *cols).join(checked(ids), "set_id", "left_semi")
        for k in "ab":
            pairs = pairs.join(own.select(F.col("set_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in cols]), k)
        return pairs

    narrow = both(pairs, "third", "fourth").filter(F.arrays_overlap("third_a", "third_b") & F.arrays_overlap("fourth_a", "fourth_b"))
    agreed = staged(narrow.select("a", "b"), "agreed")

    @F.arrow_udf("boolean")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(a.as_buffer(), b.as_buffer(), least) for a, b in zip(x, y)], pa.bool_())

    edges = staged(both(agreed, "held").filter(check("held_a", "held_b")).select("a", "b"), "edges")
    release(pairs, agreed)
    return edges


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its least node) of the nodes of edges (a, b). Labels spread over edges and jump to their label's label until none changes."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), label)
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), label)
    while True:
        seen = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = now.join(seen, "node").select("node", F.least("component", "m").alias("mid"), F.col("component").alias("old"))
        far = now.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = staged(new.join(far, "mid").select("node", F.least("mid", "far").alias("component"), "old"), label)
        moved = not new.filter("component <> old").isEmpty()
        now, gone = new.drop("old"), now
        if hasattr(gone, "staged_path"):
            release(gone)
        now.staged_path = new.staged_path
        if not moved:
            return now


def merged(known: DataFrame | None, more: DataFrame) -> DataFrame:
    """Components after more edges: known ones are contracted, so the loop runs over the few that the new edges join."""
    if known is None:
        return components(more)
    nodes = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
    own = nodes.join(known, "node", "left_anti").withColumn("component", F.col("node"))
    every = staged(known.select("node", "component").unionByName(own), "components")
    a, b = (every.select(F.col("node").alias(k), F.col("component").alias(f"_{k}")) for k in "ab")
    small = more.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b")
    up = components(small).select(F.col("node").alias("component"), F.col("component").alias("up"))
    return staged(every.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "components")


def _labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with the component of the set."""
    if known is None:
        return rows.withColumn("component", F.col("set_id"))
    named = known.select(F.col("node").alias("set_id"), "component")
    return rows.join(named, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _open(rows: DataFrame, turn: int) -> DataFrame:
    """Rows under anchors that still join more than one component, with the anchor's pivot: the most central set (p, its m, j, c)."""
    by = F.struct("central", F.xxhash64("set_id", F.lit(turn)))
    pivot = F.max_by(F.struct("set_id", "n", "place", "component"), by).alias("p")
    split = rows.groupBy("anchor").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pivot).filter("lo < hi")
    split = split.select("anchor", F.col("p.set_id").alias("p"), F.col("p.n").alias("m"), F.col("p.place").alias("j"), F.col("p.component").alias("c"))
    return rows.select("anchor", "set_id", "n", "place", "weight", "component").join(split, "anchor")


def _least_column(n):
    return F.greatest(F.lit(1), F.floor(n / PER_SHARED))


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose anchor has another set too, with the number of sets."""
    return rows.join(rows.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"), "anchor")


def candidates(one: DataFrame, least: int = LEAST) -> DataFrame:
    """set_id, n, place, anchor, weight, central of one row a class: all rows of order 1 that a link can need.

    A set stays if its shared anchors hold as many shingles as a link needs; central: sets that a shingle's anchor is in, on average.
    """
    rows = one.select("set_id", F.col("n_shingles").alias("n"), F.inline(F.arrays_zip("anchors", "weights"))).select("set_id", "n", F.col("anchors").alias("anchor"), F.col("weights").alias("weight"))
    rows = staged(_repeated(rows), "shared")
    need = _least_column(F.ceil(F.col("n") * least / 100))
    sets = rows.groupBy("set_id", "n").agg(F.sum("weight").alias("held"), F.sum(F.col("weight") * F.col("k")).alias("met")).filter(F.col("held") >= need).select("set_id", (F.col("met") / F.col("n")).alias("central"))
    fewer = staged(_repeated(rows.drop("k").join(sets, "set_id")).select("set_id", "n", F.lit(0).cast("long").alias("place"), "anchor", "weight", "central"), "shared")
    release(rows)
    return fewer


def anchor_rows(sets: DataFrame) -> DataFrame:
    """set_id, n, anchor, weight of all anchors of the sets."""
    rows = sets.select("set_id", (F.octet_length("held") / 8).cast("long").alias("n"), F.inline(F.arrays_zip("anchors", "weights")))
    return rows.select("set_id", "n", F.col("anchors").alias("anchor"), F.col("weights").alias("weight"))


def shingle_rows(sets: DataFrame) -> DataFrame:
    """The same of single shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                held = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(i, 256)]
                size = np.array([len(x) for x in held])
                ids = np.repeat(batch.column(0).slice(i, 256).to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(size, size)), pa.array(np.concatenate(held))], ["set_id", "n", "anchor"])

    return sets.select("set_id", "held").mapInArrow(run, "set_id bigint, n bigint, anchor bigint").withColumn("weight", F.lit(1))


def rare_first(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """set_id, n, place, anchor, weight, central: prefixes of whole sets (set_id, n, anchor, weight) in the order of their anchors' counts.

    Anchors of one set only stand before all others; their shingles are counted, not kept. The
    place of an anchor is the number of the set's shingles before it.
    """
    shared = _repeated(rows)
    own = Window.partitionBy("set_id").orderBy("k", "anchor")
    before = F.coalesce(F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held, met = F.sum("weight").over(whole), F.sum(F.col("weight") * F.col("k")).over(whole)
    placed = shared.select("*", held.alias("c"), (met / F.col("n")).alias("central"), before.alias("before")).withColumn("place", F.col("n") - F.col("c") + F.col("before"))
    return placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least / 100)).select("set_id", "n", "place", "anchor", "weight", "central")


def _can(least: int):
    """Whether sets of n and m shingles whose first common anchor has these places can share what a link needs."""
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("j"))
    return 100 * most >= least * (F.col("n") + F.col("m") - most)


def star_pairs(left: DataFrame, shared: bool, least: int = LEAST) -> DataFrame:
    """Pairs (a, b) of each set with the pivots of its anchors. shared: they must share a tenth of the smaller set."""
    pairs = left.filter((F.col("component") != F.col("c")) & _can(least))
    pairs = pairs.groupBy(F.col("p").alias("a"), F.col("set_id").alias("b"), "m", "n").agg(F.sum("weight").alias("held"))
    return pairs.filter(F.col("held") >= (_least_column(F.least("m", "n")) if shared else 1)).select("a", "b")


def _band(n):
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND)))


def rest_pairs(left: DataFrame, least: int = LEAST) -> DataFrame:
    """All pairs (a, b) of different components that can be similar; of each, one at least is outside the component of the anchor's pivot."""
    t = least / 100
    low = F.greatest(F.floor(F.col("n") * t), F.lit(1))
    high = F.ceil((F.col("n") - F.col("place")) * (1 + t) / t - F.col("n"))
    outside = left.filter((F.col("component") != F.col("c")) & (high >= low))
    outside = outside.select("anchor", F.col("set_id").alias("a"), "n", "place", F.col("component").alias("own"), F.explode(F.sequence(_band(low), _band(high))).alias("band"))
    every = left.select("anchor", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"), "component", (F.col("component") == F.col("c")).alias("inside"), _band(F.col("n")).alias("band"))
    pairs = outside.join(every, ["anchor", "band"]).filter((F.col("own") != F.col("component")) & (F.col("inside") | (F.col("a") < F.col("b"))) & _can(least))
    return pairs.select("a", "b").distinct()


def id_links(held: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components of sets that rows with one doc_id have."""
    digest = F.xxhash64("digest")
    several = staged(held.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).filter("lo < hi").select("doc_id"), "several")
    if several.isEmpty():
        return None
    own = staged(held.join(checked(several), "doc_id").join(classes.select("digest", F.col("kept").alias("b")), "digest").select("doc_id", "b").distinct(), "own")
    return components(own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a <> b").select("a", "b"))


def chosen_sets(texts: DataFrame, wanted: DataFrame, classes: DataFrame, words: int, least: int) -> DataFrame:
    """The sets of these set_ids, each once, made from a text with the class's least doc_id and its digest."""
    chosen = staged(classes.join(checked(wanted), F.col("kept") == F.col("set_id"), "left_semi").select(F.col("kept").alias("set_id"), F.col("least_id").alias("doc_id"), "digest"), "chosen")
    ids = checked(chosen.select("doc_id").distinct())
    sets = sets_of(texts.join(ids, "doc_id", "left_semi"), words, least).join(checked(chosen), ["doc_id", "digest"]).drop("doc_id", "digest")
    sets = staged(sets.withColumn("row_id", F.monotonically_increasing_id()), "sets")
    twice = sets.groupBy("set_id").agg(F.min("row_id").alias("first"), F.count("*").alias("k")).filter("k > 1")
    more = staged(sets.select("set_id", "row_id").join(twice, "set_id").filter("row_id <> first").select("row_id"), "twice")
    if more.isEmpty():
        return sets
    return staged(sets.join(checked(more), "row_id", "left_anti"), "sets")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    if words < 2:
        raise ValueError("shingles need two words at least")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = staged(prefixes(texts, words, least).withColumn("set_id", F.monotonically_increasing_id()), "prefixes")
    held = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "set_id")).alias("f")
    classes = staged(held.groupBy("digest").agg(first, F.count("*").alias("k")).select("digest", F.col("f.doc_id").alias("least_id"), F.col("f.set_id").alias("kept"), "k"), "classes")
    copies = staged(held.select("set_id", "digest").join(classes.filter("k > 1").select("digest", "kept"), "digest").filter("set_id <> kept").select("set_id"), "copies")
    rows = candidates(held.join(checked(copies), "set_id", "left_anti"), least)
    wanted = staged(rows.select("set_id").distinct(), "wanted")
    sets = chosen_sets(texts, wanted, classes, words, least)
    known = id_links(held.select("doc_id", "digest"), classes)

    def joined(pairs: DataFrame) -> DataFrame | None:
        edges = verified(pairs, sets, least)
        return known if edges.isEmpty() else merged(known, edges)

    known = joined(star_pairs(_open(_labelled(rows, known), 0), True, least))
    left = staged(_open(_labelled(rows, known), 0).select("set_id").distinct(), "left")
    release(rows, copies, wanted)
    rows = staged(rare_first(anchor_rows(sets.join(checked(left), "set_id", "left_semi")), least), "second")
    known = joined(star_pairs(_open(_labelled(rows, known), 1), False, least))
    left = staged(_open(_labelled(rows, known), 2).select("set_id").distinct(), "left")
    release(rows)
    # The few sets that are left are ordered by single shingles, which tell better what they share.
    rows = staged(rare_first(shingle_rows(sets.join(checked(left), "set_id", "left_semi")), least), "rest")
    known = joined(star_pairs(_open(_labelled(rows, known), 2), False, least))
    left = staged(_open(_labelled(rows, known), 3), "open")
    release(rows)
    known = joined(rest_pairs(left, least))
    release(left)
    if known is None:
        named = classes.select("digest", F.col("least_id").alias("component_id"))
    else:
        of = classes.join(known, F.col("kept") == F.col("node")).select("digest", "least_id", "component")
        least_ids = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = classes.join(of.join(least_ids, "component").select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id."""
    found = join_components(docs, id_col, text_col)
    lost = staged(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "lost")
    return docs.join(checked(lost), F.col(id_col) == F.col("_id"), "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES: dict[str, str] = {}
