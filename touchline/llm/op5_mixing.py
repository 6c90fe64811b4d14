"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. A source's target is its share of all words by weight, at most
MOST times its size; what is above is shared again by weight until none is above.
Each source is cut into blocks of equal words (WIDTH, less for small sources, which have
PIECES blocks or blocks of one word) in shuffled order and needs so many slots of one
block each for its target. Slot k of all goes to the source into whose stretch of the
cumulated needs the k-th golden-ratio point falls. Slots are ranked within their source,
and rank r takes block r (modulo the source's blocks). The points miss a source's need by
a few slots at most: surplus ranks are given back, missing ones are dealt last, and
the last rank takes only the words that are missing, so each source takes its
target to the word. A document's `taken` is the words of its text in the taken blocks,
repeats counted; its slots are those of the block that its text begins in, so reading
documents by slot has every source near its share in any beginning of the sequence.

The number of slots grows with the words. A source's words in shuffled order are
numbered by sums over hash ranges, then within each range, and ranks by sums over slot
ranges, then within each, so a hot source is spread over many tasks. Documents meet
blocks in an equi-join. Reruns agree: order is by md5 of the id. Sources have one row
each in small tables.

Defined results: null text has size 0; a null source is one more source, last by
code point; documents of size 0 take 0 and have no slot; repeated rows are documents of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import Words, blocks, checked, flat, staged, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, and blocks that a smaller source has at least (if it has as many words).
WIDTH = 4096
PIECES = 1000
#: Slot k stands at k * GOLDEN modulo CIRCLE, which is 2**40; GOLDEN is that divided by the golden ratio.
CIRCLE = 1 << 40
GOLDEN = round(CIRCLE * 2 / (1 + 5**0.5)) | 1
#: Hexadecimal digits of the md5 order's ranges that a source's documents are numbered in.
RANGE_DIGITS = 4
_COARSE = 26


@F.arrow_udf(T.LongType())
def word_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Runs of characters that are not ASCII white space."""
    for texts in batches:
        b, offsets = flat(texts)
        yield pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(Words(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).before) for i, j in blocks(offsets))]))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with sid, weight, target. One row a source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(w))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    rows = rows.withColumn("words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("capped", left * F.col("weight") > F.col("cap") * open_weight)
    fixed, held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    level = (F.col("words") - fixed) / F.greatest(F.col("all_weight") - held, F.lit(1))
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return rows.select("source", "sid", "source_size", "weight", "words", "target")


def stretches(goals: DataFrame, width: int = WIDTH, pieces: int = PIECES) -> DataFrame:
    """With block (words of a block), blocks (of the source), need (slots), cut (words that the last of them takes), and the source's stretch [low, high) of the circle."""
    rows = goals.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.col("source_size") / pieces))).cast("long"))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    goal, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    rows = rows.withColumn("rest", goal % size).withColumn("rounds", ((goal - F.col("rest")) / size).cast("long"))
    rows = rows.withColumn("need", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block")))
    rows = rows.withColumn("cut", F.when(F.col("rest") > 0, (F.col("rest") - 1) % F.col("block") + 1).otherwise(F.col("block")))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("need").over(upto)).withColumn("total", F.greatest(F.sum("need").over(Window.partitionBy()), F.lit(1)))
    point = lambda c: F.floor(c / F.col("total") * float(CIRCLE)).cast("long")
    return rows.withColumn("low", point(F.col("upto") - F.col("need"))).withColumn("high", point(F.col("upto"))).drop("upto", "total", "rest", "rounds")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo CIRCLE in two steps that stay within 64 bits, for slots below 2**40."""
    part = 1 << 20
    high = (F.floor(slot / part).cast("long") * GOLDEN) % CIRCLE
    return (high * part + (slot % part) * GOLDEN) % CIRCLE


def schedule(plan: DataFrame) -> DataFrame:
    """slot, sid, rank (from 0), number (of the block). The circle is cut coarsely for an equi-join, then by the stretches."""
    total = plan.agg(F.sum("need")).head()[0] or 0
    slots = plan.sparkSession.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("coarse", F.shiftright("u", _COARSE))
    parts = plan.filter("high > low").select("sid", "low", "high", F.explode(F.sequence(F.shiftright("low", _COARSE), F.shiftright(F.col("high") - 1, _COARSE))).alias("coarse"))
    dealt = slots.join(parts, "coarse").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "sid")
    # Ranks: slots before in the range, and of the ranges before.
    dealt = dealt.withColumn("range", F.floor(F.col("slot") / max(1, math.isqrt(total))))
    counts = dealt.groupBy("sid", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("sid", "range").orderBy("slot")) - 1
    ranked = dealt.withColumn("inner", inner).join(bases, ["sid", "range"]).select("slot", "sid", (F.col("base") + F.col("inner")).alias("rank"))
    got = plan.select("sid", "need").join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = got.filter("got < need").select(F.lit(total).cast("long").alias("slot"), "sid", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    kept = ranked.unionByName(late).join(plan.select("sid", "need", "blocks"), "sid").filter(F.col("rank") < F.col("need"))
    return kept.select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("number"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (row_id, doc_id, sid, size) with `at`: the words of the source before the document in shuffled order."""
    rows = rows.withColumn("h", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("range", F.conv(F.substring("h", 1, RANGE_DIGITS), 16, 10).cast("int"))
    sums = rows.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("sid", "range").orderBy("h", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.join(sums, ["sid", "range"]).withColumn("at", F.col("base") + F.col("inner")).drop("h", "range", "base", "inner")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, width: int = WIDTH, pieces: int = PIECES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slots (ascending; of a block at most one a round, so at most `most` + 1) and first_slot."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    rows = staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    plan = staged(stretches(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), width, pieces), "targets")
    rows = rows.join(checked(plan.select("source", "sid", "source_size", "target", "block")), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    slots = schedule(plan).join(plan.select("sid", "need", "cut"), "sid")
    last = F.col("rank") == F.col("need") - 1
    uses = slots.groupBy("sid", "number").agg(F.sum(F.when(last, 0).otherwise(1)).alias("uses"), F.max(F.when(last, F.col("cut")).otherwise(0)).alias("more"), F.sort_array(F.collect_list("slot")).alias("slots"))
    # A document's blocks: overlap times uses, and what lies in the first words that the last slot takes.
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))).otherwise(F.array(F.lit(-1).cast("long")))
    each = numbered(rows).withColumn("number", F.explode(numbers)).join(uses, ["sid", "number"], "left")
    begin = F.col("number") * F.col("block")
    low, high = F.greatest("at", begin), F.least(F.col("at") + F.col("size"), begin + F.col("block"))
    part = (high - low) * F.coalesce("uses", F.lit(0)) + F.greatest(F.least(high, begin + F.coalesce("more", F.lit(0))) - low, F.lit(0))
    part = F.when(F.col("size") > 0, part).otherwise(0)
    begins = (F.col("size") > 0) & (F.col("number") == F.floor(F.col("at") / F.col("block")))
    out = each.groupBy("row_id", "doc_id", "source", "size", "source_size", "target").agg(F.sum(part).cast("long").alias("taken"), F.first(F.when(begins, F.col("slots")), ignorenulls=True).alias("slots"))
    return out.drop("row_id").withColumn("first_slot", F.try_element_at("slots", F.lit(1)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def in_schedule_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix reads them: with column slot, range-partitioned and sorted by it; a document in several rounds has a row in each, one without words or slot comes last.

    Equal ids take the slots of the one that comes first.
    """
    got = mixed(docs, id_col, text_col, source_col).groupBy("doc_id").agg(F.min("slots").alias("slots"), F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    # Rounds beyond the slots of its first block repeat the last of them.
    slot = lambda i: F.try_element_at("slots", F.least(i + 1, F.greatest(F.size("slots"), F.lit(1))))
    copies = staged(got.select(F.col("doc_id").alias("_id"), F.explode(F.transform(F.array_repeat(F.lit(0), times), lambda x, i: slot(i))).alias("slot")), "slots")
    return docs.join(copies, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id").repartitionByRange(F.col("slot").asc_nulls_last()).sortWithinPartitions(F.col("slot").asc_nulls_last(), id_col)


def remixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it (words taken by words, to the nearest whole number); documents without words stay as they are. Rows stay in place: where order matters, use in_schedule_order()."""
    got = mixed(docs, id_col, text_col, source_col)
    got = got.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    counts = staged(got.select(F.col("doc_id").alias("_id"), times.alias("_times")), "times")
    out = docs.join(checked(counts), F.col(id_col).eqNullSafe(F.col("_id")))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*docs.columns)


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s
), g AS (
  SELECT source, source_size, sid, [5, 2, 1][(sid - 1) % 3 + 1]::BIGINT AS weight, {MOST} * source_size AS cap FROM w
), o AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS words, (sum(weight) OVER ())::BIGINT AS all_weight,
         coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
  FROM g WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, (words - cap_before) * weight > cap * (all_weight - weight_before) AS capped FROM o
), l AS (
  SELECT any_value(words - f) / any_value(greatest(all_weight - h, 1)) AS level
  FROM (SELECT words, all_weight, (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS f, (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::BIGINT AS h FROM c)
), t AS (
  SELECT source, sid, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * weight END AS target FROM c, l
), e AS (
  SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS rounds, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t
), b AS (
  SELECT *, greatest(1, least({WIDTH}, source_size // {PIECES})) AS block FROM e
), p AS (
  SELECT sid, block, (source_size + block - 1) // block AS blocks, rounds * ((source_size + block - 1) // block) + (rest + block - 1) // block AS need FROM b
), q AS (
  SELECT *, (sum(need) OVER (ORDER BY sid))::BIGINT AS upto, greatest((sum(need) OVER ())::BIGINT, 1) AS total FROM p
), st AS (
  SELECT *, floor((upto - need)::DOUBLE / total * {CIRCLE}::DOUBLE)::BIGINT AS low, floor(upto::DOUBLE / total * {CIRCLE}::DOUBLE)::BIGINT AS high FROM q
), k AS (
  SELECT slot, ((slot::HUGEINT * {GOLDEN}) % {CIRCLE})::BIGINT AS u FROM (SELECT unnest(range((SELECT sum(need)::BIGINT FROM p))) AS slot)
), a AS (
  SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM k JOIN st ON u >= low AND u < high
), x AS (
  SELECT sid, slot, rank FROM a
  UNION ALL SELECT sid, total AS slot, unnest(range(coalesce(got, 0), need)) AS rank FROM st LEFT JOIN (SELECT sid, count(*) AS got FROM a GROUP BY sid) USING (sid)
), y AS (
  SELECT sid, block, rank % blocks AS number, min(slot) AS first_slot FROM x JOIN st USING (sid) WHERE rank < need GROUP BY ALL
), n AS (
  SELECT d.doc_id, d.size, e.sid, e.source_size, e.target, e.rounds, e.rest,
         sum(d.size) OVER (PARTITION BY e.sid ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.r) - d.size AS pos
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (rounds * size + least(pos + size, rest) - least(pos, rest))::BIGINT AS taken, first_slot
FROM n LEFT JOIN y ON size > 0 AND y.sid = n.sid AND y.number = pos // y.block
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": ORACLE}
