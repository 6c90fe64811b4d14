"""Exact deduplication with a heavy-hitter split (native).

Texts are equal when identical after lower-casing A-Z only; of equal texts the
row with the largest doc_id stays. Misra-Gries counters (freqItems) name the few
digests that may be frequent; their winners are verified by an exact count and
broadcast, so rows of hot groups are settled on the map side and never shuffled.
The other digests take the ordinary shuffle.

Defined results: null text counts as empty (all empty texts are one group); a
null doc_id loses to any other; of rows that repeat both doc_id and text one
stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import ascii_lower, checked, fits, staged, table

#: Digests of at least this share of all rows are surely found; at most 1 / SUPPORT are broadcast.
SUPPORT = 0.01


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id, text_sha256 of every row, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(ascii_lower(text).cast("binary"), 256)
    return staged(docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256")).withColumn("row_id", F.monotonically_increasing_id()), "digests")


def winners(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "row_id"))
    return rows.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    rows = digests(docs, id_col, text_col)
    frequent = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    verified = winners(rows.join(F.broadcast(frequent), "text_sha256", "left_semi"))
    verified = staged(verified.filter(F.col("group_size") >= max(2, rows.count() * support)), "winners")
    marked = rows.join(F.broadcast(verified), "text_sha256", "left")
    hot = marked.filter(F.col("best").isNotNull())
    rest = rows.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.join(winners(rest), "text_sha256")
    out = hot.select(*rest.columns).unionByName(rest)
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops. Only ids move; the texts stay where they are if the dropped ids fit a broadcast."""
    found = staged(exact_dedup(docs, id_col, text_col), "dedup")
    lost = found.groupBy("doc_id", "text_sha256").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("copies"))
    lost = staged(lost.filter((F.col("kept") == 0) | (F.col("copies") > 1)), "lost")
    drop = lost.filter("kept = 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    keyed = docs.withColumn("_sha", sha)
    out = keyed.join(checked(drop.withColumnRenamed("_sha", "_gone")), (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col("_sha") == F.col("_gone")), "left_anti")
    again = lost.filter("kept = 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_gone"))
    if not fits(again, 0):  # rows that repeat doc_id and text: one of each stays
        again = staged(again, "again")
        same = (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col("_sha") == F.col("_gone"))
        one = out.join(checked(again), same, "left_semi").dropDuplicates([id_col, "_sha"])
        out = out.join(checked(again), same, "left_anti").unionByName(one)
    return out.select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": ORACLE}
