"""Bounded, deterministic samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label, weight, text of about per_class rows of each class, all of smaller classes.

    Rows of the held-out fold (crc32 of the id as text modulo `folds` equal to `held`)
    are never read as labels. A hash of the id picks the rows, so reruns agree; the
    weight is the class's rows for each row kept. Null labels do not count.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, folds) != held))
    known = known.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label")).distinct()
    sizes = known.groupBy("label").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("n"))
    picked = known.join(F.broadcast(sizes), "label").filter(draw < share).select("_id", "label", (1.0 / share).alias("weight"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "_id").select("_id", "label", "weight", "text")
