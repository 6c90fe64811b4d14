"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of lower-cased code points (n in NGRAMS; white space
is one blank, and a blank leads the text), hashed to 2**BITS places. On a bounded sample of labelled rows each feature gets its
log-count ratio r between toxic and other texts; up to KEPT features whose presence
depends on the label beyond chance (log-likelihood ratio of at least MIN_GAIN), scaled by r, are the inputs of a logistic regression with L2 penalty. The model is
one row of a few hundred KB, broadcast; scoring is one pass without a shuffle.

Defined results: the score of a text without n-grams (null, empty, very short) is
that of the intercept; with labels of one class only, or none, every score is the
smoothed base rate; equal texts have equal scores; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import blocks, flat, release, remainder, staged, table
from touchline.llm.training import labelled_sample

NGRAMS = (4, 5, 6)
BITS = 20
#: At most 2**16.
KEPT = 1 << 15
#: Least log-likelihood ratio statistic of a feature that is kept.
MIN_GAIN = 20.0
#: Labelled rows that the fit reads: about so many of each class.
PER_CLASS = 5_000
#: Tasks that count the sample's features.
SPREAD = 8
THRESHOLD = 0.3
FOLDS, HELD = 4, 2

_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def features(b: np.ndarray, offsets: np.ndarray, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Distinct hashed n-grams of each row of a block of UTF-8 bytes."""
    points = np.frombuffer(b.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=starts[1:])
    at = starts[offsets]
    if len(points) != at[-1]:  # lower-casing changed the length: row by row
        rows = [b[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").lower() for i in range(len(offsets) - 1)]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    points = np.insert(points, at[:-1], 32)  # each row begins at a word's start
    at = at + np.arange(len(at))
    points[(points >= 9) & (points <= 13)] = 32
    shift = np.uint32(32 - bits)
    hashed = []
    h = points.copy()
    for n in range(2, max(ngrams) + 1):
        h = h[: max(0, len(points) - n + 1)] * _A + points[n - 1 :]
        if n in ngrams:
            x = (h ^ (h >> np.uint32(15))) * _B
            hashed.append((n, ((x ^ (x >> np.uint32(13))) * _A >> shift).astype(np.int32)))
    stamp = np.zeros(1 << bits, np.int32)
    for i in range(len(at) - 1):
        own = np.concatenate([g[at[i] : max(at[i], at[i + 1] - n + 1)] for n, g in hashed])
        place = np.arange(len(own), dtype=np.int32)
        stamp[own] = place
        yield own[stamp[own] == place]


def likelihood_ratio(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """G-squared of features present in p of pos and q of neg texts, against presence at one rate in both."""
    seen, n = p + q, pos + neg

    def part(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return found * np.log(np.where(found > 0, found, 1) / np.where(found > 0, expected, 1))

    return 2 * (part(p, seen * pos / n) + part(q, seen * neg / n) + part(pos - p, (n - seen) * pos / n) + part(neg - q, (n - seen) * neg / n))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> feature, p, q: texts of either label that have the feature, of this partition."""
    p, q = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        b, offsets = flat(batch.column(1))
        label = batch.column(0).to_numpy()
        for i, j in blocks(offsets):
            for k, own in enumerate(features(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):  # a text's n-grams are distinct
                (p if label[i + k] else q)[own] += 1
    found = np.flatnonzero(p + q).astype(np.int32)
    for i in range(0, len(found), 1 << 16):
        at = found[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(p[at].astype(np.int64)), pa.array(q[at].astype(np.int64))], ["feature", "p", "q"])


def chosen_features(sample: DataFrame, pos: int, neg: int, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Up to `kept` features that depend most on the label, and their log-count ratios."""

    @F.arrow_udf("double")
    def gain(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array(likelihood_ratio(p.to_numpy(), q.to_numpy(), pos, neg))

    counts = sample.select("label", "text").mapInArrow(_counted, "feature int, p bigint, q bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    best = counts.withColumn("gain", gain("p", "q")).filter(F.col("gain") >= MIN_GAIN).orderBy(F.col("gain").desc(), "feature").limit(kept).collect()
    p, q = (np.array([r[c] for r in best], float) for c in "pq")
    return np.array([r["feature"] for r in best], np.int32), np.log((p + 0.5) / pos) - np.log((q + 0.5) / neg)


def fit(label: np.ndarray, weight: np.ndarray, size: np.ndarray, of: np.ndarray, ratio: np.ndarray, steps: int = 150, l2: float = 1.0, texts: int = 256) -> tuple[float, np.ndarray]:
    """Intercept and the features' weights (log-count ratio times coefficient).

    of: places in ratio of the first text's features, then the second's, and so on; size: how
    many each text has. So many texts at a time are multiplied, which bounds what a step needs.
    """
    n, pos = len(label), label > 0
    at = np.concatenate([[0], np.cumsum(size)])
    y, c = pos.astype(float), np.where(pos, 0.5 / pos.sum(), 0.5 / (n - pos.sum())) * n
    w, bias = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        scaled, total, slope = w * ratio, np.zeros(len(ratio)), 0.0
        for i in range(0, n, texts):
            own, k = of[at[i] : at[min(i + texts, n)]], size[i : i + texts]
            z = np.bincount(np.repeat(np.arange(len(k)), k), weights=scaled[own], minlength=len(k)) + bias
            d = c[i : i + texts] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i : i + texts])
            total += np.bincount(own, weights=np.repeat(d, k), minlength=len(ratio))
            slope += d.sum()
        g = np.append((ratio * total + l2 * w) / n, slope / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    # Classes were weighed alike; the intercept goes back to the true base rate.
    bias += float(np.log((weight * pos).sum() / (weight * ~pos).sum()))
    return float(bias), (w * ratio).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = FOLDS, held: int = HELD, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    """The model. Features are counted and chosen by all tasks; one task fits the sample, of which it gets the chosen features only.

    The sample is bounded by per_class and a text has KEPT chosen features at most.
    """
    sample = staged(labelled_sample(docs, labels, label_col, folds, held, per_class, id_col, text_col).select("label", "weight", "text").repartition(SPREAD), "sample")
    classes = {r["label"]: r for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    none = np.zeros(0, np.int32), np.zeros(0, np.float32)
    if not classes:
        return 0.0, *none
    if len(classes) == 1:
        (label, only), = classes.items()
        p = (label * only["w"] + 1) / (only["w"] + 2)
        return float(np.log(p / (1 - p))), *none
    best, ratio = chosen_features(sample, classes[1]["n"], classes[0]["n"])
    sent = sample.sparkSession.sparkContext.broadcast((best, ratio))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.full(1 << BITS, -1, np.int32)
        rank[sent.value[0]] = np.arange(len(sent.value[0]), dtype=np.int32)
        for batch in batches:
            b, offsets = flat(batch.column(2))
            for i, j in blocks(offsets):
                rows = [np.sort(x[x >= 0]).astype(np.uint16).tobytes() for x in (rank[own] for own in features(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(rows, pa.binary())], ["label", "weight", "held"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((label, held, weight) for batch in batches for label, weight, held in zip(*(batch.column(k).to_pylist() for k in range(3))))
        label, weight = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        size, of = np.array([len(r[1]) // 2 for r in rows]), np.frombuffer(b"".join(r[1] for r in rows), np.uint16)
        del rows
        bias, w = fit(label, weight, size, of, sent.value[1])
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()])], ["bias", "w"])

    model = sample.mapInArrow(thinned, "label int, weight double, held binary").repartition(1).mapInArrow(fitted, "bias double, w binary").head()
    release(sample)
    return model["bias"], best, np.frombuffer(model["w"], np.float32)


def scorer(spark: SparkSession, model: tuple[float, np.ndarray, np.ndarray]):
    """A column function: text -> score between 0 and 1."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, best, weights = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[best] = weights
        for texts in batches:
            b, offsets = flat(texts)
            z = np.empty(len(texts))
            for i, j in blocks(offsets):
                for k, own in enumerate(features(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    z[i + k] = bias + np.sort(w[own]).sum(dtype=np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, FOLDS) == HELD).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
