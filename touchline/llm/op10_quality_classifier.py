"""Quality by a linear-chain conditional random field over lines.

Every line with a word is a position of the chain with two states, bad and good.
Its features are figures of the line and of both neighbours; two-by-two transition
weights tie neighbours together. The chain is trained by conditional likelihood on
a bounded sample of labelled documents, whose lines all carry the document's label;
a document of the sample counts as often as its class has rows for each row kept, so
that scores mean the same with and without sampling.
A document's score is the mean of its lines' forward-backward marginals of `good`,
weighed by the lines' characters.

Defined results: texts without words (null and empty ones too) have no chain and
score 0; with labels of one class only every other text scores the smoothed base
rate, with none 0.5; equal texts have equal scores; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import Words, blocks, flat, mix, remainder, table
from touchline.llm.op9_quality_rules import line_bounds
from touchline.llm.training import labelled_sample

THRESHOLD = 0.5
FOLDS, HELD = 3, 1
#: Labelled rows that the fit reads: about so many of each class.
PER_CLASS = 4_000

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", "!?", ".,;:"]
_CODE = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CODE[list(_chars.encode())] = _k + 1
OWN = 5 + len(_CLASSES)
_LINE = np.uint64(0xD6E8FEB86659FD93)


def line_features(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, characters and own features of every line with a word."""
    words = Words(b, offsets)
    start, end, row = line_bounds(b, offsets)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = last > first
    start, end, row, first, last = (x[full] for x in (start, end, row, first, last))
    if not len(row):
        return row, np.zeros(0), np.zeros((0, OWN), np.float32)
    n = (last - first).astype(float)
    lead = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
    chars = (lead[end] - lead[start]).astype(float)
    code = _CODE[b]
    f = [np.log1p(chars), np.log1p(n), chars / n]
    for k in range(1, len(_CLASSES) + 1):
        sums = np.zeros(len(b) + 1, np.int64)
        np.cumsum(code == k, out=sums[1:])
        f.append((sums[end] - sums[start]) / chars)
    h = words.hashes()
    line = np.repeat(np.arange(len(n)), last - first).astype(np.uint64)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        np.cumsum((h[1:] == h[:-1]) & (line[1:] == line[:-1]), out=again[2:])
    f.append((again[last] - again[first]) / n)
    key = np.unique(mix(h + line * _LINE), return_index=True)[1]
    f.append(1 - np.bincount(line[key].astype(np.int64), minlength=len(n)) / n)
    return row, chars, np.stack(f, axis=1).astype(np.float32)


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line (0 at the ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(row) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:] = np.where(same, x[:-1], 0)
        after[:-1] = np.where(same, x[1:], 0)
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1)


class Chains:
    """Positions of many chains in time order, so that one step serves all chains that are that long."""

    def __init__(self, row: np.ndarray):
        self.ids, first, length = np.unique(row, return_index=True, return_counts=True)
        self.order = order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.steps = int(self.length[0]) if len(order) else 0
        self.active = np.searchsorted(-self.length, -np.arange(1, self.steps + 1), "right")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def forward_backward(chains: Chains, node: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, expected transitions (2x2 summed), log of the normaliser summed.

    node: log weight of state 1 against state 0 at each position; pair: log weights of transitions;
    weight: how often the transitions of each chain (by its number) count, once if not given.
    """
    size = len(node)
    top = np.maximum(node, 0)
    psi = np.stack([np.exp(-top), np.exp(node - top)], axis=1)
    a, scale, beta = np.zeros((size, 2)), np.ones(size), np.ones((size, 2))
    move = np.exp(pair - pair.max())
    for t in range(chains.steps):
        at = chains.at(t)
        now = psi[at] if t == 0 else (a[at - 1] @ move) * psi[at]
        s = now.sum(axis=1)
        scale[at] = s
        a[at] = now / s[:, None]
    expected = np.zeros((2, 2))
    heavy = None if weight is None else weight[chains.ids[chains.order]][:, None]
    for t in range(chains.steps - 2, -1, -1):
        at = chains.at(t + 1)  # those with a next position
        out = psi[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = out @ move.T
        before = a[at - 1] if weight is None else a[at - 1] * heavy[: len(at)]
        expected += move * (before.T @ out)
    moves = size - len(chains.first)
    return a[:, 1] * beta[:, 1], expected, float(np.log(scale).sum() + top.sum() + moves * pair.max())


def fit(label: np.ndarray, weight: np.ndarray, row: np.ndarray, x: np.ndarray, steps: int = 120, l2: float = 1e-3) -> dict:
    """label and weight by chain; row: chain of each line; x: own features of each line. A chain counts as `weight` equal ones."""
    each = weight[row].astype(float)
    mean = (each @ x) / each.sum()
    spread = np.sqrt((each @ (x - mean) ** 2) / each.sum()) + 1e-6
    z = with_neighbours(row, (x - mean) / spread).astype(np.float64)
    y = label[row].astype(float)
    chains = Chains(row)
    w, pair = np.zeros(z.shape[1]), np.zeros((2, 2))
    moves = np.zeros((2, 2))
    same = row[1:] == row[:-1]
    moves[1, 1], moves[0, 0] = each[1:][same & (y[1:] > 0)].sum(), each[1:][same & (y[1:] == 0)].sum()
    m, v = np.zeros(z.shape[1] + 4), np.zeros(z.shape[1] + 4)
    for t in range(1, steps + 1):
        p, expected, _ = forward_backward(chains, z @ w, pair, weight)
        g = np.append(z.T @ (each * (p - y)), (expected - moves).ravel()) / each.sum() + l2 * np.append(w, pair.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, pair = w - step[:-4], pair - step[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "w": w, "pair": pair}


def marginals(model: dict, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(good) of every line."""
    if not len(row):
        return np.zeros(0)
    z = with_neighbours(row, (x - model["mean"]) / model["spread"]).astype(np.float64)
    return forward_backward(Chains(row), z @ model["w"], model["pair"])[0]


def rows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features() of all rows of an Arrow array, block by block."""
    b, offsets = flat(texts)
    parts = []
    for i, j in blocks(offsets):
        row, chars, x = line_features(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((row + i, chars, x))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, OWN), np.float32)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, _, x = rows_of(batch.column(2))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        held = pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], ["label", "weight", "lines"])


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["label", "lines"], kind="stable")
    lines = [np.frombuffer(x, np.float32).reshape(-1, OWN) for x in pdf["lines"]]
    label, weight = pdf["label"].to_numpy(), pdf["weight"].to_numpy()
    full = np.array([len(x) > 0 for x in lines], bool)
    label, weight, lines = label[full], weight[full], [x for x in lines if len(x)]
    base = (float((weight * label).sum()) + 1) / (float(weight.sum()) + 2)
    empty = {"mean": np.zeros(0), "spread": np.zeros(0), "w": np.zeros(0), "pair": np.zeros((2, 2))}
    one = not len(label) or label.min() == label.max()
    model = empty if one else fit(label, weight, np.repeat(np.arange(len(lines)), [len(x) for x in lines]), np.concatenate(lines))
    return pd.DataFrame({"base": [base], "trained": [not one], **{k: [np.asarray(v, np.float64).tobytes()] for k, v in model.items()}})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, held: int = HELD, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: a few hundred numbers. The sample is bounded by per_class, so one task fits it."""
    sample = labelled_sample(docs, labels, label_col, folds, held, per_class, id_col, text_col).select("label", "weight", "text")
    ready = sample.mapInArrow(_featured, "label int, weight double, lines binary")
    got = ready.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit_group, "base double, trained boolean, mean binary, spread binary, w binary, pair binary").head()
    if got is None:
        return {"base": 0.5, "trained": False}
    model = {k: np.frombuffer(got[k], np.float64) for k in ("mean", "spread", "w", "pair")}
    return model | {"pair": model["pair"].reshape(2, 2), "base": got["base"], "trained": got["trained"]}


def scorer(spark: SparkSession, model: dict):
    """A column function: text -> score between 0 and 1."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            row, chars, x = rows_of(texts)
            size = np.bincount(row, weights=chars, minlength=len(texts))
            p = marginals(model, row, x) if model["trained"] else np.full(len(row), model["base"])
            good = np.bincount(row, weights=chars * p, minlength=len(texts))
            yield pa.array(np.clip(np.where(size > 0, good / np.maximum(size, 1), 0.0), 0.0, 1.0))

    return score


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, FOLDS) == HELD).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
