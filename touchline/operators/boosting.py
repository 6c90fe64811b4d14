"""Gradient-boosted trees of many fits in one plan: backtest folds, settings of a grid, labels.

Features are cut into bins once. All fits grow together, level by level: each task sums
gradients by fit, node, feature and bin over its rows, a shuffle by fit and node adds the
sums up and picks the best split, and only the splits come back. So a level of all folds,
models and settings is one job, and what is shuffled depends on fits, nodes and bins, not on
rows. A fit's rows are those its condition takes. Inputs of few bins are counted together as
one code, and their sums are taken apart at the end of a task.

Second-order boosting with a penalty of PENALTY on leaves; missing values go to the last bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
PENALTY = 1.0
#: Trees after which the sums of all earlier trees are written with the rows.
KEEP = 8
#: Rows that a task takes at once, and codes of inputs that are counted together.
CHUNK, CODES = 16_384, 512


@dataclass(frozen=True)
class Fit:
    """A model to fit: its label (0 or 1 if logistic), its inputs and the index of the condition that takes its rows."""

    label: str
    inputs: tuple[str, ...]
    fold: int
    logistic: bool = False
    trees: int = 20
    depth: int = 4
    step: float = 0.1
    subsample: float = 0.8


@dataclass
class Forest:
    """base, and of each tree: feature (its place among all inputs), bin (rows of greater bins go right) and value by node, in heap order."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


@dataclass
class Binned:
    """rows: id columns, bins (one byte an input), labels, folds (one byte a condition), draw (a random number of the row). cuts, missing: of each input the number of cuts and whether any value is missing."""

    rows: DataFrame
    inputs: tuple[str, ...]
    labels: tuple[str, ...]
    ids: tuple[str, ...]
    cuts: tuple[int, ...]
    missing: tuple[bool, ...]


def binned(df: DataFrame, inputs: Sequence[str], labels: Sequence[str], folds: Sequence[Column], ids: Sequence[str], stage: Callable[[DataFrame, str], DataFrame], bins: int = BINS) -> Binned:
    """df with its inputs in bins of about equal shares of all rows. The cuts look at inputs of all rows, never at labels."""
    inputs, labels, n_folds = tuple(inputs), tuple(labels), len(folds)
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    held = stage(df.select(*ids, F.array(*[number(c) for c in inputs]).alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("labels"), F.array(*[f.cast("tinyint") for f in folds]).alias("folds"), F.xxhash64(*ids).alias("draw")), "inputs")
    shares = [k / bins for k in range(1, bins)]
    found = held.agg(*[F.percentile_approx(F.col("x")[k], shares, 2000).alias(f"c{k}") for k in range(len(inputs))], *[F.count_if(F.col("x")[k].isNull()).alias(f"n{k}") for k in range(len(inputs))]).head()
    edges = [np.unique(np.array(c if c is not None else [], float)) for c in found[: len(inputs)]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), len(inputs))
            out = np.empty(x.shape, np.uint8)
            for k, e in enumerate(edges):
                out[:, k] = np.where(np.isnan(x[:, k]), bins - 1, np.searchsorted(e, x[:, k]))
            yield pa.record_batch([*(b.column(c) for c in ids), _binary(out), _binary(_matrix(b.column("folds"), n_folds).astype(np.uint8)), b.column("labels"), b.column("draw")], [*ids, "bins", "folds", "labels", "draw"])

    kinds = dict(held.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), "bins binary, folds binary, labels array<double>, draw long"])
    return Binned(stage(held.mapInArrow(cut, schema), "bins"), inputs, labels, tuple(ids), tuple(len(e) for e in edges), tuple(n > 0 for n in found[len(inputs) :]))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows; null as NaN."""
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    """Strings of bytes of one length as rows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row as a string of bytes."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _places(tree: tuple[np.ndarray, np.ndarray, np.ndarray], columns: np.ndarray, levels: int) -> np.ndarray:
    """The place of each row among the nodes of a level. columns: bins by input, as the nodes of a level are asked all at once and their answers chosen by those of the levels above."""
    none = np.zeros(columns.shape[1], np.uint8)
    asked: list[np.ndarray] = []
    out = none.astype(np.uint8 if levels <= 8 else np.uint32)
    for level in range(levels):
        right = [none if tree[1][j] >= 255 else (columns[tree[0][j]] > int(tree[1][j])).view(np.uint8) for j in range(2**level - 1, 2 ** (level + 1) - 1)]
        for above in reversed(asked):
            right = [a if a is b else a ^ (above & (a ^ b)) for a, b in zip(right[::2], right[1::2])]
        asked.append(right[0])
        out = out + out + right[0]
    return out


def _added(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """margin with the values of the trees."""
    for t in trees:
        levels = int(np.log2(len(t[0]) + 1)) - 1
        margin += np.take(t[2][2**levels - 1 :], _places(t, columns, levels))
    return margin


def _margin(forest: Forest, x: np.ndarray) -> np.ndarray:
    return _added(forest.trees, np.ascontiguousarray(x.T), np.full(len(x), forest.base))


def _drawn(draw: np.ndarray, tree: int, share: float) -> np.ndarray:
    """A share of the rows, another one for each tree, the same in every run."""
    z = draw.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _together(sizes: Sequence[int]) -> list[list[int]]:
    """Inputs in groups whose numbers of codes multiply to CODES at most, the largest first."""
    groups: list[list[int]] = []
    codes: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, n in enumerate(codes) if n * sizes[k] <= CODES), None)
        if at is None:
            groups.append([k])
            codes.append(sizes[k])
        else:
            groups[at].append(k)
            codes[at] *= sizes[k]
    return groups


@dataclass
class _Rows:
    """Rows of a fit: bins by input, label, margins by fit, and the codes of each group of inputs by set of inputs."""

    columns: np.ndarray
    label: np.ndarray
    margins: np.ndarray | None
    codes: dict[tuple[str, ...], list[np.ndarray]]


def _sums(data: Binned, fits: list[Fit], held: dict[int, int], forests: list[Forest], growing: dict[int, tuple], tree: int, level: int):
    """Rows -> fit, node and the sums of gradients and their slopes by input and bin."""
    places = {c: k for k, c in enumerate(data.inputs)}
    labels = {c: k for k, c in enumerate(data.labels)}
    width_y, used = len(labels), sorted({fits[k].fold for k in growing})
    shares = sorted({fits[k].subsample for k in growing})
    missing = data.missing
    # Codes of an input: its bins, and one for a missing value.
    sizes = [min(n + 1 + lost, BINS) for n, lost in zip(data.cuts, missing)]
    groups = {own: _together([sizes[places[c]] for c in own]) for own in {fits[k].inputs for k in growing}}
    wide = {own: max(int(np.prod([sizes[places[own[i]]] for i in g])) for g in found) for own, found in groups.items()}

    def coded(columns: np.ndarray, own: tuple[str, ...]) -> list[np.ndarray]:
        out = []
        for g in groups[own]:
            code = np.zeros(columns.shape[1], np.intp)
            for i in g:
                size = sizes[places[own[i]]]
                code *= size
                code += np.minimum(columns[places[own[i]]], size - 1)
            out.append(code)
        return out

    def add(x: np.ndarray, folds: np.ndarray, y: np.ndarray, draw: np.ndarray, before: np.ndarray | None, total: dict[int, np.ndarray]) -> None:
        for share in shares:
            mine = [k for k in growing if fits[k].subsample == share]
            at = np.flatnonzero(_drawn(draw, tree, share))
            # Rows of more folds first: where each fold holds the one before, its rows are a beginning.
            at = at[np.argsort(-folds[at].sum(axis=1, dtype=np.int64), kind="stable")]
            columns = np.ascontiguousarray(x[at].T)
            whole = _Rows(columns, y[at], None if before is None else np.ascontiguousarray(before[at].T), {own: coded(columns, own) for own in {fits[k].inputs for k in mine}})
            own_rows: dict[tuple[int, str], _Rows] = {}
            for k in mine:
                f = fits[k]
                if (f.fold, f.label) not in own_rows:
                    label = whole.label[:, labels[f.label]]
                    taken = (folds[at, f.fold] > 0) & ~np.isnan(label)
                    n = int(taken.sum())
                    part = slice(0, n) if taken[:n].all() else np.flatnonzero(taken)
                    own_rows[f.fold, f.label] = _Rows(columns[:, part], label[part], None if before is None else whole.margins[:, part], {own: [c[part] for c in codes] for own, codes in whole.codes.items()})
                rows = own_rows[f.fold, f.label]
                if not len(rows.label):
                    continue
                margin = np.full(len(rows.label), forests[k].base) if before is None else rows.margins[k].copy()
                margin = _added(forests[k].trees[held[k] :], rows.columns, margin)
                if f.logistic:
                    p = _sigmoid(margin)
                    g, h = p - rows.label, p * (1 - p)
                else:
                    g, h = margin - rows.label, None
                node = _places(growing[k], rows.columns, level).astype(np.intp) * wide[f.inputs] if level else None
                for out, code in zip(total[k], rows.codes[f.inputs]):
                    cell = code if node is None else code + node
                    out[0] += np.bincount(cell, g, out.shape[1])
                    out[1] += np.bincount(cell, h, out.shape[1])

    def apart(t: np.ndarray, own: tuple[str, ...]) -> np.ndarray:
        """Sums by group, slope or not, node and code -> by node, input, bin, slope or not."""
        out = np.zeros((2**level, len(own), BINS, 2))
        for sums, g in zip(t, groups[own]):
            n = [sizes[places[own[i]]] for i in g]
            sums = sums.reshape(2, 2**level, wide[own])[..., : int(np.prod(n))].reshape(2, 2**level, *n)
            for axis, i in enumerate(g):
                one = sums.sum(axis=tuple(2 + a for a in range(len(g)) if a != axis))
                k = places[own[i]]
                bins = np.arange(n[axis])
                if missing[k]:
                    bins[-1] = BINS - 1
                out[:, i, bins] = np.moveaxis(one, 0, -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(groups[fits[k].inputs]), 2, 2**level * wide[fits[k].inputs])) for k in growing}
        waiting, n_waiting = [], 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            folds, draw = _bytes(b.column("folds"), n), b.column("draw").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(folds[:, used].any(axis=1) & np.logical_or.reduce([_drawn(draw, tree, s) for s in shares]))
            before = _bytes(b.column("margins"), n).view(np.float64)[at] if "margins" in b.schema.names else None
            waiting.append((_bytes(b.column("bins"), n)[at], folds[at], _matrix(b.column("labels"), width_y)[at], draw[at], before))
            n_waiting += len(at)
            if n_waiting >= CHUNK:
                add(*(None if c[0] is None else np.concatenate(c) for c in zip(*waiting)), total)
                waiting, n_waiting = [], 0
        if n_waiting:
            add(*(None if c[0] is None else np.concatenate(c) for c in zip(*waiting)), total)
        rows = [(k, m, s[m].tobytes()) for k, t in total.items() for s in [apart(t, fits[k].inputs)] for m in range(2**level) if s[m].any()]
        for i in range(0, len(rows), 64):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.int32(), pa.binary()))], ["fit", "node", "sums"])

    return run


def _splits(fits: list[Fit]):
    """Sums of each fit and node, added up -> its best split: input (place among the fit's own), bin, sums of the left side and of all; input -1 where none gains."""

    def best(k: int, s: np.ndarray) -> tuple:
        g, h = s[0, :, 0].sum(), s[0, :, 1].sum()
        left = np.cumsum(s, axis=1)[:, :-1]
        gl, hl = left[..., 0], left[..., 1]
        worth = lambda a, b: a * a / (b + PENALTY)
        gain = np.where((hl > 1e-9) & (h - hl > 1e-9), worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), -1.0)
        f, b = np.unravel_index(int(np.argmax(gain.round(9))), gain.shape)
        ok = gain[f, b] > 1e-9
        return (int(f) if ok else -1, int(b), float(gl[f, b]) if ok else float(g), float(hl[f, b]) if ok else float(h), float(g), float(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []
        for b in batches:
            for k, m, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = np.frombuffer(raw, np.float64).reshape(len(fits[k].inputs), BINS, 2)
                if (k, m) != key:
                    if key is not None:
                        out.append((*key, *best(key[0], held)))
                    key, held = (k, m), np.zeros_like(s)
                held = held + s
        if key is not None:
            out.append((*key, *best(key[0], held)))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 4 + [pa.float64()] * 4)], ["fit", "node", "input", "bin", "gl", "hl", "g", "h"])

    return run


def _bases(data: Binned, fits: list[Fit]) -> list[Forest]:
    """Start values: the mean label of a fit's rows, as log odds (with half a row of either outcome) if logistic."""
    labels = {c: k for k, c in enumerate(data.labels)}
    width_y = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 2))
        for b in batches:
            if b.num_rows:
                folds, y = _bytes(b.column("folds"), b.num_rows), _matrix(b.column("labels"), width_y)
                for k, f in enumerate(fits):
                    v = y[(folds[:, f.fold] > 0), labels[f.label]]
                    v = v[~np.isnan(v)]
                    total[k] += len(v), v.sum()
        yield pa.record_batch([pa.array(range(len(fits)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["fit", "n", "s"])

    rows = {r["fit"]: (r["n"], r["s"]) for r in data.rows.select("folds", "labels").mapInArrow(run, "fit int, n double, s double").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    out = []
    for k, f in enumerate(fits):
        n, s = rows.get(k, (0.0, 0.0))
        out.append(Forest(float(np.log((s + 0.5) / (n - s + 0.5))) if f.logistic else s / max(n, 1.0)))
    return out


def _with_margins(data: Binned, rows: DataFrame, forests: list[Forest], held: dict[int, int]) -> DataFrame:
    width = len(data.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = _bytes(b.column("bins"), n) if n else np.zeros((0, width), np.uint8)
            columns = np.ascontiguousarray(x.T)
            before = _bytes(b.column("margins"), n).view(np.float64) if n and "margins" in b.schema.names else None
            m = np.stack([_added(f.trees[held[k] :], columns, np.full(n, f.base) if before is None else before[:, k].copy()) for k, f in enumerate(forests)], axis=1)
            kept = [c for c in b.schema.names if c != "margins"]
            yield pa.record_batch([*(b.column(c) for c in kept), _binary(m)], [*kept, "margins"])

    kept = [(c, t) for c, t in rows.dtypes if c != "margins"]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kept) + ", margins binary")


def fit_all(data: Binned, fits: Sequence[Fit], stage: Callable[[DataFrame, str], DataFrame], drop: Callable[[int, list[Forest]], set[int]] | None = None) -> list[Forest]:
    """The forests of all fits. drop: after each tree, asked with the number of trees and the forests which fits to give up."""
    fits = list(fits)
    forests = _bases(data, fits)
    places = {c: k for k, c in enumerate(data.inputs)}
    rows, held, gone = data.rows, dict.fromkeys(range(len(fits)), 0), set()
    for tree in range(max((f.trees for f in fits), default=0)):
        alive = [k for k, f in enumerate(fits) if tree < f.trees and k not in gone]
        if not alive:
            break
        size = {k: 2 ** (fits[k].depth + 1) - 1 for k in alive}
        # A node that is not split sends all rows to its left.
        grown = {k: (np.zeros(size[k], np.int64), np.full(size[k], 255, np.int64), np.zeros(size[k])) for k in alive}
        for level in range(max(fits[k].depth for k in alive)):
            growing = {k: grown[k] for k in alive if fits[k].depth > level}
            sums = rows.mapInArrow(_sums(data, fits, held, forests, growing, tree, level), "fit int, node int, sums binary")
            found = sums.repartition("fit", "node").sortWithinPartitions("fit", "node").mapInArrow(_splits(fits), "fit int, node int, input int, bin int, gl double, hl double, g double, h double")
            for r in found.collect():  # at most fits x nodes of a level
                k, node = r["fit"], 2**level - 1 + r["node"]
                feature, cut, value = grown[k]
                leaf = lambda g, h, k=k: -fits[k].step * g / (h + PENALTY)
                if r["input"] >= 0:
                    feature[node], cut[node] = places[fits[k].inputs[r["input"]]], r["bin"]
                value[2 * node + 1] = leaf(r["gl"], r["hl"])
                value[2 * node + 2] = leaf(r["g"] - r["gl"], r["h"] - r["hl"]) if r["input"] >= 0 else 0.0
        for k in alive:
            forests[k].trees.append(grown[k])
        if drop:
            gone |= drop(tree + 1, forests)
        if (tree + 1) % KEEP == 0 and tree + 1 < max(f.trees for f in fits):
            rows = stage(_with_margins(data, rows, forests, held), "margins")
            held = {k: len(f.trees) for k, f in enumerate(forests)}
    return forests


def predicted(data: Binned, fits: Sequence[Fit], forests: Sequence[Forest], which: dict[str, Sequence[int]], fold: Column | None = None) -> DataFrame:
    """The id columns and, for each name of `which`, the prediction (a probability if logistic) of one of its fits: of the one whose place in the list is `fold`, or the first. Rows with a null fold are left out."""
    fits, forests, ids = list(fits), list(forests), data.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, at = _bytes(b.column("bins"), b.num_rows), b.column("_fold").to_numpy(zero_copy_only=False)
            out = []
            for own in which.values():
                v = np.zeros(b.num_rows)
                for f in np.unique(at):
                    rows = np.flatnonzero(at == f)
                    m = _margin(forests[own[f]], x[rows])
                    v[rows] = _sigmoid(m) if fits[own[f]].logistic else m
                out.append(pa.array(v))
            yield pa.record_batch([*(b.column(c) for c in ids), *out], [*ids, *which])

    kinds = dict(data.rows.dtypes)
    rows = data.rows.withColumn("_fold", (F.lit(0) if fold is None else fold).cast("int")).filter("_fold IS NOT NULL").select(*data.ids, "bins", "_fold")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in data.ids), *(f"`{c}` double" for c in which)]))


def errors(data: Binned, fits: Sequence[Fit], forests: Sequence[Forest]) -> list[float]:
    """Of each fit the mean absolute error (log loss if logistic) on the rows that it does not take."""
    labels = {c: k for k, c in enumerate(data.labels)}
    fits, forests, width_y = list(fits), list(forests), len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 2))
        for b in batches:
            if not b.num_rows:
                continue
            x, folds, y = _bytes(b.column("bins"), b.num_rows), _bytes(b.column("folds"), b.num_rows), _matrix(b.column("labels"), width_y)
            for k, f in enumerate(fits):
                at = np.flatnonzero((folds[:, f.fold] == 0) & ~np.isnan(y[:, labels[f.label]]))
                m, v = _margin(forests[k], x[at]), y[at, labels[f.label]]
                p = np.clip(_sigmoid(m), 1e-7, 1 - 1e-7)
                total[k] += len(at), (-(v * np.log(p) + (1 - v) * np.log(1 - p)) if f.logistic else np.abs(m - v)).sum()
        yield pa.record_batch([pa.array(range(len(fits)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["fit", "n", "s"])

    rows = data.rows.select("bins", "folds", "labels").mapInArrow(run, "fit int, n double, s double").groupBy("fit").agg((F.sum("s") / F.sum("n")).alias("e")).collect()
    found = {r["fit"]: r["e"] for r in rows}
    return [found.get(k, float("nan")) for k in range(len(fits))]
