"""Forests and boosted trees grown from counts of binned rows.

Spark ML's trees keep each row as objects, for boosting more than 200 bytes, several times
over; where these don't fit into memory every level of every tree reads them from disk. Here
the rows are binned once, at most ``BINS`` bins a feature, and kept as blocks with a byte for
each feature. A pass over the blocks counts what lies in the bins of the open nodes of all
trees, those of all classes of a boosted model together; tasks send such counts only, and the
best cuts follow from them. The rules are Spark ML's: Gini or variance, cuts at quantiles,
Poisson draws of a forest, and boosting of pseudo-residuals with a first tree of full weight.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.features import FEATURES, LABEL

# Functions that run inside tasks travel with the job: executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature; rows of a block; points that stand for the values of a block in a sketch.
BINS, BLOCK_ROWS, SKETCH_POINTS = 32, 1 << 16, 512
#: Counts of a pass at most, and those of all its tasks that may reach the driver one by one.
PASS_CELLS, DRIVER_CELLS = 1 << 19, 1 << 22
#: Iterations after which the sums of a boosted model are kept with the rows.
KEEP_EVERY = 10


@dataclass
class Tree:
    """Nodes by number. A leaf leads to itself; the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [255])
    child: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [None])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> int:
        """Give a leaf two children; returns the left one."""
        left = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        for k in (left, left + 1):
            self.feature.append(0)
            self.cut.append(255)
            self.child.append(k)
            self.value.append(None)
            self.level.append(self.level[node] + 1)
        return left

    def prune(self, s: Settings) -> None:
        """Two leaves of one node that say the same become one."""
        said = np.argmax(self.value, axis=1) if s.counted else np.array(self.value)
        for node in reversed(range(len(self.child))):
            left = self.child[node]
            if left != node and self.child[left] == left and self.child[left + 1] == left + 1 and said[left] == said[left + 1]:
                self.feature[node], self.cut[node], self.child[node] = 0, 255, node

    def record(self, step: float, cuts: list[np.ndarray]) -> dict:
        """The tree with cuts as values of its features; a leaf has none."""
        values = [None if k == i else float(cuts[f][c]) for i, (f, c, k) in enumerate(zip(self.feature, self.cut, self.child, strict=True))]
        return {"feature": self.feature, "cut": values, "child": self.child, "value": self.value, "levels": max(self.level), "step": step}

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return np.array(self.feature), np.array(self.cut, np.int64), np.array(self.child), max(self.level)


def _places(flat: tuple, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row; ``codes`` has a line for each feature."""
    feature, cut, child, levels = flat
    n = codes.shape[1]
    at, row, cells = np.zeros(n, np.int64), np.arange(n), codes.ravel()
    for _ in range(levels):
        at = child[at] + (cells[feature[at] * n + row] > cut[at])
    return at


# ------------------------------------------------------------------ binning


def _thin(values: np.ndarray, counts: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many of the sorted values, each with the count of those it stands for: all up to it."""
    if len(values) <= points:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, points + 1) / points * (1 - 1e-12)).clip(0, len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0.0)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[start], np.add.reduceat(counts, start) if len(start) else counts


def cut_points(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Between all values where they are few, else at equal shares of the rows."""
    values, counts = _merged(values, counts)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins).clip(0, len(values) - 2))
    return (values[at] + values[at + 1]) / 2


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """The lists of a column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(n, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(features, label, weight) of up to BLOCK_ROWS rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((_matrix(b.column(0), b.num_rows), *[np.asarray(c) for c in b.columns[1:]]))
            n += b.num_rows
        if n >= BLOCK_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def fit_cuts(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature from all rows (features, label, weight)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, weight in _parts(batches):
            found = [_thin(*_merged(column[~np.isnan(column)], weight[~np.isnan(column)]), SKETCH_POINTS) for column in x.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(found)), pa.int32()), *[pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]],
                ["feature", "seen", "counts"],
            )

    def cut(table: pa.Table) -> pa.Table:
        seen, counts = (np.concatenate([np.frombuffer(v.as_py()) for v in table[c]]) for c in ("seen", "counts"))
        return pa.table({"feature": table["feature"][:1], "cuts": pa.array([cut_points(seen, counts, bins).tolist()], pa.list_(pa.float64()))})

    points = rows.mapInArrow(sketch, "feature int, seen binary, counts binary")
    found = points.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect()  # one row per feature
    return [np.array(r["cuts"], float) for r in sorted(found, key=lambda r: r["feature"])]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], weighted: bool) -> DataFrame:
    """Blocks of rows: number, codes (a line of bytes for each feature), label, weight and sums so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (x, label, weight) in enumerate(_parts(batches)):
            codes = np.empty(x.shape[::-1], np.uint8)
            for f, points in enumerate(cuts):
                codes[f] = np.searchsorted(points, x[:, f])
            cells = [codes.tobytes(), label.astype(float).tobytes(), weight.tobytes() if weighted else b"", b""]
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), *[pa.array([c], pa.binary()) for c in cells]], _COLUMNS)

    return rows.mapInArrow(run, _SCHEMA)


_COLUMNS = ["block", "codes", "label", "weight", "sums"]
_SCHEMA = "block long, codes binary, label binary, weight binary, sums binary"


# ------------------------------------------------------------------ growing


@dataclass(frozen=True)
class Settings:
    """``step`` given: boosted trees; ``classes`` given: classes instead of numbers."""

    trees: int = 100
    depth: int = 10
    least: int = 1
    features: str = "all"
    classes: int = 0
    step: float | None = None
    share: float = 1.0
    weight: str | None = None
    seed: int = 42

    @property
    def together(self) -> int:
        """Trees that grow side by side."""
        return self.trees if self.step is None else self.classes if self.classes > 2 else 1

    @property
    def counted(self) -> int:
        """Classes of a forest: their rows are counted. Else sums of numbers are taken."""
        return self.classes if self.step is None else 0

    @property
    def kinds(self) -> int:
        """Kinds of counts: the classes of a forest, else the rows and their target; rows with weights add their number."""
        return (self.counted or 2) + int(self.weight is not None)

    def tried(self, width: int) -> int:
        """Features that a node may be cut by."""
        share = {"all": width, "sqrt": math.sqrt(width), "log2": math.log2(width)}
        wanted = share[self.features] if self.features in share else float(self.features) * width
        return min(width, max(1, math.ceil(wanted)))


#: Poisson draws of mean 1 by 16 random bits.
_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Boosted:
    """How far a boosted model is: the iteration, and (step, trees, their values) that are not in the sums of the rows."""

    iteration: int = 0
    since: list[tuple[float, list[tuple], list[np.ndarray]]] = field(default_factory=list)

    def sums(self, k: int, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        for step, flats, values in self.since:
            before = before + step * values[k][_places(flats[k], codes)]
        return before


class _Block:
    def __init__(self, row: dict, width: int, s: Settings, base: float):
        self.number, self.s, self.base = row["block"], s, base
        self.label = np.frombuffer(row["label"])
        self.n = len(self.label)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(width, self.n)
        self.weight = np.frombuffer(row["weight"]) if row["weight"] else None
        self.sums = np.frombuffer(row["sums"]).reshape(-1, self.n) if row["sums"] else np.zeros((s.together, 1))

    def drawn(self, key: int) -> np.ndarray | None:
        """How often each row is drawn for a tree of a forest, or an iteration of boosting; None: once."""
        rng = np.random.default_rng((self.s.seed, key, self.number))
        if self.s.step is None:
            return _DRAWS[rng.integers(0, 1 << 16, self.n, np.uint16)].astype(float) if self.s.trees > 1 else None
        return (rng.random(self.n) < self.s.share).astype(float) if self.s.share < 1 else None

    def target(self, k: int, state: Boosted) -> np.ndarray:
        """What tree ``k`` is fitted to: the truth at first, then what the sums lack."""
        if not self.s.classes:
            y = self.label - self.base
        else:
            y = np.where(self.label == (k if self.s.classes > 2 else 1), 1.0, -1.0)
        if not state.iteration:
            return y
        total = state.sums(k, self.sums[k], self.codes)
        return 4 * y / (1 + np.exp(2 * y * total)) if self.s.classes else 2 * (y - total)

    def counts(self, flat: tuple, slots: np.ndarray, drawn: np.ndarray | None, target: np.ndarray | None) -> np.ndarray:
        """For each feature, open node, kind and bin the sum over the rows; rows elsewhere have the last slot."""
        s, n = self.s, int(slots.max()) + 1
        place = slots[_places(flat, self.codes)]
        weight = drawn if self.weight is None else self.weight if drawn is None else self.weight * drawn
        out = np.empty((len(self.codes), n, s.kinds, BINS))
        base = place * BINS
        if s.counted:
            base_of_class = (place * s.counted + self.label.astype(np.int64)) * BINS
        else:
            worth = target if weight is None else target * weight
        for f, codes in enumerate(self.codes):
            at = base + codes
            if s.counted:
                found = np.bincount(base_of_class + codes, weight, n * s.counted * BINS)
                out[f, :, : s.counted] = found.reshape(n, s.counted, BINS)
            else:
                out[f, :, 0] = np.bincount(at, weight, n * BINS).reshape(n, BINS)
                out[f, :, 1] = np.bincount(at, worth, n * BINS).reshape(n, BINS)
            if self.weight is not None:
                out[f, :, -1] = np.bincount(at, drawn, n * BINS).reshape(n, BINS)
        return out[:, : n - 1]


@dataclass
class _Rows:
    """The kept blocks of the training rows and what a pass over them needs to know."""

    blocks: DataFrame
    parts: int
    cuts: list[np.ndarray]
    base: float

    def count(self, s: Settings, wanted: list[tuple[int, tuple, np.ndarray]], state: Boosted) -> dict[int, np.ndarray]:
        """Counts of the open nodes of each wanted (tree, its nodes, the slot of each node)."""
        width, base = len(self.cuts), self.base

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for row in (r for b in batches for r in b.to_pylist()):
                block = _Block(row, width, s, base)
                for k, flat, slots in wanted:
                    drawn = block.drawn(k if s.step is None else state.iteration)
                    found = block.counts(flat, slots, drawn, None if s.counted else block.target(k, state))
                    sums[k] = sums[k] + found if k in sums else found
            for k, total in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())],
                    ["tree", "feature", "sums"],
                )

        def add(table: pa.Table) -> pa.Table:
            total = np.frombuffer(table["sums"][0].as_py())
            for v in table["sums"][1:]:
                total = total + np.frombuffer(v.as_py())
            return pa.table({"tree": table["tree"][:1], "feature": table["feature"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        schema = "tree int, feature int, sums binary"
        found = self.blocks.mapInArrow(tally, schema)
        out = {k: np.zeros((width, int(slots.max()), s.kinds, BINS)) for k, _, slots in wanted}
        if sum(o.size for o in out.values()) * self.parts > DRIVER_CELLS:
            found = found.groupBy("tree", "feature").applyInArrow(add, schema)
        for r in found.collect():  # DRIVER_CELLS in all, or one sum for each of PASS_CELLS
            cells = out[r["tree"]][r["feature"]]
            cells += np.frombuffer(r["sums"]).reshape(cells.shape)
        return out

    def keep_sums(self, s: Settings, state: Boosted) -> _Rows:
        """The same rows with the trees since then in their sums."""
        width, base = len(self.cuts), self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block = _Block(row, width, s, base)
                    row["sums"] = np.stack([state.sums(k, block.sums[k] + np.zeros(block.n), block.codes) for k in range(s.together)]).tobytes()
                    yield pa.RecordBatch.from_pylist([row], b.schema)

        blocks = self.blocks.mapInArrow(run, _SCHEMA).persist()
        blocks.count()
        self.blocks.unpersist()
        return _Rows(blocks, self.parts, self.cuts, base)


def best_cuts(counts: np.ndarray, cuts: list[np.ndarray], s: Settings, allowed: np.ndarray) -> list[tuple | None]:
    """For each open node (feature, cut, value, left value, right value), without a gain the value alone.

    Gini and variance are the same rule: the sum over kinds of squares over the rows, of both sides, less
    that of the node.
    """
    left = np.cumsum(counts, axis=3)[..., :-1]
    total = counts[0].sum(axis=2)
    right = total[None, :, :, None] - left
    kinds = slice(0, s.counted) if s.counted else slice(1, 2)

    def rows(x: np.ndarray, axis: int) -> np.ndarray:
        return x.take(range(s.counted), axis).sum(axis) if s.counted else x.take(0, axis)

    def score(x: np.ndarray, n: np.ndarray, axis: int) -> np.ndarray:
        squares = (x.take(range(kinds.start, kinds.stop), axis) ** 2).sum(axis)
        return squares / np.where(n > 0, n, 1)

    n_left, n_right, n = rows(left, 2), rows(right, 2), rows(total, 1)
    before = score(total, n, 1)
    gain = score(left, n_left, 2) + score(right, n_right, 2) - before[None, :, None]
    few = [x[:, :, -1] if s.weight else y for x, y in ((left, n_left), (right, n_right))]
    there = np.arange(BINS - 1) < np.array([len(c) for c in cuts])[:, None]
    able = (n_left > 0) & (n_right > 0) & (few[0] >= s.least) & (few[1] >= s.least) & there[:, None, :] & allowed.T[:, :, None]
    gain = np.where(able, gain, -np.inf).transpose(1, 0, 2).reshape(len(n), -1)

    def value(x: np.ndarray) -> list[float] | float:
        if s.counted:
            return (x[: s.counted] / max(x[: s.counted].sum(), 1e-300)).tolist()
        return float(x[1] / x[0]) if x[0] else 0.0

    out: list[tuple] = []
    for i, at in enumerate(gain.argmax(axis=1).tolist()):
        f, j = divmod(at, BINS - 1)
        if gain[i, at] > 1e-10 * before[i]:
            out.append((f, j, value(total[i]), value(left[f, i, :, j]), value(right[f, i, :, j])))
        else:
            out.append((None, None, value(total[i]), None, None))
    return out


def _grow(rows: _Rows, s: Settings, state: Boosted, rng: np.random.Generator) -> list[Tree]:
    """The trees of a forest, or those of an iteration: open nodes of all of them are counted in one pass."""
    width, trees = len(rows.cuts), [Tree() for _ in range(s.together)]
    room = max(1, PASS_CELLS // (width * s.kinds * BINS))
    waiting = [(k, 0) for k in range(len(trees))]
    while waiting:
        now, waiting = waiting[:room], waiting[room:]
        nodes = {k: [v for t, v in now if t == k] for k, _ in now}
        wanted = []
        for k, open_ in nodes.items():
            slots = np.full(len(trees[k].feature), len(open_))
            slots[open_] = np.arange(len(open_))
            # Nodes that are open or wait hold rows, so the last slot may be empty but is always there.
            wanted.append((k, trees[k].flat(), np.append(slots, len(open_))))
        found = rows.count(s, wanted, state)
        for k, open_ in nodes.items():
            tree = trees[k]
            allowed = np.zeros((len(open_), width), bool)
            for line in allowed:
                line[rng.permutation(width)[: s.tried(width)]] = True
            for node, (f, j, value, left, right) in zip(open_, best_cuts(found[k], rows.cuts, s, allowed), strict=True):
                tree.value[node] = value
                if f is None or tree.level[node] >= s.depth:
                    continue
                child = tree.split(node, f, j)
                tree.value[child], tree.value[child + 1] = left, right
                if tree.level[child] < s.depth:
                    waiting += [(k, child), (k, child + 1)]
    for tree in trees:
        tree.prune(s)
    return trees


class Trees:
    """A forest, or boosted trees; fitting reads every row for each level of trees that grow together."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def fit(self, df: DataFrame) -> TreesModel:
        s = self.settings
        weight = F.col(s.weight).cast("double") if s.weight else F.lit(1.0)
        read = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"), weight.alias("w"))
        cuts = fit_cuts(read)
        if not cuts:
            raise ValueError("there are no rows to learn from")
        base = 0.0 if s.classes else float(df.agg(F.avg(LABEL)).first()[0])
        blocks = _blocks(read, cuts, s.weight is not None).persist()
        try:
            blocks.count()
            rows = _Rows(blocks, blocks.rdd.getNumPartitions(), cuts, base)
            rng, state, made = np.random.default_rng(s.seed), Boosted(), []
            if s.step is None:
                made = [(1.0 / s.trees, t) for t in _grow(rows, s, state, rng)]
            for m in range(s.trees if s.step is not None else 0):
                state.iteration = m
                trees, step = _grow(rows, s, state, rng), s.step if m else 1.0
                made += [(step, t) for t in trees]
                state.since.append((step, [t.flat() for t in trees], [np.array(t.value, float) for t in trees]))
                if len(state.since) == KEEP_EVERY and m + 1 < s.trees:
                    rows = rows.keep_sums(s, state)
                    blocks, state.since = rows.blocks, []
        finally:
            blocks.unpersist()
        state = {"classes": s.classes, "votes": s.counted > 0, "groups": s.together if s.step is not None else 1, "base": base}
        listed = [t.record(step, cuts) for step, t in made]
        return TreesModel(state=json.dumps({**state, "trees": listed}))


class TreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``, for two classes or a forest of classes ``rawPrediction`` and ``probability`` too."""

    state = Param(Params._dummy(), "state", "trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state="{}"):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        model = json.loads(self.getOrDefault("state"))
        found = df.withColumn("__told", F.arrow_udf(_teller(model), "array<double>")(vector_to_array(FEATURES)))
        if not model["classes"]:
            return found.withColumn("prediction", F.col("__told")[0]).drop("__told")
        scores = F.slice("__told", 2, max(2, model["classes"]))
        if model["votes"] or model["classes"] <= 2:
            chance = scores if model["votes"] else F.transform(scores, lambda x: 1 / (1 + F.exp(-2 * x)))
            found = found.withColumn("probability", array_to_vector(chance))
        found = found.withColumn("rawPrediction", array_to_vector(scores))
        return found.withColumn("prediction", F.col("__told")[0]).drop("__told")


def _teller(model: dict) -> Callable[[pa.Array], pa.Array]:
    """From features to the prediction and the scores of all classes."""
    trees = [
        (np.array(t["feature"]), np.array([np.inf if c is None else c for c in t["cut"]], float), np.array(t["child"]), t["levels"], t["step"] * np.array(t["value"]))
        for t in model["trees"]
    ]
    width = model["classes"] if model["votes"] else model["groups"]

    def tell(column: pa.Array) -> pa.Array:
        n = len(column)
        x = _matrix(column, n) if n else np.zeros((0, 1))
        x = np.where(np.isnan(x), np.inf, x)
        cells, size, row = x.ravel(), x.shape[1], np.arange(n)
        total = np.full((max(1, width), n), model["base"])
        for i, (feature, cut, child, levels, value) in enumerate(trees):
            at = np.zeros(n, np.int64)
            for _ in range(levels):
                at = child[at] + (cells[row * size + feature[at]] > cut[at])
            if model["votes"]:
                total += value[at].T
            else:
                total[i % width] += value[at]
        if model["classes"] and width == 1:
            total = np.vstack([-total, total])
        # Of equal scores the first class counts.
        first = total.argmax(axis=0).astype(float) if model["classes"] else total[0]
        out = np.column_stack([first, total.T])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return tell
