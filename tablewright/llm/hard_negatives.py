"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt into blocks. Within a block they hang on a spanning tree with short
edges. A candidate's score with an anchor differs from its score with the anchor's parent
by at most the length of the edge times the norm of the candidate (Cauchy-Schwarz). So
only at the root all candidates are scored; further down the tree each candidate has an
interval, which is widened by an edge or narrowed to the score where it was computed. A
candidate is scored again only where its interval meets the anchor's window.

Blocks of anchors meet blocks of candidates as cogroups of bounded size: the anchors are
the stated queries, all rows the candidates. Scores are inner products of whole numbers
and exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable

#: Anchors and candidates of a block; what meets in one task is one block of each.
ANCHOR_BLOCK, ROW_BLOCK = 1024, 8192
#: Below this, sums of products of whole floats are exact; beyond the next, they no longer fit a long.
_EXACT, _LONG = 2.0**53, 2.0**62
_MIN, _MAX, _HUGE = -(1 << 63), (1 << 63) - 1, 10**300


def whole_vectors(vectors: pa.Array, scale: float) -> tuple[list[int], list[list[float]]]:
    """Places and floor(scale * x) of the vectors without null or non-finite components."""
    places, out = [], []
    for i, v in enumerate(vectors.to_pylist()):
        if not v or None in v:
            continue
        with np.errstate(over="ignore"):
            x = np.floor(np.array(v, np.float64) * scale)
        if np.isfinite(x).all():
            places.append(i)
            out.append(x.tolist())
    return places, out


def _lengths(rows: np.ndarray) -> np.ndarray:
    top = max(1.0, np.abs(rows).max(initial=0.0))
    return top * np.sqrt(np.einsum("ij,ij->i", rows / top, rows / top))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points from the root on, nearest first (Prim), each one's parent (-1: a root) and the length of its edge."""
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    half, far, out = points / 2, np.full(n, np.inf), np.zeros(n, bool)
    now = int(np.argmin(_lengths(half - half.mean(axis=0))))
    for k in range(n):
        order[k], out[now] = now, True
        edge[now] = far[now] if parent[now] >= 0 else 0.0
        gap = 2 * _lengths(half - half[now])
        closer = ~out & (gap < far)
        far[closer], parent[closer] = gap[closer], now
        left = np.flatnonzero(~out)
        if len(left):
            now = int(left[np.argmin(far[left])])
    return order, parent, edge


class Candidates:
    """A block of candidates, scored exactly against one anchor at a time."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norms, self.top = vectors, _lengths(vectors), np.abs(vectors).max(initial=0.0)

    def scores(self, anchor: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores as longs (the nearest, beyond their range) and as floats."""
        most = self.top * np.abs(anchor).max(initial=0.0) * len(anchor)
        if most < _EXACT:
            found = self.vectors[some] @ anchor
            return found.astype(np.int64), found
        if most < _LONG:
            found = self.vectors[some].astype(np.int64) @ anchor.astype(np.int64)
            return found, found.astype(np.float64)
        mine = [int(x) for x in anchor]
        found = [sum(int(x) * y for x, y in zip(v, mine, strict=True)) for v in self.vectors[some]]
        near = np.array([min(_MAX, max(_MIN, x)) for x in found], np.int64)
        return near, np.array([float(min(_HUGE, max(-_HUGE, x))) for x in found])


def down_the_tree(
    anchors: np.ndarray, block: Candidates, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each anchor with the rows scored for it and their scores.

    ``wanted(anchor, low, high)`` says which rows matter, given the interval each score
    lies in; at a root, where nothing is known, all rows are scored.
    """
    order, parent, edge = spanning_tree(anchors)
    waiting = np.bincount(parent[parent >= 0], minlength=len(order))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a in order.tolist():
        p = int(parent[a])
        if p < 0:
            some = np.arange(len(block.vectors))
            low, high = np.zeros(len(some)), np.zeros(len(some))
        else:
            low, high = bounds[p]
            # The second term is above the rounding of what came before.
            reach = edge[a] * block.norms
            reach = reach + (np.abs(low) + np.abs(high) + reach) * 1e-9 + 1e-9
            low, high = low - reach, high + reach
            some = np.flatnonzero(wanted(a, low, high))
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        scores, exact = block.scores(anchors[a], some)
        low[some] = high[some] = exact
        if waiting[a]:
            bounds[a] = low, high
        yield a, some, scores


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: higher scores first, ties by smaller id, then row."""
    if len(scores) > n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        some = np.arange(len(scores))
    # Ascending by the complement, which no long overflows.
    return some[np.lexsort((rows[some], ids[some], ~scores[some]))[:n]]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _longs(names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names.split()])


_POSITIVE = _longs("anchor_row positive_id positive_row positive_score")
_NEGATIVE = _longs("anchor_row place negative_id negative_row negative_score")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{n} long" for n in schema.names)


def _positives(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """The best rows of one label for each anchor, from one block of each."""
    out = []
    if left.num_rows and right.num_rows:
        dim = left["dim"][0].as_py()
        anchor_ids, anchor_rows = _numbers(left["id"]), _numbers(left["row_no"])
        ids, rows = _numbers(right["id"]), _numbers(right["row_no"])

        def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = ids != anchor_ids[a]
            if other.sum() <= n:
                return other
            lows = low[other]
            return other & (high >= np.partition(lows, len(lows) - n)[len(lows) - n])

        for a, some, scores in down_the_tree(_matrix(left["v"], dim), Candidates(_matrix(right["v"], dim)), wanted):
            other = ids[some] != anchor_ids[a]
            some, scores = some[other], scores[other]
            for i in _best(scores, ids[some], rows[some], n).tolist():
                out.append((int(anchor_rows[a]), int(ids[some[i]]), int(rows[some[i]]), int(scores[i])))
    return _table(out, _POSITIVE)


def _negatives(left: pa.Table, right: pa.Table, n: int, low: int, high: int) -> pa.Table:
    """The best rows of other labels within the windows of each anchor, from one block of each."""
    out = []
    if left.num_rows and right.num_rows:
        dim = left["dim"][0].as_py()
        anchor_rows = _numbers(left["row_no"]).tolist()
        ids, rows = _numbers(right["id"]), _numbers(right["row_no"])
        codes: dict[str, int] = {}
        labels = np.array([codes.setdefault(x, len(codes)) for x in right["label"].to_pylist()])
        anchor_labels = [codes.get(x, -1) for x in left["label"].to_pylist()]
        # Whole scores between low % and high % of the positive's score.
        windows = [
            [(w["place"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in ws] for ws in left["wanted"].to_pylist()
        ]
        ranges = [[(s - abs(s) * 1e-9 - 1, e + abs(e) * 1e-9 + 1) for _, s, e in ws if s <= e] for ws in windows]

        def wanted(a: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
            found = np.zeros(len(lows), bool)
            for s, e in ranges[a]:
                found |= (highs >= s) & (lows <= e)
            return found & (labels != anchor_labels[a])

        for a, some, scores in down_the_tree(_matrix(left["v"], dim), Candidates(_matrix(right["v"], dim)), wanted):
            other = labels[some] != anchor_labels[a]
            some, scores = some[other], scores[other]
            for place, s, e in windows[a]:
                within = np.flatnonzero((scores >= max(s, _MIN)) & (scores <= min(e, _MAX))) if s <= e else []
                if not len(within):
                    continue
                of = some[within]
                for i in _best(scores[within], ids[of], rows[of], n).tolist():
                    out.append((anchor_rows[a], place, int(ids[of[i]]), int(rows[of[i]]), int(scores[within[i]])))
    return _table(out, _NEGATIVE)


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_block: int, row_block: int, run: Callable, schema: str) -> DataFrame:
    """``run`` on every block of anchors with every block of rows of the same keys."""
    asked = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_anchors"))
    sizes = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(asked, keys))
    anchor_blocks, row_blocks = (
        F.ceil(F.col(n) / size).cast("int") for n, size in (("n_anchors", anchor_block), ("n_rows", row_block))
    )
    place = F.xxhash64("row_no")
    dealt = attach(anchors, sizes, keys, "n_anchors").withColumn("a", F.pmod(place, anchor_blocks).cast("int"))
    dealt = dealt.withColumn("r", F.explode(F.sequence(F.lit(0), row_blocks - 1))).drop("n_rows", "n_anchors")
    met = attach(rows, sizes, keys, "n_rows").withColumn("r", F.pmod(place, row_blocks).cast("int"))
    met = met.withColumn("a", F.explode(F.sequence(F.lit(0), anchor_blocks - 1))).drop("n_rows", "n_anchors")
    # Columns of its own: anchors and rows come from one table.
    met = met.select(*[F.col(c).alias(c) for c in met.columns])
    tile = [*keys, "a", "r"]
    return dealt.groupBy(*tile).cogroup(met.groupBy(*tile)).applyInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels within a window.

    A row's score is the inner product with the anchor of floor(scale * component).
    Higher scores come first, ties by smaller id. Positives are the first
    ``n_positives`` rows of the anchor's label, hard negatives the first
    ``n_negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows with a null id or label, or with a vector that is null, empty, or holds null or
    non-finite components (also after scaling) take no part. Vectors of another length
    than the anchor's are no candidates. Rows with the anchor's id are not its positives.
    Rows equal in id, label and vector count once; others that share an id are rows of
    their own, whose ties go by their place in the input. Scores beyond a long count as the nearest long. An
    empty table gives an empty result; further columns are not read.
    """
    read = vectors.select(
        vectors[id_col].cast("long").alias("id"),
        vectors[label_col].cast("string").alias("label"),
        vectors[vector_col].alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, whole = whole_vectors(b.column(2), scale)
            at = pa.array(places, pa.int64())
            more = [pa.array(whole, pa.list_(pa.float64())), pa.array([len(x) for x in whole], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (0, 1, 3)), *more], ["id", "label", "anchor", "v", "dim"])

    whole = read.mapInArrow(clean, "id long, label string, anchor boolean, v array<double>, dim int")
    key = F.sha2(F.to_json(F.struct("v")), 256).alias("key")
    once = whole.groupBy("id", "label", "dim", key).agg(F.first("v").alias("v"), F.max("anchor").alias("anchor"))
    rows = durable(once.select("id", "label", "dim", "v", "anchor", F.monotonically_increasing_id().alias("row_no")))
    anchors = rows.where("anchor").select("id", "label", "dim", "v", "row_no")
    candidates = rows.select("id", "label", "dim", "v", "row_no")

    found = _meet(
        anchors, candidates, ["dim", "label"], anchor_block, row_block,
        lambda left, right: _positives(left, right, n_positives), _ddl(_POSITIVE),
    )
    by = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = found.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n_positives)
    positives = durable(found.select("anchor_row", "place", "positive_id", "positive_score"))
    wanted = F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("wanted")
    asked = positives.groupBy(F.col("anchor_row").alias("row_no")).agg(wanted)
    asking = durable(anchors.join(asked, "row_no"))
    found = _meet(
        asking, candidates, ["dim"], anchor_block, row_block,
        lambda left, right: _negatives(left, right, n_negatives, low, high), _ddl(_NEGATIVE),
    )
    by = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    named = positives.join(anchors.select(F.col("row_no").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return found.join(named, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
