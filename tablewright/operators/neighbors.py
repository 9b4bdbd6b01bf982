"""Exact nearest neighbours by cells around pivots.

Train rows lie in the cell of their nearest pivot. A query is searched in its nearest
cells first, which gives a bound on the distance of its k-th neighbour; by the triangle
inequality a cell, and within it a row, whose distance to the pivot differs by more than
the bound cannot hold a nearer one. So a query goes to the cells that can matter only,
block against block inside the tasks, and only its best ``k`` leave a block. Queries
never pass through the driver; pivots and one line per cell do, and are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.session import durable, local_frame

#: Rows of a block of a cell, queries of a block, and the most cells.
BLOCK_ROWS, QUERY_ROWS, MOST_CELLS = 4_096, 4_096, 1_024
#: From so many components on cells keep little apart, and a row that moves is large: fewer, larger blocks.
WIDE, WIDE_ROWS = 16, 32_768
#: Distances that a task holds at a time, queries that are aimed at a time, and rows of a batch.
HELD_GAPS, AIM_ROWS, OUT_ROWS = 1 << 20, 1_024, 1 << 16
#: Candidates of a query, in multiples of k, above which the bound alone does not screen.
_MANY = 8
FOUND = "query_id long, neighbor_id long, distance double, outcome double"
_SLACK = 1e-6  # distances are rounded to so many


def _gaps(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Distances of each row of a to each row of b."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        total += np.abs(gap) if p == 1 else gap * gap
    return np.sqrt(total) if p == 2 else total


def _pair_gaps(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, p: int) -> np.ndarray:
    """Distances of the rows a[i] to the rows b[j], summed as by ``_gaps``."""
    total = np.zeros(len(i))
    for d in range(a.shape[1]):
        gap = a[i, d] - b[j, d]
        total += np.abs(gap) if p == 1 else gap * gap
    return np.sqrt(total) if p == 2 else total


def _candidates(queries: np.ndarray, q_ids, train: np.ndarray, t_ids, bound, k: int, p: int, skip_self: bool):
    """Pairs (query, train row) among which the k nearest of each query are, with all that tie.

    Many components: squared distances from one matrix product, whose rounding a margin covers.
    Few components, or values whose squares are no numbers: the distances themselves.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a2, b2 = (queries * queries).sum(axis=1), (train * train).sum(axis=1)
        largest = a2.max(initial=0.0) + b2.max(initial=0.0)
    if p == 2 and queries.shape[1] >= WIDE and largest < 1e300:
        margin = 1e-12 * queries.shape[1] * largest
        square = a2[:, None] + b2[None, :] - 2 * (queries @ train.T)
    else:
        margin, square = 0.0, _gaps(queries, train, p)
        square = np.square(square, out=square)
    if skip_self:
        square[q_ids[:, None] == t_ids[None, :]] = np.inf

    def within(limit: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.sqrt(np.maximum(limit, 0) + margin) * (1 + 1e-12) + 2 * _SLACK) ** 2 * (1 + 1e-12) + margin

    limit = np.minimum(bound * bound, np.finfo(float).max)
    near = square <= within(limit)[:, None]
    if train.shape[0] > k and near.sum() > _MANY * k * len(queries):
        with np.errstate(invalid="ignore"):
            kth = np.partition(square, k - 1, axis=1)[:, k - 1]
        near &= ~(square > within(np.where(np.isfinite(kth), kth, np.inf))[:, None])
    return np.nonzero(near)


def _best(queries: np.ndarray, q_ids, near, train: np.ndarray, t_ids, radius, outcome, k: int, p: int, skip_self: bool) -> pa.Table:
    """The k nearest train rows of each query row, ties to the lower id.

    ``near`` is the distance and bound of each query, ``radius`` the distance of each train
    row, all to the cell's pivot: rows that differ by more than the bound are passed over.
    """
    by_id = np.argsort(t_ids, kind="stable")
    train, t_ids, radius, outcome = train[by_id], t_ids[by_id], radius[by_id], outcome[by_id]
    to_pivot, bound = near
    columns: list[list[np.ndarray]] = [[], [], [], []]
    order = np.argsort(to_pivot, kind="stable")
    step = max(1, HELD_GAPS // max(1, len(train)))
    for start in range(0, len(queries), step):
        some = order[start : start + step]
        reach = bound[some] + _SLACK * (1 + to_pivot[some])
        low, high = (to_pivot[some] - reach).min(), (to_pivot[some] + reach).max()
        able = np.flatnonzero((radius >= low) & (radius <= high))
        if not len(able):
            continue
        ids, held = q_ids[some], t_ids[able]
        who, which = _candidates(queries[some], ids, train[able], held, bound[some], k, p, skip_self)
        gaps = np.round(_pair_gaps(queries[some], train[able], who, which, p), 6)
        if skip_self:
            gaps[ids[who] == held[which]] = np.inf
        kept = np.isfinite(gaps)
        who, which, gaps = who[kept], which[kept], gaps[kept]
        # The train rows are in id order, which breaks ties.
        first = np.lexsort((which, gaps, who))
        who, which, gaps = who[first], which[first], gaps[first]
        at = np.arange(len(who)) - np.searchsorted(who, who)
        who, which, gaps = who[at < k], which[at < k], gaps[at < k]
        for c, v in zip(columns, (ids[who], held[which], gaps, outcome[able][which]), strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ("query_id", "neighbor_id", "distance", "outcome")
    empty = [np.zeros(0, t.to_pandas_dtype()) for t in kinds]
    return pa.table({n: pa.array(np.concatenate([e, *c]), t) for n, e, c, t in zip(names, empty, columns, kinds, strict=True)})


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best k over all blocks; the rank filter also runs before the shuffle."""
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance", "outcome")


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def nearest(
    queries: DataFrame,
    train: DataFrame,
    vector: str,
    id_col: str,
    outcome: str,
    k: int = 5,
    p: int = 2,
    skip_self: bool = False,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance, outcome) of the ``k`` nearest train rows.

    Vectors are arrays of numbers of one length, ids are unique whole numbers; copies of a
    query get one answer. Rows without id or vector, or with a vector of another length
    than the train rows' first, are left out. ``p`` is 1 (Manhattan) or 2 (Euclidean);
    distances are rounded to six places, ties go to the lower id. Without train rows the result
    is empty. A query moves once for each cell it can have neighbours in.
    """
    if p not in (1, 2):
        raise ValueError("p is 1 or 2")
    spark = queries.sparkSession
    q = queries.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    t = train.select(
        quoted(id_col).cast("long").alias("id"),
        quoted(vector).cast("array<double>").alias("v"),
        quoted(outcome).cast("double").alias("y"),
    ).where("id is not null and v is not null")
    n = t.count()
    widest = t.agg(F.max(F.size("v"))).first()[0] or 0
    block_rows, query_rows = (WIDE_ROWS, WIDE_ROWS) if p == 2 and widest >= WIDE else (BLOCK_ROWS, QUERY_ROWS)
    drawn = t.orderBy(F.xxhash64("id"), "id").limit(min(MOST_CELLS, max(1, math.ceil(n / block_rows)))).collect()
    if not drawn:
        return local_frame(spark, [], "query_id long, rank int, neighbor_id long, distance double, outcome double")
    width = len(drawn[0]["v"])
    pivots = np.array([r["v"] for r in drawn if len(r["v"]) == width], float)
    need = k + int(skip_self)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            for start in range(0, len(b), AIM_ROWS):
                part = b.slice(start, AIM_ROWS)
                yield part, _gaps(_matrix(part.column(1), width), pivots, p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, gaps in slices(batches):
            cell = gaps.argmin(axis=1)
            more = [pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(gaps)), cell])]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], ["id", "v", "y", "cell", "r"])

    rows = t.where(F.size("v") == width).mapInArrow(place, "id long, v array<double>, y double, cell int, r double")
    rows = durable(rows)
    known = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    size, low, high = (np.zeros(len(pivots)) for _ in range(3))
    for r in known:  # one row per cell
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    cells = local_frame(spark, [(i, int(-(-m // block_rows))) for i, m in enumerate(size) if m], "cell int, blocks int")

    def first_cells(gaps: np.ndarray) -> np.ndarray:
        """For each query, whether a cell is one of the nearest that hold as many rows as are needed."""
        order = np.argsort(np.where(size > 0, gaps, np.inf), axis=1, kind="stable")
        enough = np.cumsum(size[order], axis=1) >= need
        upto = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, int((size > 0).sum()))
        chosen = np.zeros(gaps.shape, bool)
        np.put_along_axis(chosen, order, np.arange(gaps.shape[1])[None, :] < upto[:, None], axis=1)
        return chosen

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, gaps in slices(batches):
            yield from _aimed(b, first_cells(gaps), gaps, np.full(len(b), np.inf))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, gaps in slices(batches):
            bound = b.column(2).to_numpy(zero_copy_only=False)
            slack = _SLACK * (1 + gaps)
            can = (size > 0) & (np.maximum(gaps - high, low - gaps) - slack <= bound[:, None])
            yield from _aimed(b, can & ~first_cells(gaps), gaps, bound)

    aimed = "id long, v array<double>, cell int, r double, bound double"
    asked = q.where(F.col("id").isNotNull() & (F.size("v") == width)).dropDuplicates(["id"])
    if len(known) == 1:
        return _merge(_search(asked.mapInArrow(aim, aimed), rows, cells, width, query_rows, k, p, skip_self), k)
    asked = durable(asked)
    first = durable(_merge(_search(asked.mapInArrow(aim, aimed), rows, cells, width, query_rows, k, p, skip_self), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    bounded = asked.join(kth, "id", "left").select("id", "v", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    rest = _search(bounded.mapInArrow(go_on, aimed), rows, cells, width, query_rows, k, p, skip_self)
    return _merge(first.drop("rank").unionByName(rest), k)


def _aimed(b: pa.RecordBatch, cells: np.ndarray, gaps: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query once for each of its cells, with its distance to the pivot and its bound."""
    everyone, every = np.nonzero(cells)
    for start in range(0, max(1, len(everyone)), OUT_ROWS):
        who, which = everyone[start : start + OUT_ROWS], every[start : start + OUT_ROWS]
        at = pa.array(who)
        columns = [b.column(0).take(at), b.column(1).take(at), pa.array(which.astype(np.int32)), pa.array(gaps[who, which]), pa.array(bound[who])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "r", "bound"])


def _search(
    aimed: DataFrame, rows: DataFrame, cells: DataFrame, width: int, query_rows: int, k: int, p: int, skip_self: bool
) -> DataFrame:
    """The best rows of each cell's blocks for the queries sent to it, block of queries by block of rows."""
    small = F.broadcast(cells)  # one row per cell
    count = aimed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).cast("int").alias("q_blocks"))
    count = F.broadcast(count)  # one row per cell
    left = aimed.join(small, "cell").join(count, "cell").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
    left = left.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "q_blocks")
    right = rows.join(small, "cell").join(count, "cell").withColumn("tb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).drop("blocks", "q_blocks")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        near = a["r"].to_numpy(), a["bound"].to_numpy()
        y = b["y"].to_numpy().astype(float) if b.num_rows else np.zeros(0)
        return _best(
            _matrix(a["v"], width), a["id"].to_numpy(), near, _matrix(b["v"], width), b["id"].to_numpy(), b["r"].to_numpy(), y, k, p, skip_self
        )

    tile = ["cell", "qb", "tb"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(search, FOUND)


def vote(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """Class of each query: the largest (weighted) vote, ties to the lowest class."""
    weighted = _weighted(found, weights)
    votes = weighted.groupBy("query_id", "outcome").agg(F.sum("w").alias("w"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("w")).alias("m"), "outcome")).alias("b"))
    return best.select("query_id", F.col("b.outcome").alias("prediction"))


def average(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """Mean outcome of the neighbours of each query."""
    weighted = _weighted(found, weights)
    mean = F.sum(F.col("w") * F.col("outcome")) / F.sum("w")
    return weighted.groupBy("query_id").agg(mean.alias("prediction"))


def _weighted(found: DataFrame, weights: str) -> DataFrame:
    if weights == "uniform":
        return found.withColumn("w", F.lit(1.0))
    # With an exact hit only the exact hits count; k rows per query at most.
    nearest_gap = F.min("distance").over(Window.partitionBy("query_id"))
    hit = F.when(F.col("distance") == 0, 1.0).otherwise(0.0)
    return found.withColumn("w", F.when(nearest_gap == 0, hit).otherwise(1.0 / F.col("distance")))
