"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the basis of the principal axes of
all vectors, largest variance first, which leaves cosines as they are. A tile compares
a block of searching vectors with a block of others: it accumulates the products of the
leading axes first, bounds what the remaining axes can add by the product of the two
suffix norms (Cauchy-Schwarz), and goes on only with pairs that can still reach the
threshold. The last word has the cosine of the vectors as given, in double precision.

Two vectors with cosine t or more are at most sqrt(2 - 2 t) apart, along each axis
too. So vectors lie in cells of that width along the first axes, and a vector is
compared with its own and the adjacent cells only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable
from tablewright.llm.components import components

#: Rows of a block; a tile is two blocks.
BLOCK_ROWS = 1024
#: First axes that cells are cut along, and how many axes a step accumulates.
CELL_AXES, STEP_AXES = 2, 8
#: Largest dimension: the matrix of second moments is the only thing that reaches the driver.
MAX_DIM = 2048
_SLACK = 1e-9
#: Pairs whose exact cosines are computed at a time.
_PAIRS = 1 << 15


def unit_rows(vectors: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Places and unit vectors of the usable entries: not null, not zero, finite throughout."""
    places, out = [], []
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or None in v:
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max(initial=0.0)
        if not top or not np.isfinite(top):
            continue
        x /= top
        places.append(i)
        out.append(x / math.sqrt(float(x @ x)))
    return places, out


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the orthonormal axes of all its vectors, largest second moment first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            by_dim: dict[int, list] = {}
            for v in b.column(0).to_pylist():
                by_dim.setdefault(len(v), []).append(v)
            for d, rows in by_dim.items():
                x = np.array(rows)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = (a.astype(np.int32) for a in np.triu_indices(d))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "v"]
            )

    parts = units.select("unit").mapInArrow(moments, "d int, i int, j int, v double")
    found: dict[int, np.ndarray] = {}
    for d, i, j, v in parts.groupBy("d", "i", "j").agg(F.sum("v")).collect():
        m = found.setdefault(d, np.zeros((d, d)))
        m[i, j] = m[j, i] = v
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in found.items()}


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP_AXES) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs that can reach the threshold; a and b are in PCA order."""
    width = a.shape[1]
    tail_a = np.sqrt(np.maximum(np.cumsum((a**2)[:, ::-1], axis=1)[:, ::-1], 0))
    tail_b = np.sqrt(np.maximum(np.cumsum((b**2)[:, ::-1], axis=1)[:, ::-1], 0))
    k = min(step, width)
    so_far = a[:, :k] @ b[:, :k].T
    bound = so_far if k == width else so_far + np.outer(tail_a[:, k], tail_b[:, k])
    i, j = np.nonzero(bound >= threshold - _SLACK)
    so_far = so_far[i, j]
    while k < width and len(i):
        upto = min(2 * k, width)
        for axis in range(k, upto):
            so_far = so_far + a[i, axis] * b[j, axis]
        k = upto
        bound = so_far if k == width else so_far + tail_a[i, k] * tail_b[j, k]
        alive = bound >= threshold - _SLACK
        i, j, so_far = i[alive], j[alive], so_far[alive]
    return i, j


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def joined_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every group of the links (a, b), and the smallest group that the links join it with."""
    groups, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends.reshape(2, -1)
    root = np.arange(len(groups))
    while len(i):
        # The larger root of a link hangs on the smaller one, then every group on its root.
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return groups, groups[root]


def _compare(parts: list[tuple], axes: dict[int, np.ndarray], threshold: float) -> list[np.ndarray]:
    """Rows (group, number of others' rows linked to a searching group, smallest group joined) for one tile's links."""
    if not parts:
        return []
    mine, group, size, raw = (np.concatenate([p[k] for p in parts]) for k in range(4))
    raw = raw.astype(np.float64)
    turned = raw / np.abs(raw).max(axis=1, keepdims=True)
    turned = turned / np.sqrt(np.einsum("ij,ij->i", turned, turned))[:, None] @ axes[raw.shape[1]]
    a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
    i, j = tile_links(turned[a], turned[b], threshold)
    i, j = a[i], b[j]
    sure = group[i] != group[j]
    for k in range(0, len(i), _PAIRS):
        part = slice(k, k + _PAIRS)
        sure[part] &= _cosines(raw[i[part]], raw[j[part]]) >= threshold
    i, j = i[sure], j[sure]
    linked = np.bincount(i, size[j].astype(float), len(mine)).astype(np.int64)
    if not len(i):
        return []
    hit = np.flatnonzero(linked)
    groups, least = joined_groups(group[i], group[j])
    counted = np.zeros(len(groups), np.int64)
    counted[np.searchsorted(groups, group[hit])] = linked[hit]
    return [np.stack([groups, counted, least], axis=1)]


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
    cell_axes: int = CELL_AXES,
) -> DataFrame:
    """Links between vectors of one label with cosine ``threshold`` or more.

    Returns a row per row of ``vectors``: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id).

    Null labels link with nothing, nor do vectors that are null, empty, zero, or hold
    null or non-finite components; vectors of different length do not link either.
    Equal vectors are compared once and counted as often as they occur. Rows that
    repeat a vec_id are rows of their own, linked if their vectors are. A row
    without vec_id links and counts, but its own component_id is null unless a row
    with one is reachable. An empty table gives an empty result. The
    comparison is exact, so its work grows with the square of the rows that share a
    label and a place; the rows in flight are bounded by blocks.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"),
        vectors[vector_col].alias("v"),
        vectors[label_col].cast("string").alias("label"),
        F.monotonically_increasing_id().alias("row_no"),
    )

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, out = unit_rows(b.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(places, pa.int64())),
                    b.column(0).take(pa.array(places, pa.int64())),
                    pa.array([u.tolist() for u in out], pa.list_(pa.float64())),
                ],
                ["g", "v", "unit"],
            )

    # Equal vectors of a label are one group; its id is its first row.
    key = F.sha2(F.concat_ws(",", F.to_json(F.struct("label", "v"))), 256).alias("key")
    keyed = durable(rows.select("vec_id", "row_no", "label", "v", key))
    least_id = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least_id")
    groups = durable(
        keyed.groupBy("key").agg(
            F.min("row_no").alias("g"), F.count(F.lit(1)).alias("size"), least_id, F.first("label", True).alias("label")
        )
    )
    single = keyed.where("label is not null").join(groups.select("g", "size"), F.col("row_no") == F.col("g"))
    kind = vectors.select(vectors[vector_col].alias("v")).schema["v"].dataType.simpleString()
    able = single.select("v", "g").mapInArrow(units, f"g long, v {kind}, unit array<double>")
    able = durable(able)
    if (able.agg(F.max(F.size("unit"))).first()[0] or 0) > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} components")
    axes = principal_axes(able)
    reach = math.sqrt(2 - 2 * threshold) * (1 + 1e-6)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = [np.array(u) @ axes[len(u)][:, :cell_axes] for u in b.column(2).to_pylist()]
            cells = [[math.floor(x / reach) for x in t] for t in turned]
            dims = pa.array([len(u) for u in b.column(2)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], dims, pa.array(cells, pa.list_(pa.int32()))], ["g", "v", "dim", "cell"]
            )

    turned = able.mapInArrow(turn, f"g long, v {kind}, dim int, cell array<int>")
    placed = durable(
        turned.join(groups.select("g", "size", "label"), "g").select(
            "g", "v", "size", F.struct("label", "dim", "cell").alias("home")
        )
    )
    per_cell = durable(placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")))
    # The cells around a home, those with rows only, and into how many blocks each is cut.
    moves = F.array(
        *[F.array(*[F.lit(x) for x in m]) for m in itertools.product((-1, 0, 1), repeat=cell_axes)]
    )
    around = F.explode(F.transform(moves, lambda m: F.zip_with("home.cell", m, lambda c, x: c + F.coalesce(x, F.lit(0)))))
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    cells = per_cell.select("home", blocks.alias("blocks"))
    near = cells.select("home", "blocks", around.alias("cell")).distinct()
    near = near.select("home", "blocks", F.struct("home.label", "home.dim", "cell").alias("there"))
    partner = cells.select(F.col("home").alias("there"), F.col("blocks").alias("their_blocks"))
    pairs = durable(near.join(partner, "there"))
    searching = attach(placed, per_cell, ["home"], "n").withColumn("block", F.pmod(F.xxhash64("g"), blocks).cast("int"))
    searching = durable(searching.select("g", "v", "size", "home", "block"))
    sides = []
    for cell, count, side in (("home", "their_blocks", "mine"), ("there", "blocks", "other")):
        # For each cell the list of its tiles' partners: at most 3^cell_axes cells, each with its blocks.
        partners = F.collect_list(F.struct(F.col("there" if side == "mine" else "home").alias("with"), F.col(count).alias("m")))
        listed = pairs.groupBy(F.col(cell).alias("home")).agg(partners.alias("partners"))
        weighed = durable(listed.join(per_cell, "home"))
        spread = attach(searching, weighed, ["home"], "n").withColumn("p", F.explode("partners")).drop("partners", "n")
        spread = spread.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("p.m") - 1)))
        here, away = F.struct("home", "block"), F.struct(F.col("p.with").alias("home"), F.col("b").alias("block"))
        tile = (here, away) if side == "mine" else (away, here)
        sides.append(
            spread.select(
                F.xxhash64(*tile).alias("hash"),
                F.to_json(F.struct(*tile)).alias("tile"),
                F.lit(side == "mine").alias("mine"),
                "g",
                "size",
                "v",
            )
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            if not len(b):
                continue
            tiles, v = b.column(1).to_pylist(), b.column(5)
            ends = v.offsets.to_numpy()
            values = v.values.to_numpy(zero_copy_only=False)
            mine, g, size = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            cuts = [0, *[k for k in range(1, len(tiles)) if tiles[k] != tiles[k - 1]], len(tiles)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if tiles[s] != now:
                    out += _compare(held, axes, threshold)
                    now, held = tiles[s], []
                block = values[ends[s] : ends[e]].reshape(e - s, -1)
                held.append((mine[s:e].astype(bool), g[s:e], size[s:e], block))
            yield _found(out)
            out = []
        yield _found(_compare(held, axes, threshold))

    dealt = sides[0].unionByName(sides[1]).repartition("hash", "tile").sortWithinPartitions("hash", "tile")
    found = durable(dealt.mapInArrow(compare, "g long, linked long, least long"))
    roots = components(found.select(F.col("g").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "g")
    counts = found.groupBy("g").agg(F.sum("linked").alias("linked"))
    linked = durable(roots.join(groups.select("g", "least_id"), "g"))
    per_root = durable(linked.groupBy("root").agg(F.min("least_id").alias("first"), F.count(F.lit(1)).alias("n")))
    first = attach(linked.select("g", "root"), per_root, ["root"], "n").select("g", "first")
    usable = able.select("g", F.lit(True).alias("usable"))
    classes = groups.join(usable, "g", "left").join(counts, "g", "left").join(first, "g", "left")
    classes = durable(classes.select("key", "size", "usable", "linked", "least_id", "first"))
    # Rows that cannot link stand alone, also where their vectors are equal.
    links = F.when(F.col("usable"), F.col("size") - 1 + F.coalesce("linked", F.lit(0))).otherwise(0)
    component = F.when(F.col("usable"), F.coalesce("first", "least_id")["vec_id"]).otherwise(F.col("vec_id"))
    return attach(keyed.select("vec_id", "key"), classes, ["key"], "size").select(
        "vec_id",
        links.cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNotNull() & (F.col("vec_id") == component)).alias("kept"),
    )


def _found(rows: list[np.ndarray]) -> pa.RecordBatch:
    all_rows = np.concatenate([np.zeros((0, 3), np.int64), *rows])
    return pa.RecordBatch.from_arrays([pa.array(all_rows[:, k].copy()) for k in range(3)], ["g", "linked", "least"])
