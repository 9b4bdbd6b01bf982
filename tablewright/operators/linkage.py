"""Agglomerative clustering by single linkage: a spanning forest of near rows, cut at a height.

Single linkage at every height is decided by a minimum spanning forest. Tiles of rows
that are near in space give their own spanning forests; an edge that is the longest of a cycle
within a tile is in no minimum forest at all, so what leaves a tile has fewer edges
than rows. Borůvka rounds join these into the forest of the whole table. On a line the
forest is known without tiles: only neighbours in the order are in it. A cut at a fixed height
needs no forest: rows of a small cell are linked whatever their number, and only cells that are
not yet joined compare their rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.operators.cluster import complete_rows
from tablewright.operators.joins import lookup_join, materialize
from tablewright.operators.ordering import global_index
from tablewright.session import durable

#: Rows of a block; a tile is one block or two. Columns that cells are cut along.
BLOCK_ROWS, CELL_COLUMNS = 1024, 2


def _local_forest(ids: np.ndarray, points: np.ndarray, radius: float) -> list[tuple[int, int, float]]:
    """Prim's minimum spanning forest of the pairs within ``radius``; equal lengths go by the smaller ids."""
    order = np.argsort(ids)
    ids, points = ids[order], points[order]
    n, found = len(ids), []
    length, other, out = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    now = 0
    for _ in range(n):
        out[now] = True
        gap = np.sqrt(((points - points[now]) ** 2).sum(axis=1))
        gap[gap > radius] = np.inf
        at = np.arange(n)
        low, high = np.minimum(at, now), np.maximum(at, now)
        old_low, old_high = np.minimum(at, other), np.maximum(at, other)
        first = (low < old_low) | ((low == old_low) & (high < old_high))
        closer = ~out & np.isfinite(gap) & ((gap < length) | ((gap == length) & first))
        length[closer], other[closer] = gap[closer], now
        left = np.flatnonzero(~out)
        if not len(left):
            break
        least = left[length[left] == length[left].min()]
        if not np.isfinite(length[least[0]]):
            now = int(left[0])
            continue
        low, high = np.minimum(least, other[least]), np.maximum(least, other[least])
        now = int(least[np.lexsort((high, low))[0]])
        a, b = sorted((int(ids[now]), int(ids[other[now]])))
        found.append((a, b, float(length[now])))
    return found


def _points(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """id and p (the values) of the rows with an id and all values, one row for each id."""
    point = F.array(*[quoted(c).cast("double") for c in cols])
    rows = complete_rows(df, cols).where(quoted(id_col).isNotNull())
    return rows.select(quoted(id_col).cast("long").alias("id"), point.alias("p")).dropDuplicates(["id"])


def _line_edges(points: DataFrame, radius: float) -> DataFrame:
    """The forest on a line: equal values hang on their smallest id, those ids are joined in the order of the values.

    Any other pair spans a gap at least as long as each gap within it.
    """
    rows = durable(points.select("id", F.col("p")[0].alias("x")))
    heads = materialize(rows.groupBy("x").agg(F.min("id").alias("head")))
    same = lookup_join(rows, heads, ["x"]).where("id <> head")
    same = same.select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight"))
    placed = durable(global_index(heads.df, ["x"], "i", heads.rows))
    after = placed.select((F.col("i") - 1).alias("i"), F.col("x").alias("next_x"), F.col("head").alias("next"))
    gaps = placed.join(after, "i").select(F.least("head", "next").alias("a"), F.greatest("head", "next").alias("b"), (F.col("next_x") - F.col("x")).alias("weight"))
    return durable(same.unionByName(gaps.where(F.col("weight") <= radius)))


def near_edges(
    df: DataFrame, id_col: str, cols: Sequence[str], radius: float, block_rows: int = BLOCK_ROWS, cell_columns: int = CELL_COLUMNS
) -> DataFrame:
    """a, b (a < b), weight: edges of at most ``radius`` whose minimum spanning forest is that of all such pairs.

    Ids are unique whole numbers; of rows that repeat one, one is taken. Rows without id
    or with a missing value have no edges. Distances are Euclidean. Cells as wide as the radius
    along the first columns hold what can be near; a full cell is cut into blocks, and each
    pair of blocks of a cell or of adjacent cells is a tile. So the work grows with the
    square of the rows in a cell, the edges do not. One column takes a sort only.
    """
    if not radius > 0:
        raise ValueError("the radius is above 0")
    rows = _points(df, id_col, cols)
    if len(cols) == 1:
        return _line_edges(rows, radius)
    axes = range(min(cell_columns, len(cols)))
    rows = rows.withColumn("at", F.array(*[F.floor(F.col("p")[i] / radius).cast("long") for i in axes]))
    rows = durable(rows.withColumn("cell", F.array_join("at", ",")))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"), F.first("at").alias("at"))
    sizes = durable(sizes)
    placed = lookup_join(rows.drop("at"), materialize(sizes.drop("at")), ["cell"])
    placed = durable(placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"))
    # Tiles: a block with itself, with later blocks of its cell, with all blocks of the adjacent cells behind it.
    behind = [m for m in itertools.product((-1, 0, 1), repeat=len(axes)) if m > (0,) * len(axes)]
    moves = F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in behind])
    there = F.explode(F.transform(moves, lambda m: F.array_join(F.zip_with("at", m, lambda c, x: c + x), ","))).alias("there")
    across = sizes.select("cell", "blocks", there).join(
        sizes.select(F.col("cell").alias("there"), F.col("blocks").alias("their_blocks")), "there"
    )
    within = sizes.select(F.col("cell").alias("there"), "cell", "blocks", F.col("blocks").alias("their_blocks"))
    pairs = across.select("there", "cell", "blocks", "their_blocks").unionByName(within)
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("their_blocks") - 1)))
    pairs = pairs.where("cell <> there or block < their or (blocks = 1 and block = their)")
    tile = F.xxhash64("cell", "block", "there", "their").alias("tile")
    pairs = durable(pairs.select(tile, "cell", "block", "there", "their"))
    one = pairs.select("tile", "cell", "block")
    two = pairs.where("cell <> there or block <> their").select("tile", F.col("there").alias("cell"), F.col("their").alias("block"))
    members = placed.join(one.unionByName(two), ["cell", "block"]).select("tile", "id", "p")
    width = len(cols)

    def forest(table: pa.Table) -> pa.Table:
        points = table["p"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        found = _local_forest(table["id"].to_numpy(), points, radius)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("a", "b", "weight"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return members.groupBy("tile").applyInArrow(forest, "a long, b long, weight double").distinct()


def near_forest(df: DataFrame, id_col: str, cols: Sequence[str], radius: float) -> DataFrame:
    """a, b, weight: the minimum spanning forest of the pairs at most ``radius`` apart."""
    edges = near_edges(df, id_col, cols, radius)
    return edges if len(cols) == 1 else spanning_forest(edges)


def _cell_links(rows: DataFrame, open_pairs: DataFrame, radius: float, block_rows: int) -> DataFrame:
    """a, b: the pairs of cells (node, their) of ``open_pairs`` that hold two rows at most ``radius`` apart.

    Blocks of both cells meet in tiles; a tile lets out one row at most.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    wanted = open_pairs.select(F.col("cell").alias("c")).unionByName(open_pairs.select(F.col("there").alias("c"))).distinct()
    sizes = durable(sizes.join(wanted.withColumnRenamed("c", "cell"), "cell"))
    placed = lookup_join(rows, materialize(sizes), ["cell"]).where("blocks is not null")
    placed = durable(placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"))
    theirs = sizes.select(F.col("cell").alias("there"), F.col("blocks").alias("their_blocks"))
    tiles = open_pairs.select("cell", "there", "node", "their").join(sizes, "cell").join(theirs, "there")
    tiles = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = durable(tiles.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("their_blocks") - 1))))
    one = tiles.select("node", "their", "i", "j", "cell", F.col("i").alias("block"), F.lit(0).alias("side"))
    two = tiles.select("node", "their", "i", "j", F.col("there").alias("cell"), F.col("j").alias("block"), F.lit(1).alias("side"))
    members = placed.join(one.unionByName(two), ["cell", "block"]).select("node", "their", "i", "j", "side", "p")

    def link(table: pa.Table) -> pa.Table:
        points = np.array(table["p"].to_pylist(), float)
        side = table["side"].to_numpy()
        left, right = points[side == 0], points[side == 1]
        near = any((np.sqrt(((right - p) ** 2).sum(axis=1)) <= radius).any() for p in left)
        return table.select(["node", "their"]).slice(0, int(near)).rename_columns(["a", "b"])

    return members.groupBy("node", "their", "i", "j").applyInArrow(link, "a long, b long").distinct()


def linked_clusters(df: DataFrame, id_col: str, cols: Sequence[str], radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node and cluster (its smallest node): rows that pairs at most ``radius`` apart join, directly or by others.

    Rows of a cell are all linked, because its diagonal is below the radius. Cells are
    joined by the outermost rows of each; only near cells that this leaves apart compare
    their rows. For rows without gaps, of few columns.
    """
    # Short of the diagonal, so that rounding lets no cell grow beyond the radius.
    side, reach = 0.999 * radius / math.sqrt(len(cols)), math.ceil(math.sqrt(len(cols)) / 0.999)
    axes = range(len(cols))
    rows = _points(df, id_col, cols).withColumn("at", F.array(*[F.floor(F.col("p")[i] / side).cast("long") for i in axes]))
    rows = durable(rows.withColumn("cell", F.array_join("at", ",")))
    corners = [f(F.col("p"), F.col("p")[i]) for i in axes for f in (F.min_by, F.max_by)]
    cells = rows.groupBy("cell").agg(F.first("at").alias("at"), F.min("id").alias("node"), F.array(*corners).alias("corners"))
    cells = durable(cells)
    moves = [m for m in itertools.product(range(-reach, reach + 1), repeat=len(cols)) if m > (0,) * len(cols)]
    moves = F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in moves])
    there = F.explode(F.transform(moves, lambda m: F.array_join(F.zip_with("at", m, lambda c, x: c + x), ","))).alias("there")
    theirs = cells.select(F.col("cell").alias("there"), F.col("node").alias("their"), F.col("corners").alias("their_corners"))
    pairs = cells.select("cell", "node", "corners", there).join(theirs, "there")

    def squares(a, b):
        return sum(((a[i] - b[i]) * (a[i] - b[i]) for i in axes), F.lit(0.0))

    near = F.exists("corners", lambda a: F.exists("their_corners", lambda b: F.sqrt(squares(a, b)) <= radius))
    # The gap between the boxes of the rows; corners 2 i and 2 i + 1 have the least and greatest value of column i.
    c, t = F.col("corners"), F.col("their_corners")
    gaps = [F.greatest(c[2 * i][i] - t[2 * i + 1][i], t[2 * i][i] - c[2 * i + 1][i], F.lit(0.0)) for i in axes]
    close = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) <= radius * (1 + 1e-9)
    pairs = durable(pairs.where(close).select("cell", "node", "there", "their", near.alias("near")))
    sure = pairs.where("near").select(F.col("node").alias("a"), F.col("their").alias("b"))
    nodes = cells.select("node")
    labels = components(nodes, sure)
    table = materialize(labels)
    left = pairs.where("not near")
    for column in ("node", "their"):
        renamed = materialize(table.df.select(F.col("node").alias(column), F.col("component").alias(f"{column}_of")))
        left = lookup_join(left, renamed, [column])
    left = durable(left.where("node_of <> their_of"))
    if not left.isEmpty():
        more = _cell_links(rows.drop("at"), left, radius, block_rows)
        labels = components(nodes, sure.unionByName(more))
    labels = cells.select("cell", "node").join(labels, "node").select("cell", F.col("component").alias("cluster"))
    return lookup_join(rows.select("id", "cell"), materialize(labels), ["cell"]).select(F.col("id").alias("node"), "cluster")


def _roots(hooks: DataFrame) -> DataFrame:
    """node, root for (node, above): the end of each chain, by doubling its steps. Chains end in themselves."""
    held = durable(hooks)
    while True:
        steps = held.withColumnRenamed("above", "root")
        # A checkpoint for every three doublings, which end most chains.
        for _ in range(3):
            upper = steps.select(F.col("node").alias("via"), F.col("root").alias("end"))
            steps = steps.select("node", F.col("root").alias("via")).join(upper, "via").select("node", "via", F.col("end").alias("root"))
        steps = durable(steps.select("node", "root", (F.col("via") != F.col("root")).alias("moved")))
        if steps.where("moved").isEmpty():
            return steps.select("node", "root")
        held = steps.select("node", F.col("root").alias("above"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest (a, b, weight) of ``edges`` by Borůvka rounds; equal weights go by (a, b).

    Each round takes the least edge of every component, joins components along them and
    keeps one least edge between any two. Components at least halve in a round. A component
    with a third of all edges is a hot key of the joins only, which salt it.
    Edges of a node with itself and with null ends or null or NaN weight are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    live = edges.where("a is not null and b is not null and a <> b and weight is not null and not isnan(weight)")
    live = live.select(low.alias("a"), high.alias("b"), "weight")
    live = durable(live.groupBy("a", "b").agg(F.min("weight").alias("weight")).selectExpr("a", "b", "weight", "a as ca", "b as cb"))
    forest = live.select("a", "b", "weight").limit(0)
    while not live.isEmpty():
        edge = F.struct("weight", "a", "b")
        ends = live.select(F.col("ca").alias("node"), F.col("cb").alias("above"), edge.alias("e"))
        ends = ends.unionByName(live.select(F.col("cb").alias("node"), F.col("ca").alias("above"), edge.alias("e")))
        best = durable(ends.groupBy("node").agg(F.min(F.struct("e", "above")).alias("best")))
        forest = durable(forest.unionByName(best.select("best.e.a", "best.e.b", "best.e.weight").distinct()))
        # Two components that chose each other: the smaller one is the end of the chain.
        hooks = best.select("node", F.col("best.above").alias("above"))
        back = hooks.select(F.col("node").alias("above"), F.col("above").alias("back"))
        hooks = hooks.join(back, "above")
        ends_here = (F.col("back") == F.col("node")) & (F.col("node") < F.col("above"))
        roots = _roots(hooks.select("node", F.when(ends_here, F.col("node")).otherwise(F.col("above")).alias("above")))
        table = materialize(roots)
        for c in ("ca", "cb"):
            renamed = materialize(table.df.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")))
            live = lookup_join(live, renamed, [c])
        live = live.where("ca_root <> cb_root").select(
            "a", "b", "weight", F.least("ca_root", "cb_root").alias("ca"), F.greatest("ca_root", "cb_root").alias("cb")
        )
        live = live.groupBy("ca", "cb").agg(F.min(F.struct("weight", "a", "b")).alias("e"))
        live = durable(live.select("e.a", "e.b", "e.weight", "ca", "cb"))
    return forest


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``nodes`` (node) and of ``edges`` (a, b).

    Rounds of hooking each component to its smallest neighbour, as ``spanning_forest``.
    """
    live = durable(edges.where("a <> b").select(F.col("a").alias("ca"), F.col("b").alias("cb")).distinct())
    every = nodes.select("node").unionByName(live.select(F.col("ca").alias("node"))).unionByName(live.select(F.col("cb").alias("node")))
    of = durable(every.where("node is not null").distinct().withColumn("component", F.col("node")))
    while not live.isEmpty():
        ends = live.selectExpr("ca as node", "cb as above").unionByName(live.selectExpr("cb as node", "ca as above"))
        least = ends.groupBy("node").agg(F.min("above").alias("above"))
        roots = materialize(_roots(least.select("node", F.least("node", "above").alias("above"))))
        for c in ("ca", "cb"):
            renamed = materialize(roots.df.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")))
            live = lookup_join(live, renamed, [c])
        live = live.where("ca_root <> cb_root").select(
            F.least("ca_root", "cb_root").alias("ca"), F.greatest("ca_root", "cb_root").alias("cb")
        )
        live = durable(live.distinct())
        renamed = materialize(roots.df.select(F.col("node").alias("component"), "root"))
        of = durable(lookup_join(of, renamed, ["component"]).select("node", F.coalesce("root", "component").alias("component")))
    return of


def merge_heights(forest: DataFrame) -> DataFrame:
    """The dendrogram as its merges: a, b, weight and step (from 1), lowest first, equal heights by (a, b).

    A merge joins the clusters of a and b at height weight; cutting keeps the steps below it.
    """
    held = durable(forest.select("a", "b", "weight"))
    return global_index(held, ["weight", "a", "b"], "step", held.count()).withColumn("step", F.col("step") + 1)


def cut_forest(nodes: DataFrame, forest: DataFrame, height: float | None = None, clusters: int | None = None) -> DataFrame:
    """node, cluster (its smallest node): the forest without the edges above ``height``, or with that many clusters.

    With ``clusters`` the longest edges go first, equal ones the larger (a, b) first; a
    forest that falls into more parts than asked for stays as it is.
    """
    if (height is None) == (clusters is None):
        raise ValueError("give either height or clusters")
    if height is not None:
        kept = forest.where(F.col("weight") <= height)
    else:
        held = durable(forest.select("a", "b", "weight"))
        every = nodes.select("node").where("node is not null").distinct().count()
        away = max(0, clusters - (every - held.count()))
        # As many rows as clusters asked for.
        longest = held.orderBy(F.desc("weight"), F.desc("a"), F.desc("b")).limit(away).select("a", "b")
        kept = held.join(longest, ["a", "b"], "left_anti")
    return components(nodes, kept).withColumnRenamed("component", "cluster")


def single_linkage(
    df: DataFrame, id_col: str, cols: Sequence[str], radius: float, height: float | None = None, clusters: int | None = None
) -> DataFrame:
    """id and cluster (its smallest id) by single linkage of rows at most ``radius`` apart.

    Exact for heights up to the radius (which is the height, if none is given). Rows with a
    missing value are clusters of their own, rows without id are left out.
    """
    nodes = df.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("node"))
    if height is None and clusters is None:
        height = radius
    if height is not None and height > radius:
        raise ValueError("the height lies above the radius")
    if height is not None and height > 0 and clusters is None and len(cols) <= CELL_COLUMNS:
        found = linked_clusters(df, id_col, cols, height)
        labelled = nodes.distinct().join(found, "node", "left")
        return labelled.select(F.col("node").alias("id"), F.coalesce("cluster", "node").alias("cluster"))
    forest = near_forest(df, id_col, cols, radius)
    return cut_forest(nodes, forest, height, clusters).withColumnRenamed("node", "id")


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """size and clusters: how many clusters have how many rows."""
    sizes = labels.groupBy(quoted(cluster)).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
