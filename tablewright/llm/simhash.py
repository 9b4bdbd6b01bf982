"""Near duplicates by SimHash fingerprints, found with BK-trees.

Two 64-bit fingerprints that differ in at most ``radius`` bits agree in at least one
of radius + 1 blocks of bits, so the fingerprints that agree in a block form a shard
and every link lies within a shard. Each shard gets a BK-tree: the children of a node
are keyed by their integer Hamming distance to it, and a search follows only the edges
whose key is within the radius of the distance to the node. A tree is as large as its
shard, so it is built next to the fingerprints that search it instead of being
broadcast; a shard of more than ``shard_rows`` is cut into parts, and every pair of
parts is searched: one part's tree by the other part's fingerprints.

Searching yields no pairs: a task joins what it links at once and gives back, per
fingerprint, the smallest one it is joined with.

``near_duplicates`` finds every link within a small radius. Texts whose similarity puts their
fingerprints many bits apart are for ``shingle_sets``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable, id_and_text, text_hash
from tablewright.llm.components import components

BITS = 64
#: Largest shard that one task searches as a whole.
SHARD_ROWS = 20_000
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of a text given as UTF-8: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    firsts, lasts = starts[:n].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _SLICE):
        part = [hash_of(joined[i:j], seed) for i, j in zip(firsts[k : k + _SLICE], lasts[k : k + _SLICE], strict=True)]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


class BKTree:
    """Children keyed by Hamming distance to their parent."""

    def __init__(self, radius: int):
        self.radius, self.nodes, self.edges = radius, [], []

    def add(self, value: int) -> None:
        nodes, edges = self.nodes, self.edges
        if nodes:
            at = 0
            while True:
                d = (nodes[at] ^ value).bit_count()
                below = edges[at].get(d)
                if below is None:
                    edges[at][d] = len(nodes)
                    break
                at = below
        nodes.append(value)
        edges.append({})

    def near(self, value: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        if not self.nodes:
            return []
        nodes, edges, radius, found, open_ = self.nodes, self.edges, self.radius, [], [0]
        while open_:
            at = open_.pop()
            d = (nodes[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = edges[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    open_ += [c for key, c in below.items() if d - radius <= key <= d + radius]
                else:
                    open_ += [below[key] for key in range(d - radius, d + radius + 1) if key in below]
        return found


def joined_in_shard(tree_side: list[tuple], search_side: list[tuple] | None, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node it is joined with) for the rows (fingerprint, node) of a shard that have a link.

    With ``search_side`` None the rows of the tree search it themselves.
    """
    tree, rows, parent = BKTree(radius), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(row: tuple, found: list[int]) -> None:
        k = top = len(rows)
        rows.append(row)
        parent.append(k)
        for j in found:
            other = root(j)
            if other == top:
                continue  # joined already by a nearer way
            if rows[other][1] < rows[top][1]:
                top, other = other, top
            parent[other] = top

    for row in tree_side:
        found = tree.near(row[0]) if search_side is None else []
        tree.add(row[0])
        add(row, found)
    for row in search_side or []:
        found = tree.near(row[0])
        if found:
            add(row, found)
    return [(rows[i][1], rows[r][1]) for i in range(len(rows)) if (r := root(i)) != i]


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_no, text_hash and fp (the fingerprint as a long) per row."""
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "row_no", text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column(3)], np.uint64)
            columns = [*b.columns[:3], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_no", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, row_no long, text_hash long, fp long")


def equal_blocks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks of bits: fingerprints within the radius agree in one of them."""
    masks, at = [], 0
    for k in range(radius + 1):
        width = (BITS - at) // (radius + 1 - k)
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def shard_links(values: DataFrame, masks: list[int], radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between the nodes of ``values`` (fp, node) that lie near each other in a shard.

    A shard holds the values that agree in the bits of one of the masks. At most
    one link per value and search comes out.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(
        *[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)]
    )
    spread = values.select("fp", "node", F.explode(keys).alias("key"))
    spread = spread.select("fp", "node", "key.block", "key.part")
    sizes = durable(spread.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = attach(spread, sizes, ["block", "part"], "n")
    # Part numbers come from the value alone, so a task that runs again deals alike.
    cuts = F.ceil(F.col("n") / shard_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp", "node"), cuts).cast("int")
    rows = rows.select("*", cuts.alias("cuts"), mine.alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    rows = rows.select("*", other).select(
        "block",
        "part",
        F.least("mine", "other").alias("tree"),
        F.greatest("mine", "other").alias("search"),
        "mine",
        "fp",
        "node",
    )
    keys = ["block", "part", "tree", "search"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple | None, sides: list[list[tuple]]) -> list[tuple[int, int]]:
            if key is None:
                return []
            within = key[2] == key[3]
            return joined_in_shard(sides[0], None if within else sides[1], radius)

        now, sides, out = None, [[], []], []
        for b in batches:
            for *key, mine, fp, node in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if tuple(key) != now:
                    out += done(now, sides)
                    now, sides = tuple(key), [[], []]
                sides[int(mine != key[2])].append((fp & 0xFFFFFFFFFFFFFFFF, node))
            yield _link_batch(out)
            out = []
        yield _link_batch(done(now, sides))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    radius: int = 2,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of texts whose fingerprints differ in ``radius`` bits or fewer, directly or by others.

    Returns a row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable, itself included), kept (one row of each
    component: that doc_id's first row), text_hash.

    Texts with fewer words than a shingle are one shingle; texts without words, null
    and empty ones included, have fingerprint zero and link like any other. Rows
    without doc_id link too, but give a component its id (then null) only where all
    its rows lack one. Repeated rows fall into one component. An empty table gives
    an empty result; further columns are not read.
    """
    rows = durable(fingerprints(docs, shingle_words, id_col, text_col))
    return _joined(rows, equal_blocks(radius), radius, shard_rows)


def _joined(rows: DataFrame, masks: list[int], radius: int, shard_rows: int) -> DataFrame:
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("best")
    values = durable(rows.groupBy("fp").agg(best, F.count(F.lit(1)).alias("n_rows")).withColumn("node", F.col("best.row_no")))
    return _components_of(rows, values, ["fp"], shard_links(values.select("fp", "node"), masks, radius, shard_rows))


def _components_of(rows: DataFrame, values: DataFrame, keys: list[str], links: DataFrame) -> DataFrame:
    """The result from ``values`` (the keys, node, best, n_rows), a row per node, and links between nodes."""
    roots = components(links)
    linked = durable(values.join(roots, "node"))
    per_root = durable(linked.groupBy("root").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("n_values")))
    first = attach(linked.select("node", "root"), per_root, ["root"], "n_values").select("node", "first")
    classes = values.join(first, "node", "left").select(*keys, "n_rows", F.coalesce("first", "best").alias("first"))
    return attach(rows, durable(classes), keys, "n_rows").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_hash",
    )
