"""The trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns, known by a digest of it. Most prefixes
belong to one conversation only. A count-min sketch over the digests of all prefixes never
counts too low, so an estimate of one proves a prefix to be single: its node is complete
where it stands. Only prefixes with a higher estimate are shuffled and grouped exactly,
whether they are shared or met others in the sketch by chance.

Turns are sorted over all tasks and numbered there, with what the tasks before hold of the
first conversation handed over as one row per task. So a conversation may have any number
of turns, and a prefix any number of conversations. Sums over subtrees need no walk: each
node's cost and each leaf belong to one conversation, the smallest that has it, and a node
adds up the conversations that pass through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable

#: Rows and cells (a power of two) of the sketch; its size, SKETCH_ROWS x SKETCH_CELLS bytes, does not grow with the data.
SKETCH_ROWS, SKETCH_CELLS = 4, 1 << 20
_BLOCK = 1 << 16

#: Prefix digests are polynomials over the turns' digests, so that stretches of a conversation can be joined.
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
ROOT = bytes(16)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, and chars (code points of the text) of each turn.

    Turns are ordered by number, null first; turns of one number by their digest. Null
    role or text counts as empty. Rows without conv_id belong to no conversation and go.
    """
    role, text = F.coalesce(rows[role_col], F.lit("")), F.coalesce(rows[text_col], F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    read = rows.select(
        rows[id_col].cast("long").alias("conv_id"),
        rows[turn_col].alias("turn"),
        F.substring(F.unhex(F.sha2(framed, 256)), 1, 16).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row_no"),
    ).where("conv_id is not null")
    dealt = _in_order(read, "conv_id", F.asc_nulls_first("turn"), "digest", "row_no")
    before, _ = _handed_over(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for b in batches:
            pos = []
            for part, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if conv != now:
                    n = before[part][1] if now is None and before[part][0] == conv else 0
                    now = conv
                n += 1
                pos.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(pos, pa.int64()), b.column(2), b.column(3)], ["conv_id", "pos", "digest", "chars"]
            )

    return dealt.mapInArrow(run, "conv_id long, pos long, digest binary, chars long")


def _in_order(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """part, conv_id, digest, chars in the order of the keys within and across partitions, kept."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return durable(dealt.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "chars"))


def _add(so_far: int, digest: bytes) -> int:
    return (so_far * _BASE + int.from_bytes(digest, "big") + 1) % _PRIME


def _handed_over(dealt: DataFrame) -> tuple[dict[int, tuple], set[int]]:
    """What each partition finds of its first conversation (id, turns, digest), and which ones' last goes on.

    The driver gets one row per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = at = None
        n, value, single = 0, 0, True
        for b in batches:
            for part, conv, digest in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != now:
                    single = now is None
                    first, at = (conv, part) if now is None else (first, at)
                    now, n, value = conv, 0, 0
                n, value = n + 1, _add(value, digest)
        if now is not None:
            row = {"part": [at], "first": [first], "last": [now], "n": [n], "value": [value.to_bytes(16, "big")], "single": [single]}
            yield pa.RecordBatch.from_pydict(row, schema=_STRETCH)

    rows = dealt.mapInArrow(run, "part int, first long, last long, n long, value binary, single boolean").collect()
    before, goes_on, held = {}, set(), (None, 0, 0, None)
    for r in sorted(rows, key=lambda r: r.part):
        conv, n, value, part = held
        if conv == r.first:
            goes_on.add(part)
        before[r.part] = (conv, n, value)
        mine = int.from_bytes(r.value, "big")
        if r.single and conv == r.first:
            n, value = n + r.n, (value * pow(_BASE, r.n, _PRIME) + mine) % _PRIME
        else:
            n, value = r.n, mine
        held = (r.last, n, value, r.part)
    return before, goes_on


_STRETCH = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("value", pa.binary()), ("single", pa.bool_())]
)


def borrow_heads(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first head(c) turns are those of conversation base(c), and all members with their length.

    The base gives all its turns if it has fewer, none if it is absent; a conversation's
    own turns follow from its head(c)-th on. ``most`` is the largest head.
    """
    turns = durable(turns)
    lengths = durable(turns.groupBy("conv_id").agg(F.max("pos").alias("n")))
    c = F.col("conv_id")
    asked = lengths.select("conv_id", "n", base(c).cast("long").alias("base"), head(c).cast("long").alias("head"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = asked.join(bases, "base", "left")
    known = durable(known.withColumn("lent", F.least("head", F.coalesce("base_n", F.lit(0)))))
    own = turns.join(known.select("conv_id", "head", "lent"), "conv_id").where("pos > head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("lent")).alias("pos"), "digest", "chars")
    first = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    lent = known.select("conv_id", "base", "lent").join(first, "base").where("pos <= lent")
    members = known.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n"))
    return own.unionByName(lent.select("conv_id", "pos", "digest", "chars")), members


def cells_of(digests: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The sketch cell of each digest (two 64-bit halves) in a row of the sketch."""
    x = digests[:, 0] * np.uint64(0x9E3779B97F4A7C15 + 2 * row) + digests[:, 1] * np.uint64(2 * row + 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(cells)).astype(np.int64)


def _halves(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<u8").reshape(-1, 2)


def sketch(dealt: DataFrame, cells: int, rows: int = SKETCH_ROWS, digests: Callable = lambda batches: batches) -> np.ndarray:
    """Cells of a count-min sketch over the column q, counted up to two: ``rows`` x ``cells`` bytes at the driver.

    ``digests`` makes the batches with q out of those of ``dealt``, in the task that counts them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, cells), np.uint8)
        for b in digests(batches):
            halves = _halves(b.column("q"))
            for r in range(rows):
                at, n = np.unique(cells_of(halves, r, cells), return_counts=True)
                table[r, at] = np.minimum(table[r, at] + np.minimum(n, 2), 2)
        flat = table.ravel()
        for k in range(0, len(flat), _BLOCK):
            if (part := flat[k : k + _BLOCK]).any():
                packed = zstandard.ZstdCompressor(level=1).compress(part.tobytes())
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // _BLOCK], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for packed in table["counts"]:
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8)
            total = part if total is None else np.minimum(total + part, 2).astype(np.uint8)
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = dealt.mapInArrow(count, "block int, counts binary")
    out = np.zeros(rows * cells, np.uint8)
    for block, counts in found.groupBy("block").applyInArrow(merge, "block int, counts binary").collect():
        out[block * _BLOCK : block * _BLOCK + len(counts)] = np.frombuffer(counts, np.uint8)
    return out.reshape(rows, cells)


def _prefixes(before: dict, goes_on: set) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From turns in order to conv_id, depth, q (the prefix), above (the one a turn shorter), chars, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, value, held = None, 0, 0, None
        for b in batches:
            out = []
            for part, conv, digest, chars in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != now:
                    n, value = before[part][1:] if now is None and before[part][0] == conv else (0, 0)
                    now = conv
                if held:
                    out.append((*held, held[0] != conv))
                above, value, n = value, _add(value, digest), n + 1
                held = (conv, n, value.to_bytes(16, "big"), above.to_bytes(16, "big"), chars)
                at = part
            yield _rows(out, _PREFIX)
        if held:
            yield _rows([(*held, at not in goes_on)], _PREFIX)

    return run


_PREFIX = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("q", pa.binary()), ("above", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())]
)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _screened(dealt: DataFrame, prefixes: Callable, counts: np.ndarray) -> DataFrame:
    """The prefixes with ``single`` and ``above_single``: proven to belong to one conversation."""
    rows, cells = counts.shape

    def estimate(values: pa.Array) -> np.ndarray:
        halves = _halves(values)
        return np.min([counts[r, cells_of(halves, r, cells)] for r in range(rows)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in prefixes(batches):
            if not len(b):
                continue
            above = (estimate(b.column(3)) == 1) & (b.column(1).to_numpy() > 1)
            more = [pa.array(estimate(b.column(2)) == 1), pa.array(above)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "single", "above_single"])

    schema = "conv_id long, depth long, q binary, above binary, chars long, last boolean, single boolean, above_single boolean"
    return dealt.mapInArrow(run, schema)


def _ends(shared: DataFrame) -> DataFrame:
    """q and the hash of the conversations that end there, ids ascending, one after the other as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hash_ = None, None
        for b in batches:
            out = []
            for q, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if q != now:
                    if now is not None:
                        out.append((now, hash_.hexdigest()))
                    now, hash_ = q, hashlib.sha256(b"%d" % conv)
                else:
                    hash_.update(b",%d" % conv)
            yield _rows(out, _END)
        if now is not None:
            yield _rows([(now, hash_.hexdigest())], _END)

    ends = shared.where("last").select("q", "conv_id").repartition("q").sortWithinPartitions("q", "conv_id")
    return ends.mapInArrow(run, "q binary, ends_sha256 string")


_END = pa.schema([("q", pa.binary()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, members: DataFrame, cells: int = SKETCH_CELLS) -> DataFrame:
    """One row per node of the trie of conversations.

    ``turns`` has conv_id, pos (1, 2, ... without gaps), digest (16 bytes) and chars, as
    ``turns_of`` makes them; ``members`` has conv_id and n (number of turns, also zero),
    once for each conversation. Returns conv_id (smallest member), depth, parent_conv_id
    (the parent's conv_id, null for the root), n_convs, n_children, n_leaves (childless
    nodes in the subtree, the node included), saved_tokens (over the subtree, the members
    beyond the first times the code points of the node's last text), ends_sha256 (of the
    ids of members that end here, ascending, joined by commas) and prefix (digest, hex).

    Conversations without turns are members of the root. Equal conversations share all
    their nodes. Without members there is no node, not even the root. The ids that end at one
    node stream through one task, since their hash is sequential; nothing else does.
    """
    if cells < 1 or cells & (cells - 1):
        raise ValueError("the number of cells is a power of two")
    dealt = _in_order(turns, "conv_id", "pos")
    prefixes = _prefixes(*_handed_over(dealt))
    # Read four times below; made again each time, it was most of the time of many small partitions.
    judged = durable(_screened(dealt, prefixes, sketch(dealt, cells, digests=prefixes)))
    single = judged.where("single")

    root = members.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("q"), F.lit(None).cast("binary").alias("above"),
        F.lit(0).cast("long").alias("chars"), (F.col("n") == 0).alias("last"), F.lit(False).alias("above_single"),
    )
    shared = durable(judged.where("not single").drop("single").unionByName(root))
    met = durable(
        shared.groupBy("q").agg(
            F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
            F.min("chars").alias("chars"), F.min("above").alias("above"), F.max("above_single").alias("above_single"),
        )
    )
    # Single nodes right below a node that was met.
    below = single.where("not above_single").select("conv_id", "depth", "q", "above", "last")
    kids = met.where("above is not null").select("above").unionByName(below.select("above"))
    kids = kids.groupBy("above").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("above", "q")
    met = durable(met.join(kids, "q", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # What a conversation owns: the costs of the nodes whose smallest member it is, and its leaf.
    cost = (F.col("n_convs") - 1) * F.col("chars")
    owned = met.select(F.col("least").alias("conv_id"), cost.alias("cost"), (F.col("n_children") == 0).cast("int").alias("leaf"))
    tails = single.where("last").select("conv_id", F.lit(0).cast("long").alias("cost"), F.lit(1).alias("leaf"))
    owns = owned.unionByName(tails).groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.max("leaf").alias("leaf"))
    through = shared.select("q", "conv_id").join(owns, "conv_id")
    sums = through.groupBy("q").agg(F.sum("leaf").cast("long").alias("n_leaves"), F.sum("cost").alias("cost_below"))
    # Nodes above that the same conversation owns do not lie in the subtree.
    over = Window.partitionBy("least").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = met.withColumn("cost_above", F.coalesce(F.sum(cost).over(over), F.lit(0)))
    nodes = nodes.join(sums, "q").join(_ends(shared), "q", "left")
    nodes = nodes.select(
        F.col("least").alias("conv_id"), "depth", "q", "above", "above_single", "n_convs", "n_children", "n_leaves",
        (F.col("cost_below") - F.col("cost_above")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )
    one = [
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY_SHA).alias("ends_sha256"),
    ]
    # Parents: looked up among the nodes that were met; a single parent has the same conversation.
    asking = nodes.where("above is not null and not above_single").drop("above_single")
    asking = asking.unionByName(below.select("conv_id", "depth", "q", "above", *one))
    parents = met.where("n_children > 0").select(
        F.col("q").alias("above"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("n_asking")
    )
    found = attach(asking, parents, ["above"], "n_asking")
    alone = nodes.where("above is null or above_single")
    alone = alone.withColumn("parent_conv_id", F.when(F.col("above_single"), F.col("conv_id")))
    rest = single.where("above_single").select("conv_id", "depth", "q", F.col("conv_id").alias("parent_conv_id"), *one)
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
        F.lower(F.hex("q")).alias("prefix"),
    ]
    return found.select(columns).unionByName(alone.select(columns)).unionByName(rest.select(columns))


def conversation_trie(rows: DataFrame, cells: int = SKETCH_CELLS) -> DataFrame:
    """``prefix_trie`` of a table with conv_id, turn, role and text, as it is."""
    turns = durable(turns_of(rows))
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n")), cells)
