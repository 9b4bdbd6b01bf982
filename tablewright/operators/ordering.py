"""Exact order statistics and ranks without a one-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted, sql_value
from tablewright.session import durable, local_frame, small_in_memory

EXACT_ROWS = 20_000
EXACT_VALUES = 40_000
BRACKET_ROWS = 1_000_000
SKETCH_ACCURACY = 5_000
ONE_TASK_ROWS = 200_000
RANGE_ROWS = 200_000
MAX_RANGES = 10_000
CUTOFF_ROWS = 50_000
SMALL_GROUPS = 50_000


# ------------------------------------------------------------- quantiles


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    cached: bool = False,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, exact at any size.

    ``percentile`` keeps the distinct values of a column in one task, so it is
    used only for columns of few rows or few distinct values. For the others a
    sketch brackets the wanted rank, one counting pass proves the bracket, it is
    narrowed until few rows are inside, and those are ranked. Every pass is one
    scan with a small result.
    """
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    if cached or df.is_cached:
        return _exact_quantiles(df, cols, probs, counts)
    with small_in_memory(df.select(*[quoted(c) for c in cols])) as held:
        return _exact_quantiles(held, cols, probs, counts)


def _exact_quantiles(df, cols, probs, counts):
    values = {c: f"cast({sql_value(df.schema[c])} as double)" for c in cols}
    if counts is None:
        row = df.selectExpr(*[f"count({values[c]}) AS n{i}" for i, c in enumerate(cols)]).first()
        counts = {c: row[i] for i, c in enumerate(cols)}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    small = [c for c in cols if 0 < counts[c] <= EXACT_ROWS]
    large = [c for c in cols if counts[c] > EXACT_ROWS]
    if large:
        row = df.selectExpr(*[f"approx_count_distinct({values[c]}) AS d{i}" for i, c in enumerate(large)]).first()
        small += [c for i, c in enumerate(large) if row[i] <= EXACT_VALUES]
        large = [c for i, c in enumerate(large) if row[i] > EXACT_VALUES]
    if small:
        points = ", ".join(_number(p) for p in probs)
        row = df.selectExpr(*[f"percentile({values[c]}, array({points})) AS q{i}" for i, c in enumerate(small)]).first()
        for i, c in enumerate(small):
            result[c] = list(row[i])
    if large:
        result.update(_bracketed_quantiles(df, values, large, probs, counts))
    return result


def _bracketed_quantiles(df, values, cols, probs, counts):
    positions = {(c, j): p * (counts[c] - 1) for c in cols for j, p in enumerate(probs)}
    # Bracket and number of rows below it, per wanted quantile.
    bracket: dict[tuple[str, int], tuple[float, float]] = {}
    below = {key: 0 for key in positions}
    inside = {key: counts[key[0]] for key in positions}
    out = {c: [None] * len(probs) for c in cols}
    open_keys = list(positions)
    while open_keys:
        tries = _sketch_brackets(df, values, open_keys, positions, bracket, below, inside)

        tallies = []
        for key, (lo, hi) in tries.items():
            c = values[key[0]]
            tallies += [f"count_if({c} < {_number(lo)})", f"count_if({_between(c, lo, hi)})"]
        row = df.selectExpr(*[f"{t} AS t{i}" for i, t in enumerate(tallies)]).first()

        ready, still_open = [], []
        for i, (key, (lo, hi)) in enumerate(tries.items()):
            under, within, pos = row[2 * i], row[2 * i + 1], positions[key]
            holds = under <= math.floor(pos) and math.ceil(pos) <= under + within - 1
            narrowed = key not in bracket or within < inside[key]
            if not (holds and narrowed):
                # The sketch missed: fall back to halving the value range.
                lo, hi, under, within, neighbours = _halve(df, values[key[0]], bracket.get(key), pos)
                if neighbours:
                    out[key[0]][key[1]] = lo + (hi - lo) * (pos - math.floor(pos))
                    continue
            bracket[key], below[key], inside[key] = (lo, hi), under, within
            if lo == hi:
                out[key[0]][key[1]] = lo
            elif within <= BRACKET_ROWS:
                ready.append(key)
            else:
                still_open.append(key)
        if ready:
            found = _ranked_values(df, values, ready, positions, bracket, below)
            for i, key in enumerate(ready):
                pos = positions[key]
                a, b = found[i, math.floor(pos) - below[key]], found[i, math.ceil(pos) - below[key]]
                out[key[0]][key[1]] = a + (b - a) * (pos - math.floor(pos))
        open_keys = still_open
    return out


def _ranked_values(df, values, keys, positions, bracket, below):
    """The values at the wanted ranks of each bracket, by ranking the few rows inside."""
    inside = [_between(values[key[0]], *bracket[key]) for key in keys]
    cells = [
        f"named_struct('i', {i}, 'v', if({test}, {values[key[0]]}, NULL))" for i, (key, test) in enumerate(zip(keys, inside))
    ]
    rows = df.where(" OR ".join(inside)).selectExpr(f"inline(array({', '.join(cells)}))").where("v IS NOT NULL")
    counted = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.select("i", "v", "n", F.sum("n").over(w).alias("upto"))
    ranks = {(i, f(positions[key]) - below[key]) for i, key in enumerate(keys) for f in (math.floor, math.ceil)}
    wanted = local_frame(df.sparkSession, sorted(ranks), "j int, rank bigint")
    # Two ranks per bracket.
    hit = (F.col("i") == F.col("j")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return {(r["i"], r["rank"]): r["v"] for r in upto.join(F.broadcast(wanted), hit).select("i", "rank", "v").collect()}


def _number(x: float) -> str:
    return f"double('{float(x)!r}')"


def _between(c: str, lo: float, hi: float) -> str:
    return f"({c} >= {_number(lo)} AND {c} <= {_number(hi)})"


def _sketch_brackets(df, values, keys, positions, bracket, below, inside):
    """Values just below and above each wanted rank, from one sketch per bracket."""
    margin = 2.0 / SKETCH_ACCURACY
    shared: dict[tuple, list] = {}
    for key in keys:
        shared.setdefault((key[0], bracket.get(key)), []).append(key)
    sketches = []
    for (col, known), group in shared.items():
        c = values[col] if known is None else f"if({_between(values[col], *known)}, {values[col]}, NULL)"
        ends = []
        for key in group:
            share = (positions[key] - below[key]) / max(1, inside[key] - 1)
            ends += [max(0.0, share - margin), min(1.0, share + margin)]
        points = ", ".join(_number(e) for e in ends)
        sketches.append(f"percentile_approx({c}, array({points}), {SKETCH_ACCURACY})")
    row = df.selectExpr(*[f"{s} AS b{i}" for i, s in enumerate(sketches)]).first()
    tries = {}
    for i, group in enumerate(shared.values()):
        for j, key in enumerate(group):
            tries[key] = (row[i][2 * j], row[i][2 * j + 1])
    return tries


def _halve(df, c, known, pos):
    """Shrink a bracket by its middle value until it is proven and smaller.

    The last part of the result says that the ends are the two values on either
    side of the wanted rank, which then lies between them.
    """
    if known is None:
        return (*df.selectExpr(f"min({c})", f"max({c})", "0", f"count({c})").first(), False)
    lo, hi = known
    mid = lo + (hi - lo) / 2
    left, right = _between(c, lo, mid), f"({c} > {_number(mid)} AND {c} <= {_number(hi)})"
    row = df.selectExpr(
        f"count_if({c} < {_number(lo)}) AS under",
        f"count_if({left}) AS left",
        f"count_if({right}) AS right",
        f"max(if({left}, {c}, NULL)) AS left_max",
        f"min(if({right}, {c}, NULL)) AS right_min",
    ).first()
    first_right = row["under"] + row["left"]
    if math.ceil(pos) < first_right:
        return lo, row["left_max"], row["under"], row["left"], False
    if math.floor(pos) >= first_right:
        return row["right_min"], hi, first_right, row["right"], False
    # The wanted rank lies between the two halves, so between their inner ends.
    return row["left_max"], row["right_min"], row["under"], row["left"] + row["right"], True


# --------------------------------------------------- running sums and ranks


def running_before(df: DataFrame, order_by: Sequence[str], sums: dict[str, Column], rows: int) -> DataFrame:
    """Add, per row, the sum of each expression over all earlier rows.

    ``rows`` is the (approximate) row count. Few rows go through one window;
    more are range-partitioned, checkpointed so that partition numbers are
    fixed, summed per range, and offset by the sums of the ranges before.
    """
    order = [quoted(c) for c in order_by]
    before = (Window.unboundedPreceding, -1)
    if rows <= ONE_TASK_ROWS:
        w = Window.orderBy(*order).rowsBetween(*before)
        return df.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()])

    ranges = int(min(MAX_RANGES, max(2, math.ceil(rows / RANGE_ROWS))))
    fixed = durable(df.repartitionByRange(ranges, *order))
    tagged = fixed.select("*", F.spark_partition_id().alias("__range"))
    totals = tagged.groupBy("__range").agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    # One row per range, MAX_RANGES at most: fits one task and a broadcast.
    w = Window.orderBy("__range").rowsBetween(*before)
    offsets = totals.select(
        "__range", *[F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(*before)
    return tagged.join(F.broadcast(offsets), "__range").select(
        *[quoted(c) for c in df.columns],
        *[(F.coalesce(F.sum(e).over(inner), F.lit(0)) + F.col(f"__o_{n}")).alias(n) for n, e in sums.items()],
    )


def global_index(df: DataFrame, order_by: Sequence[str], name: str, rows: int) -> DataFrame:
    """0-based position of each row in the given order."""
    return running_before(df, order_by, {name: F.lit(1)}, rows).withColumn(name, quoted(name).cast("bigint"))


# ----------------------------------------------------- exact cut-off hashes

HASH = "__hash"


def row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[quoted(k) for k in keys])


def hash_cutoffs(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    wanted: DataFrame,
    groups: Sequence[str] = (),
    largest: int = 0,
    spots: int = 1,
) -> DataFrame:
    """The hash at which exactly the wanted number of rows has been passed.

    ``wanted`` has the group columns, a ``slot`` number and ``k`` (how many rows
    to take). The result has the group columns, ``slot``, ``cut``, ``take`` (how
    many of the rows with just that hash belong to the wanted ones) and ``at``
    (how many rows have it). Rows are ordered by a 64-bit hash of their key, which
    copies of one key share.

    The hash space is cut into equal buckets (it is uniform, so buckets are
    even), counted with map-side combine, and only the one bucket that holds a
    cut-off is ever ranked: no group is gathered in one task. ``largest`` is the
    row count of the largest group, ``spots`` the number of rows of ``wanted``.
    """
    groups = list(groups)
    tags = [f"__g{i}" for i in range(len(groups))]
    bits = min(24, max(0, math.ceil(math.log2(max(1, largest / CUTOFF_ROWS)))))
    levels = [b for b in ([12, bits] if bits > 12 else [bits]) if b]
    tagged = [quoted(g).alias(t) for g, t in zip(groups, tags)]
    inside = df.select(*tagged, row_hash(keys, seed).alias(HASH))
    state = wanted.where(F.col("k") > 0).select(*tagged, "slot", F.col("k").alias("left"))
    # Ranks count within the bucket found before, so that bucket is part of the group.
    state = state.withColumn("__parent", F.lit(0).cast("bigint"))
    parent = F.lit(0).cast("bigint")

    for b in levels:
        bucket = F.shiftright(F.col(HASH), 64 - b)
        keyed = [*tags, parent.alias("__parent"), bucket.alias("b")]
        counted = inside.groupBy(*keyed).agg(F.count(F.lit(1)).alias("n"))
        state = _advance(counted, state, [*tags, "__parent"])
        edge = state.select(*[F.col(t).alias("e" + t) for t in tags], F.col("b").alias("e__b")).distinct()
        if spots <= SMALL_GROUPS:
            edge = F.broadcast(edge)
        cond = bucket == F.col("e__b")
        for t in tags:
            cond = cond & F.col(t).eqNullSafe(F.col("e" + t))
        inside = inside.join(edge, cond, "left_semi")
        state = state.withColumn("__parent", F.col("b")).drop("b")
        parent = bucket
    keyed = [*tags, parent.alias("__parent"), F.col(HASH).alias("b")]
    counted = inside.groupBy(*keyed).agg(F.count(F.lit(1)).alias("n"))
    done = _advance(counted, state, [*tags, "__parent"])
    return done.select(
        *[F.col(t).alias(g) for g, t in zip(groups, tags)], "slot", F.col("b").alias("cut"), F.col("left").alias("take"), "at"
    )


def _advance(counted: DataFrame, state: DataFrame, tags: list[str]) -> DataFrame:
    """Find the bucket in which each wanted rank falls, and the rank inside it."""
    w = Window.partitionBy(*tags).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.select("*", F.sum("n").over(w).alias("upto"))
    ranks = state.select(*[F.col(t).alias("s" + t) for t in tags], "slot", "left")
    cond = (F.col("left") > F.col("upto") - F.col("n")) & (F.col("left") <= F.col("upto"))
    for t in tags:
        cond = cond & F.col(t).eqNullSafe(F.col("s" + t))
    rest = F.col("left") - F.col("upto") + F.col("n")
    return upto.join(ranks, cond).select(*tags, "slot", "b", rest.alias("left"), F.col("n").alias("at"))


CUTS = "__cuts"


#: A row has at most so many cut-offs if it is compared with each by a plain expression.
PLAIN_CUTS = 16


def _cuts_before(h: Column, most: int) -> Column:
    """How many of a row's cut-offs, ``most`` of them at most, lie before its hash; null without a list.

    Plain comparisons are compiled with the scan they belong to, functions over arrays are not.
    """
    if most > PLAIN_CUTS:
        return F.size(F.filter(F.col(CUTS), lambda c: c["cut"] < h))
    passed = [F.coalesce((F.get(F.col(CUTS), F.lit(j))["cut"] < h).cast("int"), F.lit(0)) for j in range(most)]
    return F.when(F.col(CUTS).isNotNull(), sum(passed, F.lit(0)))


def passed_cuts(placed: DataFrame, groups: Sequence[str], h: Column, name: str, tied: bool, most: int) -> DataFrame:
    """Add ``name``: how many of a row's cut-offs (``CUTS``, an array of cut, take, at) lie before it.

    A cut-off that falls among rows of one hash takes only some of them. Those rows
    are kept in a checkpoint and numbered: each partition numbers its own per group
    and hash, and starts behind the partitions before it. No hash is gathered in one
    task. Without such cut-offs (``tied`` false) no row moves. No row has more than ``most``.
    """
    before = _cuts_before(h, most)
    if not tied:
        return placed.withColumn(name, before)
    split = F.coalesce(F.exists(F.col(CUTS), lambda c: (c["cut"] == h) & (c["take"] < c["at"])), F.lit(False))
    rest = placed.where(~split).withColumn(name, before)
    edge = durable(placed.where(split)).select("*", h.alias("__h"), F.spark_partition_id().alias("__part"))
    keys = [*[quoted(g) for g in groups], F.col("__h")]
    tags = [f"__e{i}" for i in range(len(keys))]
    sizes = edge.groupBy(*[k.alias(t) for k, t in zip(keys, tags)], "__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*tags).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*tags, F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__from"))
    own = Window.partitionBy("__part", *keys).orderBy(F.lit(0))
    cond = F.col("__part") == F.col("__p")
    for k, t in zip(keys, tags):
        cond = cond & k.eqNullSafe(F.col(t))
    numbered = edge.withColumn("__own", F.row_number().over(own) - 1).join(starts, cond)
    number = F.col("__own") + F.col("__from")
    ahead = F.filter(F.col(CUTS), lambda c: (c["cut"] < F.col("__h")) | ((c["cut"] == F.col("__h")) & (number >= c["take"])))
    return rest.unionByName(numbered.withColumn(name, F.size(ahead)).select(*placed.columns, name))
