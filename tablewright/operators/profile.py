"""Column profiles: one aggregate scan, one value-count shuffle, exact quantiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import parse_datetime
from tablewright.functions.kinds import fields_of, names_of, require_flat, schema_kind
from tablewright.functions.missing import nan_to_null, quoted, sql_missing, sql_name, sql_text, sql_value
from tablewright.functions.pii import mask_pii
from tablewright.operators.joins import materialize
from tablewright.operators.ordering import exact_quantiles
from tablewright.session import local_copy, local_frame, small_in_memory

# The reported percentiles.
PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
MOMENTS = ("count", "mean", "std", "min", "max")
PROMOTE_SHARE = 0.9


def long_form(wide: DataFrame, cells: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One aggregate row to one row per column: ``name`` plus the given SQL cells."""
    rows = []
    for name, parts in cells.items():
        pairs = ", ".join(f"{sql_text(k)}, {expr}" for k, expr in parts.items())
        rows.append(f"named_struct('name', {sql_text(name)}, {pairs})")
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def per_column(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[T.StructField], Mapping[str, str]]):
    """Aggregate every column in one scan; ``make(field)`` gives SQL aggregates by name."""
    aggs, cells = [], {}
    for i, f in enumerate(fields):
        parts = make(f)
        aggs += [f"{expr} AS c{i}_{k}" for k, expr in parts.items()]
        cells[f.name] = {k: f"c{i}_{k}" for k in parts}
    return long_form(df.selectExpr(*aggs), cells)


def missing_count(df: DataFrame) -> DataFrame:
    return per_column(df, df.schema.fields, lambda f: {"missing": f"count_if({sql_missing(f)})"})


def missing_pct(df: DataFrame) -> DataFrame:
    """Share of missing values in percent, two digits."""
    return per_column(
        df, df.schema.fields, lambda f: {"missing_pct": f"round(avg(cast({sql_missing(f)} as int)) * 100, 2)"}
    )


LONG_TEXT = 64


def category_text(f: T.StructField) -> str:
    """A column as category text; long texts stand as their 128-bit digest."""
    v = f"cast({sql_value(f)} as string)"
    if schema_kind(f.dataType) != "text":
        return v
    return f"if(length({v}) > {LONG_TEXT}, concat('md5:', md5({v})), {v})"


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value, n) of the non-missing categories of the columns, in one shuffle.

    Counting is combined in each task first, so a value that holds a third of
    the rows travels once per task, and long texts never travel.
    """
    pairs = [f"named_struct('name', {sql_text(c)}, 'value', {category_text(df.schema[c])})" for c in cols]
    long = df.selectExpr(f"inline(array({', '.join(pairs)}))").where("value IS NOT NULL")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def _key_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value, digest) cells; of a long text the beginning and a 128-bit digest stand for it.

    Whole documents so never enter a shuffle, and beginnings sort as the texts do.
    """
    pairs = []
    for c in cols:
        f = df.schema[c]
        v = f"cast({sql_value(f)} as string)"
        digest = f"if(length({v}) > {LONG_TEXT}, md5({v}), NULL)" if schema_kind(f.dataType) == "text" else "cast(NULL as string)"
        pairs.append(f"named_struct('name', {sql_text(c)}, 'value', left({v}, {LONG_TEXT}), 'digest', {digest})")
    return df.selectExpr(f"inline(array({', '.join(pairs)}))").where("value IS NOT NULL")


def _key_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _key_pairs(df, cols).groupBy("name", "digest", "value").agg(F.count(F.lit(1)).alias("n"))


def _distinct_counts(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, name, nunique) for the given columns of each table.

    Cells are (column number, key) pairs. Values of up to eight bytes are told
    apart by their 64-bit hash alone, which maps them one to one, so those keys
    are grouped as plain numbers. Text and wide decimals go by text or digest.
    All tables meet in one distinct count per kind of key.
    """
    numbered: list[tuple[str, str]] = []
    cells: dict[str, list[DataFrame]] = {"hash": [], "text": []}
    for table, (df, cols) in tables.items():
        fields = [df.schema[c] for c in cols]
        by_hash = [f for f in fields if schema_kind(f.dataType) != "text" and not isinstance(f.dataType, T.DecimalType)]
        for kind, group in (("hash", by_hash), ("text", [f for f in fields if f not in by_hash])):
            if not group:
                continue
            keys = ", ".join(_hash_key(f) if kind == "hash" else _text_key(f) for f in group)
            cell = df.selectExpr(f"posexplode(array({keys})) AS (i, key)").where("key IS NOT NULL")
            cells[kind].append(cell.selectExpr(f"i + {len(numbered)} AS i", "key"))
            numbered += [(table, f.name) for f in group]
    counts = []
    for parts in cells.values():
        if parts:
            keys = reduce(lambda a, b: a.union(b), parts).distinct()
            counts.append(keys.groupBy("i").agg(F.count(F.lit(1)).alias("nunique")))
    names = local_frame(
        next(iter(tables.values()))[0].sparkSession,
        [(i, t, c) for i, (t, c) in enumerate(numbered)],
        "i int, table string, name string",
    )
    # One row per column on both sides.
    found = names.join(F.broadcast(reduce(lambda a, b: a.union(b), counts)), "i", "left")
    return found.select("table", "name", F.coalesce("nunique", F.lit(0)).cast("bigint").alias("nunique"))


def _hash_key(f: T.StructField) -> str:
    return f"if({sql_missing(f)}, NULL, xxhash64({sql_name(f.name)}))"


def _text_key(f: T.StructField) -> str:
    v = f"cast({sql_name(f.name)} as string)"
    return f"if(length({v}) > {LONG_TEXT}, concat('d', md5({v})), concat('s', {v}))"


def nunique(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct non-missing values per column; ``exact=False`` needs no shuffle."""
    cols = list(cols or df.columns)
    with small_in_memory(df.select(*[quoted(c) for c in cols])) as held:
        return local_copy(_nunique(held, cols, exact, rsd))


def _nunique(df: DataFrame, cols: Sequence[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    if not exact:
        fields = [df.schema[c] for c in cols]
        return per_column(df, fields, lambda f: {"nunique": f"approx_count_distinct({sql_value(f)}, {rsd})"})
    return _distinct_counts({"": (df, cols)}).drop("table")


def numeric_summary(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and percentiles of numeric columns.

    Logical columns are left out, as in a numeric description.
    """
    fields = [f for f in fields_of(df, "num") if not isinstance(f.dataType, T.BooleanType)]
    if not fields:
        schema = "name string, count bigint, mean double, std double, min double, max double"
        return local_frame(df.sparkSession, [], schema + "".join(f", {p} double" for p in PERCENTILES))
    with small_in_memory(df.select(*[quoted(f.name) for f in fields])) as held:
        return local_copy(_numeric_summary(held))


def _numeric_summary(df: DataFrame) -> DataFrame:
    fields = [df.schema[c] for c in _numeric_names(df)]
    moments = per_column(df, fields, _moment_parts)
    return moments.join(F.broadcast(_quantile_table(df, [f.name for f in fields])), "name").select(
        "name", *MOMENTS, *PERCENTILES
    )


def _moment_parts(f: T.StructField) -> dict[str, str]:
    c = f"cast({sql_value(f)} as double)"
    return {
        "count": f"count({c})",
        "mean": f"round(avg({c}), 4)",
        "std": f"round(stddev_samp({c}), 4)",
        "min": f"round(min({c}), 4)",
        "max": f"round(max({c}), 4)",
    }


def _quantile_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, p05 .. p95): one row per column, so it is always small."""
    points = exact_quantiles(df, names, list(PERCENTILES.values()), cached=True)
    rows = [(c, *[None if q is None else round(q, 4) for q in points[c]]) for c in names]
    return local_frame(df.sparkSession, rows, "name string" + "".join(f", {p} double" for p in PERCENTILES))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """(name, rank, value, count): the ``k`` most frequent values.

    Ties go by value. The rank filter is pushed below the shuffle as a group
    limit: every task passes on ``k`` rows per column, and those that tie with the
    last of them in count and in how their texts begin.
    """
    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    ranked = _key_counts(df, cols).select("*", F.rank().over(w).alias("rank")).where(F.col("rank") <= k).drop("rank")
    held = materialize(ranked)
    top = held.df
    long = top.where("digest IS NOT NULL").select("name", "digest")
    names = sorted(r["name"] for r in long.select("name").distinct().collect())
    shown = F.col("value")
    if names:
        # A second scan fetches the texts that made it, instead of sending all
        # texts through the shuffle.
        cells = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).alias("text")) for c in names])
        texts = df.select(F.inline(cells)).where(F.length("text") > LONG_TEXT).withColumn("digest", F.md5("text"))
        texts = texts.join(F.broadcast(long) if held.small else long, ["name", "digest"], "left_semi")
        texts = texts.groupBy("name", "digest").agg(F.first("text").alias("text"))
        top = top.join(texts, ["name", "digest"], "left")
        shown = F.coalesce("text", "value")
    order = Window.partitionBy("name").orderBy(F.desc("n"), "whole")
    final = top.select("name", shown.alias("whole"), "n").withColumn("rank", F.row_number().over(order))
    return final.where(F.col("rank") <= k).select("name", "rank", F.col("whole").alias("value"), F.col("n").alias("count"))


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Top values of the text columns, each row with the column's distinct count."""
    cols = list(cols or names_of(df, "text"))
    return top_values(df, cols, k).join(F.broadcast(_nunique(df, cols)), "name")


def describe_all(df: DataFrame) -> DataFrame:
    """Every column in one table: numeric summary, or count, distinct and top value."""
    require_flat(df)
    with small_in_memory(df) as held:
        return local_copy(_describe_all(held))


def _describe_all(df: DataFrame) -> DataFrame:
    numbers = _numeric_summary(df) if _numeric_names(df) else numeric_summary(df)
    others = [f for f in df.schema.fields if f.name not in set(_numeric_names(df))]
    columns = ["name", "count", "unique", "top", "freq", *MOMENTS[1:], *PERCENTILES]
    if not others:
        blank = {"unique": "bigint", "top": "string", "freq": "bigint"}
        return numbers.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}).select(*columns)
    names = [f.name for f in others]
    counts = per_column(df, others, lambda f: {"count": f"count({sql_value(f)})"})
    top = top_values(df, names, 1).select("name", F.col("value").alias("top"), F.col("count").alias("freq"))
    # One row per column on each side.
    words = counts.join(F.broadcast(_nunique(df, names)), "name").join(F.broadcast(top), "name", "left")
    words = words.select("name", "count", F.col("nunique").alias("unique"), "top", "freq")
    return numbers.unionByName(words, allowMissingColumns=True).select(*columns)


def _numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in fields_of(df, "num") if not isinstance(f.dataType, T.BooleanType)]


# ---------------------------------------------------------- date promotion


def fit_promote_dates(df: DataFrame, min_share: float = PROMOTE_SHARE) -> list[str]:
    """Text columns that read as dates throughout and are mostly present."""
    names = names_of(df, "text")
    if not names:
        return []
    aggs = []
    for i, c in enumerate(names):
        parsed = parse_datetime(quoted(c))
        aggs += [
            F.avg(parsed.isNotNull().cast("int")).alias(f"s{i}"),
            F.count_if(quoted(c).isNotNull() & parsed.isNull()).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(names) if (row[f"s{i}"] or 0.0) > min_share and row[f"b{i}"] == 0]


def promote_dates(df: DataFrame, cols: Sequence[str] | None = None, min_share: float = PROMOTE_SHARE) -> DataFrame:
    cols = fit_promote_dates(df, min_share) if cols is None else cols
    return df.withColumns({c: parse_datetime(quoted(c)) for c in cols})


# ----------------------------------------------------------------- profile


def light_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Name, type, rows, missing and distinct values: what the advisors read."""
    return catalog_profile({"": df}, exact).drop("table")


def catalog_profile(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """Light profiles of many tables in one job: one row per (table, column)."""
    with ExitStack() as held:
        copies = {name: held.enter_context(small_in_memory(df)) for name, df in tables.items()}
        return local_copy(_catalog_profile(copies, exact))


def _catalog_profile(tables: Mapping[str, DataFrame], exact: bool) -> DataFrame:
    facts, counted, keys, sketches = [], [], {}, []
    for name, df in tables.items():
        require_flat(df)
        facts += [
            (name, f.name, i, df.dtypes[i][1], schema_kind(f.dataType)) for i, f in enumerate(df.schema.fields)
        ]
        tag = F.lit(name).alias("table")
        base = per_column(df, df.schema.fields, lambda f: {"rows": "count(1)", "missing": f"count_if({sql_missing(f)})"})
        counted.append(base.select(tag, "*"))
        if exact:
            keys[name] = (df, df.columns)
        else:
            sketches.append(_nunique(df, df.columns, exact=False).select(tag, "*"))
    long = _distinct_counts(keys) if exact else reduce(lambda a, b: a.unionByName(b), sketches)
    described = local_frame(
        next(iter(tables.values())).sparkSession,
        facts,
        "table string, name string, pos int, dtype string, kind string",
    )
    # Every side has one row per column, so each of them is small.
    base = reduce(lambda a, b: a.unionByName(b), counted)
    joined = described.join(F.broadcast(base), ["table", "name"]).join(F.broadcast(long), ["table", "name"], "left")
    share = F.col("missing") * 100.0 / F.nullif(F.col("rows"), F.lit(0))
    return joined.select(
        "table",
        "name",
        "pos",
        "dtype",
        "kind",
        "rows",
        "missing",
        F.round(F.coalesce(share, F.lit(0.0)), 2).alias("missing_pct"),
        F.coalesce("nunique", F.lit(0)).cast("bigint").alias("nunique"),
    )


def profile(df: DataFrame, k: int = 10, exact: bool = True, promote: bool = True) -> DataFrame:
    """One row per column: type, missing, distinct, numeric summary, top values."""
    require_flat(df)
    df = nan_to_null(df)
    with small_in_memory(promote_dates(df) if promote else df) as held:
        return local_copy(_profile(held, k, exact))


def _profile(df: DataFrame, k: int, exact: bool) -> DataFrame:
    numbers = _numeric_summary(df) if _numeric_names(df) else numeric_summary(df)
    words = names_of(df, "text")
    joined = _catalog_profile({"": df}, exact).drop("table").join(F.broadcast(numbers), "name", "left")
    if not words:
        return joined.withColumn("top_values", F.lit(None).cast("array<struct<value:string,count:bigint>>"))
    packed = F.sort_array(F.collect_list(F.struct("rank", "value", "count")))
    tops = top_values(df, words, k).groupBy("name").agg(packed.alias("t"))
    tops = tops.select("name", F.transform("t", lambda x: F.struct(x["value"], x["count"])).alias("top_values"))
    return joined.join(F.broadcast(tops), "name", "left")


def masked_examples(df: DataFrame, n: int = 5) -> DataFrame:
    """A few rows as text with personal data masked."""
    few = mask_pii(df.limit(n))
    return few.select(*[quoted(c).cast("string").alias(c) for c in few.columns])


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def kind_counts(profiled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numeric and categorical columns by type name, of one profile or per group."""
    dtype = F.lower("dtype")
    # The type names that count as numeric and as categorical.
    numeric = dtype.isin("int64", "float64", "int32", "float32", "bigint", "int", "double", "float")
    words = dtype.contains("object") | dtype.contains("category") | (dtype == "string")
    return profiled.groupBy(*by).agg(
        F.count_if(numeric).alias("numeric_columns"), F.count_if(words).alias("categorical_columns"),
        F.sum("missing").alias("missing"),
    )
