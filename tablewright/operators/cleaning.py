"""Cleaning steps. What depends on the data is fitted first and then applied lazily."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import calendar_parts, parse_datetime
from tablewright.functions.kinds import names_of, schema_kind
from tablewright.functions.missing import quoted, sql_missing, sql_value, value_of
from tablewright.functions.numbers import to_numeric
from tablewright.operators.ordering import exact_quantiles

# The names a cast target may have.
CAST_FAMILIES = {
    "double": ("float", "float64", "double", "number"),
    "bigint": ("int", "int64", "long"),
    "boolean": ("bool", "boolean"),
    "string": ("category", "categorical", "string", "str", "object"),
}


# -------------------------------------------------------------- type casts


def fit_type_casts(df: DataFrame, casts: Sequence[Mapping[str, str]]) -> dict[str, str]:
    """Which casts can be applied: a cast that would lose a value is left out.

    Whole-number casts need whole values, logical casts need 0/1 numbers. All
    checks run in one scan.
    """
    wanted: dict[str, str] = {}
    for item in casts or []:
        name, to = item.get("name"), (item.get("to_dtype") or "").lower()
        family = next((f for f, names in CAST_FAMILIES.items() if to in names), None)
        if name in df.columns and family:
            wanted[name] = family
    checks = {}
    for name, family in wanted.items():
        f = df.schema[name]
        numeric = schema_kind(f.dataType) == "num"
        if family == "bigint":
            x = to_numeric(f).cast("double")
            checks[name] = F.count_if((x != F.floor(x)) | (F.abs(x) >= F.lit(float(2**63))))
        elif family == "boolean" and numeric and not isinstance(f.dataType, T.BooleanType):
            checks[name] = F.count_if(~value_of(f).cast("double").isin(0.0, 1.0))
        elif family == "boolean" and not numeric:
            checks[name] = F.lit(1)
    if checks:
        row = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks.values())], F.count(F.lit(1))).first()
        for i, name in enumerate(checks):
            if row[i]:
                del wanted[name]
    return wanted


def cast_columns(df: DataFrame, fitted: Mapping[str, str]) -> DataFrame:
    new = {}
    for name, family in fitted.items():
        f = df.schema[name]
        kind = schema_kind(f.dataType)
        if family in ("double", "bigint") and kind != "date":
            new[name] = to_numeric(f).cast(family if family == "bigint" or kind == "text" else f.dataType)
        elif family == "boolean":
            new[name] = value_of(f).cast("boolean")
        elif family == "string":
            new[name] = value_of(f).cast("string")
    return df.withColumns(new)


def apply_type_casts(df: DataFrame, casts: Sequence[Mapping[str, str]]) -> DataFrame:
    return cast_columns(df, fit_type_casts(df, casts))


def parse_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to time; unreadable values become missing."""
    text = [c for c in cols if c in df.columns and schema_kind(df.schema[c].dataType) == "text"]
    return df.withColumns({c: parse_datetime(quoted(c)) for c in text})


# -------------------------------------------------------------- imputation


def _mode_values(df: DataFrame, names: Sequence[str]) -> dict[str, Any]:
    """Most frequent value per column, ties to the smallest, in the column's type."""
    out = {}
    for c in names:
        v = value_of(df.schema[c])
        counts = df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        row = counts.orderBy(F.desc("n"), "v").select("v").first()
        out[c] = None if row is None else row[0]
    return out


def fit_imputations(df: DataFrame, imputations: Sequence[Mapping[str, str]]) -> dict[str, tuple[str, Any]]:
    """Fill value per column: ``median``, ``mean`` or, for any other name, the mode."""
    todo = {
        i["name"]: (i.get("strategy") or "most_frequent").lower()
        for i in imputations or []
        if i.get("name") in df.columns
    }
    numeric = [c for c, s in todo.items() if s in ("median", "mean")]
    view = df.select(*[to_numeric(df.schema[c]).cast("double").alias(c) for c in numeric]) if numeric else None
    fitted: dict[str, tuple[str, Any]] = {}
    medians = [c for c in numeric if todo[c] == "median"]
    if medians:
        for c, q in exact_quantiles(view, medians, [0.5]).items():
            fitted[c] = ("number", q[0])
    means = [c for c in numeric if todo[c] == "mean"]
    if means:
        row = view.agg(*[F.avg(quoted(c)) for c in means]).first()
        fitted.update({c: ("number", row[i]) for i, c in enumerate(means)})
    modes = [c for c in todo if c not in numeric]
    fitted.update({c: ("mode", v) for c, v in _mode_values(df, modes).items()})
    return fitted


def fill_columns(df: DataFrame, fitted: Mapping[str, tuple[str, Any]]) -> DataFrame:
    new = {}
    for c, (how, value) in fitted.items():
        f = df.schema[c]
        if how == "number":
            x = to_numeric(f).cast("double")
            new[c] = x if value is None else F.coalesce(x, F.lit(float(value)))
        elif value is not None:
            new[c] = F.coalesce(value_of(f), F.lit(value).cast(f.dataType))
    return df.withColumns(new)


def impute(df: DataFrame, imputations: Sequence[Mapping[str, str]]) -> DataFrame:
    return fill_columns(df, fit_imputations(df, imputations))


# ---------------------------------------------------------------- clipping


def fit_iqr_clip(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column from its quartiles; logical columns are skipped."""
    fields = [df.schema[c] for c in cols if c in df.columns]
    usable = [f for f in fields if schema_kind(f.dataType) in ("num", "text") and not isinstance(f.dataType, T.BooleanType)]
    view = df.select(*[to_numeric(f).cast("double").alias(f.name) for f in usable])
    bounds = {}
    for c, (q1, q3) in exact_quantiles(view, view.columns, [0.25, 0.75]).items():
        if q1 is not None:
            bounds[c] = (q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1))
    return bounds


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    new = {}
    for c, (lo, hi) in bounds.items():
        x = to_numeric(df.schema[c]).cast("double")
        # greatest/least skip NULL, hence the guard.
        new[c] = F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
    return df.withColumns(new)


def iqr_clip(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    return clip_columns(df, fit_iqr_clip(df, cols, whisker))


# --------------------------------------------------- uninformative columns


@dataclass(frozen=True)
class Uninformative:
    all_null: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    high_missing: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.all_null, *self.constant, *self.high_missing]


def fit_uninformative(df: DataFrame, threshold: float = 0.98) -> Uninformative:
    """Columns with no value, one value, or too many missing: one scan for all.

    A constant column has equal minimum and maximum, so nothing is counted
    distinct.
    """
    aggs = ["count(1) AS rows"]
    for i, f in enumerate(df.schema.fields):
        v = sql_value(f)
        aggs += [f"count_if({sql_missing(f)}) AS m{i}", f"min({v}) <=> max({v}) AS c{i}"]
    row = df.selectExpr(*aggs).first()
    found: dict[str, list[str]] = {"all_null": [], "constant": [], "high_missing": []}
    for i, f in enumerate(df.schema.fields):
        rows, missing = row["rows"], row[f"m{i}"]
        if missing == rows:
            found["all_null"].append(f.name)
        elif row[f"c{i}"]:
            found["constant"].append(f.name)
        elif missing >= threshold * rows:
            found["high_missing"].append(f.name)
    return Uninformative(**found)


def drop_uninformative(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    return df.drop(*fit_uninformative(df, threshold).names)


# ------------------------------------------------------------------- dates


def expand_datetime(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace date columns by calendar parts."""
    parts = []
    for c in cols:
        known = schema_kind(df.schema[c].dataType) == "date"
        parts += calendar_parts(quoted(c) if known else parse_datetime(quoted(c)), c)
    return df.select(*[quoted(c) for c in df.columns if c not in cols], *parts)


# ------------------------------------------------------------------- plans


def apply_cleaning_plan(df: DataFrame, plan: Mapping[str, Any]) -> DataFrame:
    """Drop, parse dates, cast, impute, clip: always in this order."""
    outliers = plan.get("outliers") or {}
    clip = outliers.get("columns") or [] if outliers.get("apply") else []
    return apply_selected(
        df,
        drop=[d["name"] for d in plan.get("drop_columns") or []],
        dates=plan.get("parse_dates") or [],
        outliers=clip,
        casts=plan.get("type_casts") or [],
        imputations=plan.get("imputations") or [],
    )


def apply_selected(
    df: DataFrame,
    drop: Sequence[str] = (),
    dates: Sequence[str] = (),
    outliers: Sequence[str] = (),
    casts: Sequence[Mapping[str, str]] = (),
    imputations: Sequence[Mapping[str, str]] = (),
) -> DataFrame:
    df = parse_dates(df.drop(*drop), dates)
    df = apply_type_casts(df, casts)
    df = impute(df, imputations)
    return iqr_clip(df, outliers) if outliers else df


def numeric_names(df: DataFrame) -> list[str]:
    return [c for c in names_of(df, "num") if not isinstance(df.schema[c].dataType, T.BooleanType)]
