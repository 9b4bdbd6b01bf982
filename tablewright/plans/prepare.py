"""From a raw table to train and test rows with an unfitted preprocessor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import analyze_columns, schema_kind
from tablewright.functions.missing import nan_to_null, quoted
from tablewright.operators.charts import IMBALANCED
from tablewright.operators.cleaning import Uninformative, expand_datetime, fit_uninformative, iqr_clip
from tablewright.operators.features import LABEL, RARE_SHARE, TablePreprocessor, encode_label, regression_target
from tablewright.operators.joins import lookup_join, materialize
from tablewright.operators.leakage import Leaks, fit_leakage
from tablewright.operators.sampling import SPLIT, can_stratify, class_counts, drop_null_target, train_test_split
from tablewright.operators.search import kept

ROW_ID = "row_id"


@dataclass(frozen=True)
class PreparedInfo:
    """What a preparation decided."""

    target: str
    task: str
    num_cols: list[str]
    cat_cols: list[str]
    leaks: Leaks
    dropped: Uninformative
    stratified: bool
    target_encoded: bool
    majority_ratio: float | None
    is_imbalanced: bool | None
    date_cols: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Prepared:
    data: DataFrame
    preprocessor: TablePreprocessor
    info: PreparedInfo
    held: DataFrame
    classes: DataFrame | None = None

    def name_classes(self, predictions: DataFrame, code: str = "prediction", into: str = "class") -> DataFrame:
        """Add the class that a code stands for; null for a code that no class has.

        ``classes`` has a row per class of the target: code and name, the value as it was.
        """
        if self.classes is None:
            raise ValueError("a regression has no classes")
        names = self.classes.select(F.col("code").alias("__code"), F.col("name").alias(into))
        marked = predictions.withColumn("__code", quoted(code).cast("double"))
        return lookup_join(marked, materialize(names), ["__code"]).drop("__code")

    def release(self) -> None:
        """Let go of the narrowed table once its rows are no longer read."""
        self.held.unpersist()

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col(SPLIT) == "train").drop(SPLIT)

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col(SPLIT) == "test").drop(SPLIT)


def prepare(
    df: DataFrame,
    target: str,
    task: str,
    test_size: float = 0.2,
    seed: int = 42,
    *,
    key: Sequence[str] | None = None,
    expand_dates: bool = True,
    clip_outliers: bool = False,
    whisker: float = 1.5,
    high_missing: float = 0.98,
    guard_leakage: bool = True,
    rare_share: float = RARE_SHARE,
    whole_word: bool = False,
    order_by: Sequence[str] = (),
) -> Prepared:
    """Leakage guard, date expansion, column drops, label, exact split.

    Column decisions look at all rows; filling, scaling and encoding are left to
    the preprocessor, which is fitted on training rows only. ``key`` identifies
    a row for the split; by default the whole row does. The rows are read by every
    step, so they are kept until ``release``.
    """
    if target not in df.columns:
        raise ValueError(f"target {target!r} not found")
    key = list(key or df.columns)
    df = drop_null_target(nan_to_null(df), target)
    row_key = F.xxhash64(*[quoted(k) for k in key]).alias(ROW_ID)
    # Every step below reads these rows, so the file is read once.
    held, _ = kept(df.select(row_key, *[quoted(c) for c in df.columns]), source=True)
    rows = held.drop(ROW_ID)
    if task == "regression":
        try:
            regression_target(rows, target)  # fails early on values that are not numbers
        except ValueError:
            held.unpersist()
            raise
    counts = class_counts(rows, target) if task == "classification" else None
    leaks = Leaks([], [])
    if guard_leakage:
        leaks = fit_leakage(rows, target, task, whole_word=whole_word, order_by=order_by, counts=counts)
    # The key is needed until the split, whatever the guard says about it.
    features = [c for c in df.columns if c != target and c not in leaks.names]
    data = held.select(ROW_ID, quoted(target), *[quoted(c) for c in features])

    groups = analyze_columns(data.select(*[quoted(c) for c in features]))
    if expand_dates and groups["date_cols"]:
        data = expand_datetime(data, groups["date_cols"])
    dropped = fit_uninformative(data.drop(ROW_ID, target), high_missing)
    data = data.drop(*dropped.names)
    rest = [c for c in data.columns if c not in (ROW_ID, target)]
    kinds = {c: schema_kind(data.schema[c].dataType) for c in rest}
    left_dates = set() if expand_dates else set(groups["date_cols"])
    num_cols = [c for c in rest if kinds[c] == "num" and c not in left_dates]
    cat_cols = [c for c in rest if kinds[c] == "text" and c not in left_dates]
    if clip_outliers:
        data = iqr_clip(data, num_cols, whisker)

    stratified, ratio, encoded, classes = False, None, False, None
    if task == "classification":
        stratified = can_stratify(counts, test_size)
        ratio = counts.largest / counts.rows if counts.rows else 0.0
        encoded = schema_kind(data.schema[target].dataType) != "num"
        data = encode_label(data, target, counts=counts)
        names = encode_label(counts.df.select(quoted(target)), target, counts=counts)
        classes = names.select(quoted(LABEL).cast("double").alias("code"), quoted(target).alias("name"))
    else:
        data = regression_target(data, target)
    data = train_test_split(data, target, test_size, seed, [ROW_ID], stratified, counts)
    info = PreparedInfo(
        target, task, num_cols, cat_cols, leaks, dropped, stratified, encoded, ratio,
        None if ratio is None else ratio >= IMBALANCED, groups["date_cols"],
    )
    keep = [ROW_ID, SPLIT, LABEL, *[c for c in rest if c in num_cols or c in cat_cols]]
    data = data.withColumn(LABEL, quoted(LABEL).cast("double")).select(*[quoted(c) for c in keep])
    preprocessor = TablePreprocessor(numericCols=num_cols, categoricalCols=cat_cols, minFrequency=rare_share)
    return Prepared(data, preprocessor, info, held, classes)
