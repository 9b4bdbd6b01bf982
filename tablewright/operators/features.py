"""Label coding and the train-fitted feature preprocessor."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import schema_kind
from tablewright.functions.missing import is_missing, quoted, sql_value, value_of
from tablewright.functions.numbers import to_numeric
from tablewright.operators.joins import BROADCAST_ROWS, lookup_join, materialize
from tablewright.operators.leakage import target_codes
from tablewright.operators.ordering import exact_quantiles
from tablewright.operators.profile import LONG_TEXT, category_text, top_values, value_counts
from tablewright.operators.sampling import ClassCounts
from tablewright.session import local_frame

LABEL = "label"
FEATURES = "features"
RARE_SHARE = 0.01


def encode_label(df: DataFrame, y: str, label: str = LABEL, counts: ClassCounts | None = None) -> DataFrame:
    """Add class codes 0..k-1 in the order of the sorted values.

    The codes are a small table joined to the rows, so hot classes cost nothing.
    """
    codes = target_codes(df, y, counts=counts).withColumnRenamed("code", label)
    return lookup_join(df, materialize(codes), [y])


def regression_target(df: DataFrame, y: str, label: str = LABEL) -> DataFrame:
    """Add the target as a double; an error names up to five values that are not numbers."""
    f = df.schema[y]
    number = to_numeric(f).cast("double") if schema_kind(f.dataType) != "date" else F.lit(None).cast("double")
    if schema_kind(f.dataType) != "num":
        bad = df.where(~is_missing(f) & number.isNull()).select(quoted(y).cast("string").alias("v")).distinct()
        values = sorted(r["v"] for r in bad.limit(5).collect())
        if values:
            raise ValueError(
                f"target {y!r} is not numeric, for example {values}; check the column, "
                "choose the classification task, or clean the data"
            )
    return df.withColumn(label, number)


class _PreprocessorParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)
    minFrequency = Param(Params._dummy(), "minFrequency", "share below which a category is rare", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def _numeric(self) -> list[str]:
        return self.getOrDefault("numericCols")

    def _categorical(self) -> list[str]:
        return self.getOrDefault("categoricalCols")


class TablePreprocessor(Estimator, _PreprocessorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median-fill and standardise numbers; mode-fill and one-hot encode categories.

    Categories below ``minFrequency`` share one slot, so a column has at most
    1/minFrequency slots. Values not seen in training get no slot.
    """

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, minFrequency=RARE_SHARE, outputCol=FEATURES):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], minFrequency=RARE_SHARE, outputCol=FEATURES)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TablePreprocessorModel:
        numeric, words = self._numeric(), self._categorical()
        numbers = fit_scaler(df, numeric)
        slots, fills, rare = fit_slots(df, words, self.getOrDefault("minFrequency"))
        model = TablePreprocessorModel(
            numericCols=numeric,
            categoricalCols=words,
            outputCol=self.getOrDefault("outputCol"),
            state=json.dumps({"numbers": numbers, "slots": slots, "fills": fills}),
        )
        return model._with_rare(rare)


class TablePreprocessorModel(Model, _PreprocessorParams, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted numbers and slots as JSON", TypeConverters.toString)
    rareValues = Param(Params._dummy(), "rareValues", "rare training values as JSON", TypeConverters.toString)
    rarePath = Param(Params._dummy(), "rarePath", "folder of the rare training values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol=FEATURES, state="{}"):
        super().__init__()
        self._rare = None
        self._setDefault(numericCols=[], categoricalCols=[], outputCol=FEATURES, state="{}", rareValues="null", rarePath="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _with_rare(self, rare) -> TablePreprocessorModel:
        """Keep the rare training values: in the model while few, else as a checkpointed table."""
        if rare is not None:
            self._rare = rare
            if rare.small:
                listed = [[r["name"], r["value"]] for r in rare.df.collect()]
                self._set(rareValues=json.dumps(listed))
        return self

    def _rare_table(self, df: DataFrame):
        if self._rare is None:
            spark, listed = df.sparkSession, json.loads(self.getOrDefault("rareValues"))
            if self.getOrDefault("rarePath"):
                self._rare = materialize(spark.read.parquet(self.getOrDefault("rarePath")))
            elif listed:
                self._rare = materialize(local_frame(spark, listed, "name string, value string"))
        return self._rare

    def keep_rare_values(self, folder: str) -> None:
        """Before saving: write rare values that are too many for the model's own record."""
        if self._rare is not None and not self._rare.small:
            self._rare.df.write.mode("overwrite").parquet(folder)
            self._set(rarePath=folder)

    def _transform(self, df: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault("state"))
        numeric, words = self._numeric(), self._categorical()
        out = df.withColumns({f"__num{i}": scaled(df, c, state["numbers"][c]) for i, c in enumerate(numeric)})
        rare = self._rare_table(df)
        inputs, outputs, sizes = [], [], []
        for i, c in enumerate(words):
            out = _slot_column(out, df, c, state["slots"][c], state["fills"][c], rare, f"__slot{i}")
            size = len(state["slots"][c]["frequent"]) + int(state["slots"][c]["has_rare"])
            if size:
                inputs.append(f"__slot{i}")
                outputs.append(f"__hot{i}")
                sizes.append(size)
        if inputs:
            out = _one_hot(df, inputs, outputs, sizes).transform(out)
        parts = [f"__num{i}" for i in range(len(numeric))] + outputs
        target = self.getOrDefault("outputCol")
        if parts:
            out = VectorAssembler(inputCols=parts, outputCol=target, handleInvalid="keep").transform(out)
        else:
            raise ValueError("no feature column is left")
        drop = [f"__num{i}" for i in range(len(numeric))] + [f"__slot{i}" for i in range(len(words))] + outputs
        return out.drop(*drop)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Median, then mean and population deviation of the median-filled column.

    The filled column's moments follow from the present values' moments and the
    number of missing rows, so they need no second pass over filled data.
    """
    if not cols:
        return {}
    aggs = ["count(1) AS rows"]
    for i, c in enumerate(cols):
        v = f"cast({sql_value(df.schema[c])} as double)"
        aggs += [f"count({v}) AS n{i}", f"avg({v}) AS a{i}", f"var_pop({v}) AS v{i}"]
    row = df.selectExpr(*aggs).first()
    medians = exact_quantiles(df, list(cols), [0.5], {c: row[f"n{i}"] for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        rows, n, avg, var, med = row["rows"], row[f"n{i}"], row[f"a{i}"], row[f"v{i}"], medians[c][0]
        if not n:
            out[c] = [0.0, 0.0, 0.0]
            continue
        share = n / rows
        mean = share * avg + (1 - share) * med
        filled = share * (var + (avg - mean) ** 2) + (1 - share) * (med - mean) ** 2
        out[c] = [med, mean, filled**0.5]
    return out


def scaled(df: DataFrame, c: str, numbers: Sequence[float]):
    median, mean, dev = numbers
    x = F.coalesce(value_of(df.schema[c]).cast("double"), F.lit(float(median)))
    return (x - F.lit(float(mean))) / F.lit(float(dev)) if dev else F.lit(0.0)


def scale_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the columns by their median-filled, standardised values."""
    fitted = fit_scaler(df, cols)
    return df.withColumns({c: scaled(df, c, fitted[c]) for c in cols})


def fit_slots(df: DataFrame, cols: Sequence[str], min_share: float = RARE_SHARE, rows: int | None = None):
    """Frequent categories per column, the fill value, and the rare training values.

    One value-count shuffle for all columns. Missing values take the mode, which
    raises its count. At most 1/min_share categories per column are frequent.
    """
    if not cols:
        return {}, {}, None
    counts = materialize(value_counts(df, cols), BROADCAST_ROWS)
    rows = df.count() if rows is None else rows
    modes = {name: (value, rows - n) for name, value, n in _modes(df, cols, counts.df)}
    fill = local_frame(
        df.sparkSession,
        [(c, modes[c][0], modes[c][1]) for c in cols if c in modes],
        "name string, value string, extra bigint",
    )
    filled = counts.df.join(F.broadcast(fill), ["name", "value"], "left").select(
        "name", "value", (F.col("n") + F.coalesce("extra", F.lit(0)) < F.lit(min_share * rows)).alias("rare")
    )
    # The collected lists have 1/min_share values per column at most.
    common = F.collect_list(F.when(~F.col("rare"), F.col("value"))).alias("common")
    per_name = filled.groupBy("name").agg(common, F.count_if("rare").alias("rare"))
    found = {r["name"]: r for r in per_name.collect()}
    slots = {
        c: {"frequent": sorted(found[c]["common"]), "has_rare": found[c]["rare"] > 0}
        if c in found
        else {"frequent": [], "has_rare": False}
        for c in cols
    }
    fills = {c: modes[c][0] if c in modes else None for c in cols}
    if not any(s["has_rare"] for s in slots.values()):
        return slots, fills, None
    return slots, fills, materialize(filled.where("rare").select("name", "value"))


def _modes(df: DataFrame, cols: Sequence[str], counts: DataFrame) -> list[tuple[str, str, int]]:
    """(name, most frequent value, rows with a value) of each column, from its value counts.

    The same rule for ties as everywhere: the smallest text, however long it is. Digests don't tell which
    of two long texts is smaller, so where one ties, the texts are read.
    """
    most = counts.groupBy("name").agg(F.max("n").alias("most"), F.sum("n").alias("rows"))
    tied = counts.join(F.broadcast(most), "name").where("n = most").groupBy("name", "rows")
    digests = F.count_if(F.col("value").startswith("md5:"))
    found = tied.agg(F.min("value").alias("v"), (F.count(F.lit(1)) > 1).alias("tie"), (digests > 0).alias("long")).collect()  # one row per column
    unclear = [r["name"] for r in found if r["tie"] and r["long"]]
    known = [(r["name"], r["v"], r["rows"]) for r in found if r["name"] not in unclear]
    if not unclear:
        return known
    key = F.when(F.length("value") > LONG_TEXT, F.concat(F.lit("md5:"), F.md5("value"))).otherwise(F.col("value"))
    best = top_values(df, [c for c in cols if c in unclear], 1).select("name", key.alias("v")).join(most, "name")
    return known + [(r["name"], r["v"], r["rows"]) for r in best.collect()]


def _slot_column(out, df, c, slots, fill, rare, name):
    """Index of the category: its own slot, the rare slot, or one past the end."""
    v = F.expr(category_text(df.schema[c]))
    value = F.coalesce(v, F.lit(fill)) if fill is not None else v
    frequent = slots["frequent"]
    end = len(frequent) + int(slots["has_rare"])
    found = F.array_position(F.array(*[F.lit(f) for f in frequent]), value) if frequent else F.lit(0)
    index = F.when(F.coalesce(found, F.lit(0)) > 0, found - 1)
    if slots["has_rare"]:
        seen = rare.df.where(F.col("name") == c).select(F.col("value").alias("__v"), F.lit(True).alias("__rare"))
        table = type(rare)(seen, rare.rows, rare.small)
        out = lookup_join(out.withColumn("__v", value), table, ["__v"])
        index = index.when(F.col("__rare"), len(frequent))
    return out.withColumn(name, index.otherwise(end).cast("double")).drop("__v", "__rare")


def _one_hot(df, inputs, outputs, sizes):
    """Encoder with the given slot counts; the index past the end becomes all zeros."""
    encoder = OneHotEncoder(inputCols=inputs, outputCols=outputs, handleInvalid="keep", dropLast=True)
    largest = local_frame(
        df.sparkSession, [tuple(float(s - 1) for s in sizes)], ", ".join(f"{c} double" for c in inputs)
    )
    return encoder.fit(largest)


def onehot_sums(df: DataFrame, cols: Sequence[str], min_share: float = RARE_SHARE) -> DataFrame:
    """(name, slot, rows): how many rows fall in each one-hot slot."""
    slots, fills, _ = fit_slots(df, cols, min_share)
    cells = []
    for c in cols:
        v = F.expr(category_text(df.schema[c]))
        value = F.coalesce(v, F.lit(fills[c])) if fills[c] is not None else v
        frequent = slots[c]["frequent"]
        slot = F.when(value.isin(*frequent), value) if frequent else F.when(F.lit(False), value)
        cells.append(F.struct(F.lit(c).alias("name"), slot.otherwise(F.lit("(rare)")).alias("slot")))
    return df.select(F.inline(F.array(*cells))).groupBy("name", "slot").agg(F.count(F.lit(1)).alias("rows"))
