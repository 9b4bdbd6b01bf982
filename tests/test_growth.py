"""Steps whose time or shuffle grew with the input more than it had to."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import joins, moments, sampling, search
from tablewright.operators.features import LABEL, TablePreprocessor
from tablewright.operators.joins import by_heat
from tablewright.operators.models import Family, TrainShape, model_registry
from tablewright.operators.runs import metric_summary
from tablewright.plans import model_queries


def _log(spark):
    """A run with most of the rows, a run without a number, and 300 small ones."""
    k = F.col("id")
    run = F.when(k < 2000, 7).when(k < 2600, 1000 + k % 300)
    score = F.when(k % 5 != 0, (k * 37 % 101) / 100)
    return spark.range(2700).select(
        run.alias("run_id"), F.concat(F.lit("m"), (k % 11).cast("string")).alias("model"), score.alias("cv_score"), (k % 13 / 13).alias("acc")
    )


def test_rows_of_small_runs_travel_as_they_are(spark):
    hot, rest = by_heat(_log(spark), ["run_id"])
    assert {r[0] for r in hot.select("run_id").distinct().collect()} == {7, None}
    assert rest.count() == 600
    plan = metric_summary(_log(spark).where("run_id > 7"))._jdf.queryExecution().executedPlan().toString()
    # The one exchange has the log's own columns, not four partial sums a metric.
    assert plan.count("hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_summary_of_hot_and_small_runs(spark):
    log = _log(spark)
    found = {(r["run_id"], r["metric"]): r for r in metric_summary(log).collect()}
    plain = {}
    for r in log.collect():
        plain.setdefault(r["run_id"], []).append(r)
    scored = {run for run, rows in plain.items() if any(r["cv_score"] is not None for r in rows)}
    assert len(found) == len(plain) + len(scored)
    for run in scored:
        rows = plain[run]
        best = min(rows, key=lambda r: (r["cv_score"] is None, -(r["cv_score"] or 0), r["model"]))
        score = [r["cv_score"] for r in rows if r["cv_score"] is not None]
        assert found[run, "cv_score"]["best"] == best["cv_score"]
        assert found[run, "cv_score"]["max"] == max(score) and found[run, "cv_score"]["min"] == min(score)
        assert abs(found[run, "cv_score"]["mean"] - sum(score) / len(score)) < 1e-12


def test_values_of_all_columns_are_counted_in_one_pass(spark, monkeypatch):
    """Ranks read their rows once; the rows per value say which keys are hot, and the means of the ranks are known."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(joins, "hot_keys", lambda *a: pytest.fail("rows are counted a second time"))
    k = F.col("id")
    df = spark.range(900).select(
        F.when(k % 3 != 0, k % 7).cast("double").alias("a"), F.when(k % 4 != 1, F.lit(5.0)).alias("b"), ((k * k) % 50).alias("c"), F.lit(None).cast("double").alias("d")
    )
    out, means = moments.ranked(df, ["a", "b", "c", "d"])
    plain = df.toPandas()
    found = out.toPandas()
    for c, mean in zip(plain, means, strict=True):
        expected = plain[c].astype(float).rank().dropna().sort_values().tolist()
        assert found[c].dropna().astype(float).sort_values().tolist() == expected
        assert not expected or abs(mean - sum(expected) / len(expected)) < 1e-9


def test_cut_offs_are_compared_in_plain_expressions(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 3)
    placed = sampling.assign_folds(df, 4, "y", key=["id"])
    assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in placed.groupBy("y", "fold").count().collect()]
    assert len(sizes) == 12 and max(sizes) - min(sizes) <= 1
    many = sampling.assign_folds(df, 40, "y", key=["id"]).groupBy("y", "fold").count().collect()
    assert len(many) == 120 and {r["count"] for r in many} <= {8, 9}


class _Watch:
    """An estimator that notes how many tables are kept, and how many learners run, while it fits."""

    def __init__(self, seen):
        self.seen = seen

    def fit(self, rows):
        self.seen.append(rows.sparkSession.sparkContext._jsc.getPersistentRDDs().size())
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", F.lit(0.0))


def test_learners_have_the_memory_to_themselves(spark, monkeypatch):
    """Only the features are kept while a learner fits; many partitions mean one learner at a time."""
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"), F.rand(1).alias("x"))
    seen = []
    candidate = search.Candidate(Family("watch", {}, lambda params, shape: _Watch(seen)), {})
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    search.refit(df, TablePreprocessor(numericCols=["x"]), [candidate], "classification")
    assert seen == [before + 1]
    few, _ = search.kept(df)
    assert search._at_once(few, 4) == 4
    monkeypatch.setattr(search, "PART_ROWS", 20)
    many, n = search.kept(df, source=True)
    assert (n, many.rdd.getNumPartitions(), search._at_once(many, 4)) == (400, 20, 1)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 2
    few.unpersist()
    many.unpersist()


def test_a_row_with_copies_counts_as_its_copies(spark):
    """Fits on different rows with their copies are the fits on all rows."""
    k = F.col("id")
    rows = spark.range(900).select(
        (k % 4).cast("double").alias("l_discount"), (k % 3).cast("double").alias("l_quantity"), F.lit(1.0).alias("l_tax"), (k % 7 < k % 4).cast("double").alias(LABEL)
    )
    counted, n = model_queries._counted(rows)
    assert (n, counted.count(), counted.rdd.getNumPartitions()) == (900, 21, 1)
    for name, params in (("logreg", {"C": 2.0}), ("svm", {"C": 2.0})):
        family = model_registry("classification", [name])[name]
        plain = family.build(params, TrainShape(n, 3, 2)).fit(model_queries._assembled(rows))
        once = family.build(params, TrainShape(n, 3, 2, model_queries.COPIES)).fit(model_queries._assembled(counted))
        assert max(abs(plain.coefficients.toArray() - once.coefficients.toArray())) < 1e-3
    scaled = rows.select(*[c.alias(name) for name, c in model_queries._scaled(counted, n).items()]).toPandas()
    assert scaled.mean().abs().max() < 1e-9 and scaled.std(ddof=0).round(9).tolist() == [1.0, 1.0, 0.0]
    counted.unpersist()


def test_learners_with_weights_read_different_rows(spark, sf, monkeypatch):
    """Only the learner without weights reads every row of the file."""
    read = {}

    def watched(task, names):
        def build(family):
            return lambda params, shape: _Reader(read, family.name, family.build(params, shape))

        return {n: Family(n, f.space, build(f), f.weighted) for n, f in model_registry(task, names).items()}

    monkeypatch.setattr(model_queries, "model_registry", watched)
    found = model_queries.planted_classes(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert len(found) == 10 and all(r["truth"] == r["prediction"] for r in found)
    assert read.pop("mlp") == n
    assert set(read) == {"logreg", "rf", "xgb", "svm"} and max(read.values()) < n * 0.7


class _Reader:
    """An estimator that notes how many rows it is given."""

    def __init__(self, read, name, inner):
        self.read, self.name, self.inner = read, name, inner

    def fit(self, rows):
        self.read[self.name] = rows.count()
        return self.inner.fit(rows)
