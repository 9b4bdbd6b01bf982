from pyspark.sql import functions as F

from tablewright.operators import features


def test_modes_come_from_the_counts(spark, monkeypatch):
    """The most frequent value was counted again; only ties of long texts need the texts."""
    a, b = "x" * 5000 + "a", "x" * 5000 + "b"
    df = spark.createDataFrame([("u", b), ("v", a), ("v", None), ("u", b), (None, a)], "s string, t string")
    _, fills, _ = features.fit_slots(df, ["s", "t"])
    long = df.where(F.col("t") == a).select(F.concat(F.lit("md5:"), F.md5("t"))).first()[0]
    assert fills == {"s": "u", "t": long}
    monkeypatch.setattr(features, "top_values", None)
    assert features.fit_slots(df, ["s"])[1] == {"s": "u"}
