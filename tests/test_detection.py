import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import drift, quality, risks as rk, scoring


def test_scores(spark):
    rows = [(i, float(i % 10), float(i % 7), 3.0) for i in range(100)] + [(1000, 500.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    model = scoring.fit_scores(df, ["a", "b", "c"])
    out = {r["id"]: r for r in model.score(df, "s").collect()}
    top = out[1000]
    assert top["s_score"] > 0.99 and top["s_a_rank"] == 1 and top["s_pattern"].startswith("a|") and top["s_a_rating"] == 10000
    assert all(0 <= r["s_score"] < 1 for r in out.values())
    assert model.spread["c"] == 0.0 and out[5]["s_c_rating"] == 0


def test_fills_and_vectors(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 4.0, "y"), (3, 2.0, "x")], "id int, v double, c string")
    assert [r["v"] for r in scoring.numeric_features(df, ["v"], "mean").orderBy("id").collect()] == [3.0, 4.0, 2.0]
    assert scoring.assemble(scoring.numeric_features(df, ["v"]), ["v"]).first()["features"][0] == 0.0
    coded = scoring.categorical_features(df, ["c"])
    assert [r["c_index"] for r in coded.orderBy("id").collect()] == [0.0, 1.0, 0.0]
    assert [tuple(r["c_vec"]) for r in coded.orderBy("id").collect()] == [(2, 0), (2, 1), (2, 0)]
    unknown = scoring.categorical_features(df.withColumn("c", F.when(F.col("id") > 1, F.col("c"))), ["c"]).orderBy("id").collect()
    assert (unknown[0]["c_index"], tuple(unknown[0]["c_vec"])) == (2.0, (2, None))
    assert scoring.numeric_features(df.withColumn("v", F.lit(None).cast("double")), ["v"], "mean").first()["v"] == 0.0


def test_rule_literals_and_conditions(spark):
    df = spark.createDataFrame([("t1", "O'Neil", 5, dt.date(2024, 1, 1)), ("t2", None, 5, dt.date(2024, 1, 1))], "tr_id string, n string, v int, d date")
    rule = rk.RiskRule(
        "r", "c", 10, {"x": "activity.n = {parameters.name} AND activity.v >= {parameters.v} AND activity.d <= {parameters.d}"}, {"x": True},
        parameters={"name": "O'Neil", "v": 5, "d": dt.date(2024, 1, 1)},
    )
    assert [r["tr_id"] for r in rk.identify_risks(df, [rule]).collect()] == ["t1"]
    off = rk.RiskRule("q", "c", 10, {"x": "activity.v > 100"}, {"x": False})
    assert rk.identify_risks(df, [rule, off]).count() == 3


def test_suppression(spark):
    rows = [("e", "p", dt.date(2024, 1, 1)), ("e", "p", dt.date(2024, 1, 20)), ("e", "p", dt.date(2024, 6, 1)), ("e", None, dt.date(2024, 6, 1)), ("e", None, dt.date(2024, 6, 2))]
    df = spark.createDataFrame(rows, "e string, k string, t date")
    flags = [r["is_suppressed"] for r in rk.suppress(df, "e", "k", "t", 30).orderBy("k", "t").collect()]
    assert flags == [False, False, False, True, False]
    assert rk.suppress(df, "e", "k", "t", -1).filter("is_suppressed").count() == 0


def test_suppression_runs_from_the_last_emitted(spark):
    """A chain that fires every 20 days with a period of 50 is heard on days 0, 60, 120, ..."""
    start = dt.datetime(2024, 1, 1, 9)
    rows = [("e", "p", start + dt.timedelta(days=20 * i, minutes=m), 10 * i + m) for i in range(12) for m in (0, 5)]
    rows += [(None, "p", start, 900), (None, "p", start + dt.timedelta(days=50), 901), (None, "p", start + dt.timedelta(days=51), 902), ("e", "q", None, 903)]
    df = spark.createDataFrame(rows, "e string, k string, t timestamp, id int")
    got = {r["id"] for r in rk.suppress(df, "e", "k", "t", 50, tie=["id"]).filter("NOT is_suppressed").collect()}
    assert got == {0, 30, 60, 90, 900, 902, 903}
    # periods of their own: -1 is always heard and counts as emitted
    df = df.withColumn("d", F.when(F.col("id") == 105, -1).otherwise(50))
    got = {r["id"] for r in rk.suppress(df, "e", "k", "t", F.col("d"), tie=["id"]).filter("NOT is_suppressed AND k = 'p' AND e IS NOT NULL").collect()}
    assert got == {0, 30, 60, 90, 105}


def test_stability_of_equal_sets(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("zero"), F.lit(7.0).alias("same"))
    assert {r["feature"]: r["csi"] for r in drift.csi(df, df, ["x", "zero", "same"]).collect()} == {"x": 0.0, "same": 0.0}
    moved = df.select((F.col("x") + 500).alias("x"))
    assert drift.psi(df, moved, "x").first()["result"] == "FAIL"


def test_histogram_without_range(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [(r["bin"], r["rate_ref"]) for r in drift.histogram_compare(df, df, "x").collect()] == [(0, 1.0)]


def test_trigger_formats(spark):
    texts = ['[{"triggerID":"a"},{"triggerId":"b"},{"tr_id":"c"}]', '["d","e"]', "[]", "nope", None, '[{"other":1}]']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, triggers string")
    assert [r["trigger_id"] for r in quality.explode_triggers(df).orderBy("trigger_id").collect()] == list("abcde")
    row = quality.alert_counts(df).first()
    assert (row["total_alerts"], row["consolidated"], row["min_triggers"], row["max_triggers"]) == (6, 2, 0, 3)


def test_timing_steps(spark):
    df = spark.createDataFrame([(0.8, 1.9, 1.5), (9.0, 9.0, 9.0)], "alert_details double, feature_loading double, network_view double")
    assert [r["overall_score"] for r in quality.timing_score(df).collect()] == [100, 40]


def test_fit_reads_the_training_rows_once(spark):
    """Median and MAD come from values counted once; a feature without spread takes the standard deviation."""
    import statistics

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return float(v % 13)

    df = spark.range(200).select(watched("id").alias("a"), (F.col("id") % 10).cast("double").alias("b"))
    model = scoring.fit_scores(df, ["a", "b"])
    values = [float(i % 13) for i in range(200)]
    middle = statistics.median(values)
    assert model.centre == {"a": middle, "b": 4.5}
    assert model.spread == {"a": statistics.median(abs(v - middle) for v in values) * scoring.MAD_FACTOR, "b": 2.5 * scoring.MAD_FACTOR}
    assert seen.value <= 200
    flat = spark.createDataFrame([(7.0, None, None)] * 9 + [(8.0, None, 1.0)], "a double, b double, c double")
    model = scoring.fit_scores(flat, ["a", "b", "c"])
    assert model.centre == {"a": 7.0, "c": 1.0} and abs(model.spread["a"] - 0.3) < 1e-9 and model.spread["c"] == 0.0
