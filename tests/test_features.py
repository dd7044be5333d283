import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import periods, text
from tidewatch.functions.history import history, zscore
from tidewatch.operators import features as fx
from tidewatch.operators.catalogue import CATALOGUE, LOOK_BACK, features
from tidewatch.operators.features import Feature, FeatureError, run_features

PARAMS = {LOOK_BACK: 6, "min_trx_amount": 1.0, "max_trx_amount": 1000.0, "ndays": 3, "similar_amounts_thr": 5.0}


def trx(spark, rows):
    """(customer, day, amount, direction, cp) rows as model transactions."""
    df = spark.createDataFrame(rows, "customer_id string, day string, amount_usd double, direction string, cp_id string")
    ts = F.to_timestamp_ntz("day")
    return df.withColumns(
        {
            "txn_ts": ts,
            "month_offset": periods.month_offset(ts),
            "day_offset": periods.day_offset(ts),
            "txn_id": F.monotonically_increasing_id().cast("string"),
        }
    )


def test_offsets_before_epoch(spark):
    row = spark.sql("select date'1969-12-31' d, date'1970-01-04' e, date'1970-01-05' f").select(
        periods.week_offset(F.col("d")), periods.week_offset(F.col("e")), periods.week_offset(F.col("f")), periods.month_offset(F.col("d"))
    ).first()
    assert tuple(row) == (-1, -1, 0, -1)


def test_ranges():
    r = periods.read_range("monthly", 6, batch="2024-03")
    assert (r.start, r.end) == (dt.datetime(2023, 9, 1), dt.datetime(2024, 4, 1))
    r = periods.read_range("daily", 10, train=("2024-01-01", "2024-02-01"))
    assert (r.start, r.end) == (dt.datetime(2023, 12, 22), dt.datetime(2024, 2, 1))
    assert periods.write_range("weekly", batch="2024-01-01").end == dt.datetime(2024, 1, 8)
    with pytest.raises(ValueError):
        periods.write_range("weekly", batch="2024-01-02")
    with pytest.raises(ValueError):
        periods.write_range("monthly")


def test_range_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = periods.read_range("monthly", 1, batch="1999-06").apply(orders, "o_orderdate")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_name_match(spark):
    cases = [
        ("John Smith", "Smith, John", True),
        ("Dr. John A. Smith", "john smith", True),
        ("John Smith", "Jane Smith", False),
        ("ab", "abcd efgh", False),
        (None, "x", False),
        ("abc", "abc", True),
        ("", "", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    bad = df.filter(text.name_match(F.col("a"), F.col("b")) != F.col("want")).collect()
    assert bad == []


def test_keywords_are_escaped_and_limited(spark):
    df = spark.createDataFrame([("pay c++ now",), ("Gold bar",), ("golden",)], "t string")
    words = spark.createDataFrame([("X", "gold"), ("X", "bar")], "g string, k string")
    got = text.keyword_flags(df, "t", text.keywords_of(words, "g", "k")).collect()
    assert [r["x_risky_keyword"] for r in got] == [None, "Gold", None]
    with pytest.raises(ValueError):
        text.keywords_of(words, "g", "k", limit=1)


def test_keyword_table_of_any_script(spark):
    texts = ["Die Größe zählt", "die grösse", "красный Кот идёт", "котик красный кот", "the cat", "THE CAT!", "the dog", "concat the", "café au lait", "cafés", "l'été", "$$$", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = ["größe", "кот", "красный кот", "The Cat", "café", "the", "été", "$$$", "", None, "unseen", "the unseen cat"]
    table = spark.createDataFrame([("g", w) for w in words] + [("h", "кот")], "g string, k string")
    got = {(r["id"], r["g"], r["k"]) for r in text.keyword_hits(df, "id", "t", table, "g", "k").collect()}
    want = {(0, "größe"), (2, "кот"), (3, "кот"), (2, "красный кот"), (3, "красный кот"), (4, "The Cat"), (5, "The Cat"), (8, "café"), (10, "été")}
    want |= {(i, "the") for i in (4, 5, 6, 7)}
    assert got == {(i, "g", k) for i, k in want} | {(2, "h", "кот"), (3, "h", "кот")}


def test_a_common_first_word_draws_nothing(spark):
    """Keywords that begin with a word of every text meet the texts by their rare words."""
    from test_distributed import largest_task

    df = spark.range(20_000).select("id", F.concat(F.lit("the w"), F.col("id")).alias("t")).repartition(8)
    table = spark.range(2000).select(F.lit("g").alias("g"), F.concat(F.lit("the w"), F.col("id") * 10).alias("k"))
    hits = text.keyword_hits(df, "id", "t", table, "g", "k")
    assert hits.count() == 2000
    assert largest_task(spark, lambda: hits.write.format("noop").mode("overwrite").save()) < 45_000


def test_planted_patterns(spark):
    rows = [("a", "2024-01-0%d" % d, 100.0, "credit", f"c{d}") for d in range(1, 6)]
    rows += [("a", "2024-01-03", 290.0, "debit", "z"), ("b", "2024-01-01", 10.0, "debit", None)]
    out = fx.run_features(
        trx(spark, rows), features("cnt_trx", "one_to_many", "many_to_one", "cnt_trx_n_day", "sum_rapid_movement", "sum_pipe_customer"), PARAMS
    )
    a, b = out.orderBy("customer_id").collect()
    assert (a["cnt_trx"], a["many_to_one"], a["one_to_many"], a["cnt_trx_n_day"]) == (6, 5, 1, 4)
    assert a["sum_rapid_movement"] == 300.0 and a["sum_pipe_customer"] == 0.0
    assert (b["one_to_many"], b["many_to_one"], b["sum_in_trx"], b["sum_in_out_ratio"]) == (0, 0, None, None)


def test_structuring_chain(spark):
    rows = [("a", "2024-01-01", 100.0, "debit", "x"), ("a", "2024-01-02", 101.0, "debit", "x"), ("a", "2024-01-03", 102.0, "debit", "x"),
            ("a", "2024-01-20", 500.0, "debit", "x"), ("b", "2024-01-01", 100.0, "debit", "x")]
    got = {r["customer_id"]: r["many_small_trx"] for r in fx.run_features(trx(spark, rows), features("many_small_trx"), PARAMS).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_zscore_edges(spark):
    rows = [("a", m, 5.0) for m in range(4)] + [("b", m, float(v)) for m, v in enumerate([1, 2, 3, 100, 0])]
    df = spark.createDataFrame(rows, "e string, m long, v double")
    out = df.withColumn("z", zscore("v", history("e", "m", 6))).orderBy("e", "m").collect()
    assert [r["z"] for r in out if r["e"] == "a"] == [None] * 4
    assert [r["z"] for r in out if r["e"] == "b"] == [None, None, 2.11, 5.0, 0.0]


def test_empty_input(spark):
    assert fx.run_features(trx(spark, []), features("cnt_trx", "z_score_cnt_trx", "many_small_trx"), PARAMS).count() == 0


def test_checks(spark):
    df = trx(spark, [("a", "2024-01-01", 1.0, "debit", "x")])
    with pytest.raises(FeatureError, match="missing columns"):
        fx.run_features(df, features("cnt_trx_cash"), PARAMS)
    with pytest.raises(FeatureError, match="missing parameters"):
        fx.run_features(df, features("z_score_cnt_trx"), {})
    with pytest.raises(FeatureError, match="different keys"):
        fx.run_features(df, [CATALOGUE["cnt_trx"], Feature("w", ("w",), frozenset(), keys=("customer_id",))])
    two = Feature("x", ("x",), frozenset(), measures=lambda p: {"cnt_trx": fx.total(F.lit(1))})
    with pytest.raises(FeatureError, match="two ways"):
        fx.run_features(df, [CATALOGUE["cnt_trx"], two])
    same = Feature("x", ("n",), frozenset(), measures=lambda p: {"n": fx.count()})
    with pytest.raises(FeatureError, match="repeats"):
        fx.run_features(df, [CATALOGUE["cnt_trx"], same])


def test_selection():
    core = CATALOGUE.values()
    on, off = {"active": True, "train": True}, {"active": False, "train": False}
    assert [f.id for f in fx.select_features(core, {"cnt_trx": {"v1": on}, "max_trx": {"v1": off}})] == ["cnt_trx"]
    own = Feature("cnt_trx", ("cnt_trx",), frozenset(), layer="ext")
    assert fx.select_features([*core, own], {"cnt_trx": {"v1": on}})[0].layer == "ext"
    for spec in ({"cnt_trx": {"1": on}}, {"cnt_trx": {}}, {"cnt_trx": {"v1": {"active": True}}}, {"cnt_trx": {"v1": on, "v2": on}}, {"nope": {"v1": on}},
                 {"sum_trx_n_day": {"v1": on}, "clash": {"v1": on}}):
        with pytest.raises(FeatureError):
            fx.select_features([*core, Feature("clash", ("sum_trx_n_day",), frozenset())], spec)
    only = fx.select_features(core, {"cnt_trx": {"v1": {"active": True, "train": False}}}, train=True)
    assert only == []


def test_params_and_look_back():
    f = fx.select_features(CATALOGUE.values(), {"z_score_cnt_trx": {"v1": {"active": True, "train": True, "params": {LOOK_BACK: 9}}}})
    assert fx.merged_params(f[0], {LOOK_BACK: 6, "k": 1}) == {LOOK_BACK: 9, "k": 1}
    assert fx.max_look_back(f, {LOOK_BACK: 6}, LOOK_BACK) == 9
    with pytest.raises(FeatureError):
        fx.max_look_back(f, {}, LOOK_BACK, horizon=8)


def test_no_expand_and_hash_aggregates(spark):
    """Four distinct counts and a text attribute neither expand nor sort the rows."""
    from tidewatch.sources.model import transactions

    df = transactions(spark, "/root/testdata/sf0.001")
    out = fx.run_features(df, features("one_to_many", "many_to_one", "sum_trx_fop", "sum_trx_name_mis"), PARAMS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan


def test_the_monthly_table_reads_transactions_twice(spark):
    """Once for the roll-up, once for the carried texts; the features equal those without a roll-up."""
    from tidewatch.operators.catalogue import MONTHLY, features
    from tidewatch.plans.monthly_queries import PARAMS, monthly_table
    from tidewatch.sources.model import transactions

    rows = transactions(spark, "/root/testdata/sf0.001").limit(1500)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    trx = rows.mapInArrow(counted, rows.schema)
    out = monthly_table(trx).collect()
    assert len(out) > 100 and seen.value == 2 * 1500
    plain = {(r["customer_id"], r["month_offset"]): r for r in run_features(rows, features(*MONTHLY), PARAMS).na.fill(0).collect()}
    assert len(plain) == len(out)
    for r in out:
        want = plain[r["customer_id"], r["month_offset"]].asDict()
        assert all(r[c] == pytest.approx(v, abs=0.011) if isinstance(v, float) else r[c] == v for c, v in want.items() if c in r)
        assert (r["one_to_many_explainability"] is None) == (r["one_to_many"] == 0)


def test_the_roll_up_is_read_without_a_shuffle_of_its_rows(spark):
    """By keys only what is reduced is shuffled, days are shuffled once; slices of a heavy entity change no result."""
    from tidewatch.operators.catalogue import MONTHLY, monthly_roll_up
    from tidewatch.sources.model import transactions

    trx = transactions(spark, "/root/testdata/sf0.001")
    trx = spark.createDataFrame(trx.limit(2000).collect(), trx.schema)
    heavy = fx.heavy_entities(trx, "customer_id", most=100)
    one, dealt = (monthly_roll_up(trx, MONTHLY, PARAMS, h) for h in (None, heavy))
    assert heavy.count() >= 1 and dealt.rows.filter("_slice > 0").count() > 100 and one.rows.filter("_slice > 0").isEmpty()
    for frame, most in ((lambda r: r.by_keys(), 1), (lambda r: r.by_day(), 1), (lambda r: r.explain("one_to_many"), 0)):
        assert frame(dealt)._jdf.queryExecution().executedPlan().toString().count("Exchange") == most
        rows = [{tuple(x for x in r if not isinstance(x, float)): [x for x in r if isinstance(x, float)] for r in frame(roll).collect()} for roll in (one, dealt)]
        assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 100
        assert all(v == pytest.approx(rows[1][k]) for k, v in rows[0].items())


def test_keyword_hits_broadcast_no_texts(spark):
    df = spark.createDataFrame([(1, "the red fox"), (2, "a blue fox")], "id long, t string")
    table = spark.createDataFrame([("g", "red fox")], "g string, k string")
    hits = text.keyword_hits(df, "id", "t", table, "g", "k")
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["k"]) for r in hits.collect()] == [(1, "red fox")]


def test_dealt_measures_equal_plain_ones(spark):
    """With heavy entities named, rows are shuffled once and what is left of them once; no result changes."""
    from tidewatch.sources.model import transactions

    trx = transactions(spark, "/root/testdata/sf0.001")
    trx = spark.createDataFrame(trx.limit(2000).collect(), trx.schema)
    trx = trx.withColumn("cp_id", F.when(F.col("cp_id") % 7 != 0, F.col("cp_id")))  # some without counterparty
    ids = features("cnt_trx", "many_to_one", "max_trx", "one_to_many", "sum_trx_cash", "sum_trx_fop", "customer_name")
    heavy = fx.heavy_entities(trx, "customer_id", most=100)
    none = heavy.filter("false")
    assert not heavy.isEmpty()
    plain, *dealt = ({r[:2]: r[2:] for r in fx.run_features(trx, ids, PARAMS, heavy=h).collect()} for h in (None, none, heavy))
    assert len(plain) > 100
    for rows in dealt:
        assert rows.keys() == plain.keys()
        assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for k, r in rows.items() for x, y in zip(r, plain[k]))
    marked = trx.withColumn("cp_id", F.concat(F.lit("c"), F.col("cp_id")))  # the text is wider than the counts
    plan = fx.run_features(marked, features("one_to_many", "cnt_trx"), PARAMS, heavy=spark.createDataFrame([], heavy.schema))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and sum("REPARTITION" in line for line in shuffles) == 1
