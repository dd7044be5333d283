"""Scans, sinks and row-level operators."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F, types as T

from tidewatch.functions import enrich as en, periods, text
from tidewatch.operators import profiles, sampling
from tidewatch.plans.registry import query
from tidewatch.session import checkpoint_folder
from tidewatch.sources import tables as tb
from tidewatch.sources.model import table, transactions

# --- periods -----------------------------------------------------------------


@query("""
SELECT o_orderkey,
       ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::BIGINT AS month_no,
       date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day_no,
       floor(date_diff('day', DATE '1970-01-05', o_orderdate::DATE) / 7.0)::BIGINT AS week_no
FROM orders""")
def period_offsets(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", periods.month_offset(d).alias("month_no"), periods.day_offset(d).alias("day_no"), periods.week_offset(d).alias("week_no")
    )


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_first,
       date_trunc('week', o_orderdate)::DATE AS week_first, o_orderdate::DATE AS same_day
FROM orders""")
def period_starts(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        periods.month_start(periods.month_offset(d)).alias("month_first"),
        periods.week_start(periods.week_offset(d)).alias("week_first"),
        periods.day_date(periods.day_offset(d)).alias("same_day"),
    )


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y_%m') AS month_label,
       strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_label, strftime(o_orderdate, '%Y-%m-%d') AS day_label,
       floor(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) / 7.0)::BIGINT AS week_from_thursday
FROM orders""")
def period_labels(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        *[periods.period_label(d, lv).alias(f"{lv}_label") for lv in ("month", "week", "day")],
        periods.period_number(d, "week").alias("week_from_thursday"),
    )


@query("""
SELECT o_orderkey, o_totalprice,
       o_orderdate >= TIMESTAMP '1999-06-01' AS in_write_range
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' AND o_orderdate < TIMESTAMP '1999-07-01'""")
def look_back_range_scan(spark, sf):
    read = periods.read_range("monthly", 6, batch="1999-06")
    write = periods.write_range("monthly", batch="1999-06")
    rows = read.apply(table(spark, sf, "orders"), "o_orderdate")
    start = F.lit(write.start).cast(rows.schema["o_orderdate"].dataType)
    return rows.select("o_orderkey", "o_totalprice", (F.col("o_orderdate") >= start).alias("in_write_range"))


@query("""
SELECT 'daily' AS cadence, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-05-02' AND o_orderdate < TIMESTAMP '1999-06-02'
UNION ALL SELECT 'weekly', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-05-08' AND o_orderdate < TIMESTAMP '1999-06-14'
UNION ALL SELECT 'train', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def cadence_ranges(spark, sf):
    orders = table(spark, sf, "orders")
    ranges = {
        "daily": periods.read_range("daily", 30, batch="1999-06-01"),
        "weekly": periods.read_range("weekly", 30, batch="1999-06-07"),
        "train": periods.read_range("monthly", 3, train=("1997-01-01", "1999-01-01")),
    }
    out = None
    for name, r in ranges.items():
        part = r.apply(orders, "o_orderdate").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cadence"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- row enrichment ------------------------------------------------------------


@query("""
SELECT o_orderkey, o_orderpriority IS NULL OR trim(lower(CASE WHEN o_orderkey % 5 = 0 THEN ' Unknown ' WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END)) IN ('', 'none', 'null', 'unknown', 'nil') AS missing_text,
       CASE WHEN o_orderkey % 3 = 0 THEN true ELSE false END AS missing_number
FROM orders""")
def no_value_flags(spark, sf):
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, " Unknown ").when(key % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("t"),
        F.when(key % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"),
    )
    return df.select("o_orderkey", text.no_value(df, "t").alias("missing_text"), text.no_value(df, "x").alias("missing_number"))


# Keyword groups matched in document texts.
KEYWORDS = {"license": ["license", "copyright", "warranty"], "contact": ["email", "phone", "call"]}


@query("""
SELECT doc_id, nullif(regexp_extract(text, '(?i)\\b(license|copyright|warranty)\\b', 1), '') AS license_risky_keyword,
       nullif(regexp_extract(text, '(?i)\\b(email|phone|call)\\b', 1), '') AS contact_risky_keyword,
       regexp_matches(text, '(?i)\\b(license|copyright|warranty)\\b') AS is_license_kw_found,
       regexp_matches(text, '(?i)\\b(email|phone|call)\\b') AS is_contact_kw_found
FROM documents""")
def keyword_groups(spark, sf):
    return text.keyword_flags(table(spark, sf, "documents").select("doc_id", "text"), "text", KEYWORDS).drop("text")


# A keyword table: the first two words of every benchmark item, in any script, and "the" with the first one.
@query(r"""
WITH words AS (SELECT item_id % 3 AS grp, regexp_extract(text, '^[\p{L}\p{M}\p{N}_]+ [\p{L}\p{M}\p{N}_]+') AS keyword FROM benchmark),
kw AS (SELECT DISTINCT grp, keyword FROM words WHERE keyword <> '' UNION SELECT grp, 'the ' || split_part(keyword, ' ', 1) FROM words WHERE keyword <> ''),
plain AS (SELECT doc_id, ' ' || lower(regexp_replace(replace(text, ' ', '  '), '([^\p{L}\p{M}\p{N}_ ])', ' \1 ', 'g')) || ' ' AS t FROM documents)
SELECT DISTINCT doc_id, grp, keyword FROM plain JOIN kw ON contains(t, ' ' || replace(lower(keyword), ' ', '  ') || ' ')""")
def keyword_table_hits(spark, sf):
    first = F.regexp_extract("text", rf"^[{text.WORD}]+ [{text.WORD}]+", 0)
    pairs = table(spark, sf, "benchmark").select((F.col("item_id") % 3).alias("grp"), first.alias("keyword")).filter("keyword <> ''")
    common = pairs.select("grp", F.concat(F.lit("the "), F.split("keyword", " ")[0]).alias("keyword"))
    return text.keyword_hits(table(spark, sf, "documents"), "doc_id", "text", pairs.unionByName(common), "grp", "keyword")


_NAMES_SQL = r"""
names AS (SELECT p_partkey, p_name AS a,
  CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ', ltd.' WHEN 1 THEN replace(p_name, 'e', 'a')
       WHEN 2 THEN p_brand || ' ' || p_name ELSE p_type END AS b FROM part),
clean AS (SELECT p_partkey, a, b,
  list_filter(string_split_regex(lower(regexp_replace(a, '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~]', ' ', 'g')), ' +'), lambda w: length(w) > 3) AS wa,
  list_filter(string_split_regex(lower(regexp_replace(b, '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~]', ' ', 'g')), ' +'), lambda w: length(w) > 3) AS wb FROM names),
sided AS (SELECT *, CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END AS short, CASE WHEN len(wa) <= len(wb) THEN wb ELSE wa END AS long FROM clean),
by_word AS (SELECT p_partkey, avg(d) AS d FROM (
  SELECT p_partkey, i, min(levenshtein(short[i], l)) AS d
  FROM (SELECT p_partkey, short, long, unnest(range(1, len(short) + 1)) AS i FROM sided) s, unnest(s.long) AS t(l) GROUP BY ALL) GROUP BY 1)"""


@query("""
SELECT p_partkey, round(least(coalesce(w.d, 100986000.0), levenshtein(a, b)), 6) AS distance,
       least(coalesce(w.d, 100986000.0), levenshtein(a, b)) < 1 AS same_name
FROM names LEFT JOIN by_word w USING (p_partkey)""", ctes=_NAMES_SQL)
def name_matches(spark, sf):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    df = table(spark, sf, "part").select(
        "p_partkey",
        name.alias("a"),
        F.when(k == 0, F.concat(F.upper(name), F.lit(", ltd.")))
        .when(k == 1, F.replace(name, F.lit("e"), F.lit("a")))
        .when(k == 2, F.concat_ws(" ", "p_brand", "p_name"))
        .otherwise(F.col("p_type")).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return df.select("p_partkey", F.round(text.name_distance(a, b), 6).alias("distance"), text.name_match(a, b).alias("same_name"))


@query("""
SELECT c_custkey, CASE n_name WHEN 'NATION_0' THEN 'High' WHEN 'NATION_1' THEN 'Medium' WHEN 'NATION_2' THEN 'Low' END AS risk
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def country_risk_map(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = {"NATION_0": "High", "NATION_1": "Medium", "NATION_2": "Low"}
    return df.select("c_custkey", en.risk_level(F.col("n_name"), levels).alias("risk"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END <= 6, false) AS new_account,
       CASE WHEN c_acctbal > 5.0 THEN 1 ELSE 0 END AS guarded,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'High' ELSE 'Low' END AS risk
FROM customer""")
def account_flags(spark, sf):
    months = F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        en.is_new_account(months).alias("new_account"),
        en.min_amount_guard(F.lit(1), F.col("c_acctbal")).alias("guarded"),
        en.risk_class(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).alias("risk"),
    )


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 1 ELSE 0 END::BIGINT AS response,
       (nullif(o_orderpriority, '5-LOW') IS NOT NULL)::BIGINT AS has_card FROM orders""")
def binary_recodes(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        en.recode(F.col("o_orderstatus"), {"O": 1, "P": 1}, 0).alias("response"),
        en.has_value(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("has_card"),
    )


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, 0) AS quantity,
       CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag FROM lineitem""")
def numeric_fill(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("flag"),
    )
    return en.fill_numeric(df)


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, event_type FROM events")
def nan_as_null(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "event_type"
    )
    return en.nan_to_null(df)


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def bulk_cast(spark, sf):
    return en.cast_cols(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "absent"], "double")


@query("""
SELECT e.event_id, sha2, k, first_type, last_two FROM (
  SELECT event_id, sha256(event_type || '-' || user_id::VARCHAR) AS sha2, json_extract(props, '$.k')::BIGINT AS k,
         upper(left(event_type, 1)) AS first_type, right(lpad(user_id::VARCHAR, 4, '0'), 2) AS last_two FROM events) e""")
def scalar_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.sha2(F.concat_ws("-", "event_type", "user_id"), 256).alias("sha2"),
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.upper(F.substring("event_type", 1, 1)).alias("first_type"),
        F.right(F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit(2)).alias("last_two"),
    )


# --- sources and sinks ------------------------------------------------------------


@query("""
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderpriority = '2-HIGH' THEN 'high' ELSE 'rest' END AS target,
       count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def routed_tables(spark, sf):
    parts = tb.route(
        table(spark, sf, "orders"),
        {"urgent": F.col("o_orderpriority") == "1-URGENT", "high": "o_orderpriority = '2-HIGH'"},
        default="rest",
    )
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(name).alias("target"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_nationkey < 5 THEN 'balance,nation' WHEN c_acctbal < 0 THEN 'balance' ELSE 'nation' END AS rejected_by
FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5""")
def rejected_rows(spark, sf):
    rules = {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") >= 5}
    _, bad = tb.validate(table(spark, sf, "customer"), rules)
    return bad.select("c_custkey", "rejected_by")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey >= 5")
def accepted_rows(spark, sf):
    rules = {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") >= 5}
    return tb.validate(table(spark, sf, "customer"), rules)[0].select("c_custkey")


@query("""
SELECT c_custkey, c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT c_custkey, round(c_acctbal + 100, 2) FROM customer WHERE c_custkey % 10 = 3
UNION ALL SELECT c_custkey + 100000000, 0.0 FROM customer WHERE c_custkey % 100 = 7""")
def key_upsert(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    key = F.col("c_custkey")
    changed = base.filter(key % 10 == 3).withColumn("c_acctbal", F.round(F.col("c_acctbal") + 100, 2))
    added = base.filter(key % 100 == 7).select((key + 100000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return tb.upsert(base, changed.unionByName(added), ["c_custkey"])


# written as delimited text with dates of its own format, and read with a declared schema; bad dates are NULL
@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS o_orderdate, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_comment END AS o_comment
FROM (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority || ';"x"' AS o_comment FROM orders)""")
def flat_file_rows(spark, sf):
    folder = f"{checkpoint_folder(spark)}/flat-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    day = F.when(key % 7 != 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("31.02.x")
    comment = F.when(key % 5 != 0, F.concat("o_orderpriority", F.lit(';"x"')))
    text_rows = table(spark, sf, "orders").select(key, day.alias("o_orderdate"), "o_totalprice", comment.alias("o_comment"))
    text_rows.write.csv(folder, header=True, sep=";", quote='"', escape="\\")
    fields = [("o_orderkey", T.LongType()), ("o_orderdate", T.DateType()), ("o_totalprice", T.DoubleType()), ("o_comment", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return tb.read_flat(spark, folder, tb.FlatFileSpec(schema, ";", True, {"o_orderdate": "dd.MM.yyyy"}))


# written, appended to, updated with repeated and NULL keys, and read back
@query("""
SELECT k, max(b) AS b, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, CASE WHEN c_custkey % 50 = 0 THEN 7.0 WHEN c_custkey % 10 = 3 THEN 5.0 ELSE c_acctbal END AS b
  FROM customer WHERE c_custkey % 50 <> 0 OR c_custkey = 50) GROUP BY k""")
def table_write_modes(spark, sf):
    folder = f"{checkpoint_folder(spark)}/modes-{uuid.uuid4().hex}"
    key = F.col("c_custkey")
    base = table(spark, sf, "customer").select(F.when(key % 50 != 0, key).alias("k"), F.col("c_acctbal").alias("b"), key)
    spec = tb.TableSpec(f"{folder}/t", base.select("k", "b").schema, ("k",), "overwrite")
    tb.write_table(base.filter(key % 2 == 0).select("k", "b"), spec)
    tb.write_table(base.filter(key % 2 == 1).select("k", "b"), replace(spec, mode="append"))
    changed = base.filter(key % 10 == 3).select("k", F.lit(5.0).alias("b"))
    nameless = base.filter("k is null").select("k", F.lit(7.0).alias("b"))
    tb.write_table(changed.unionByName(changed).unionByName(nameless), replace(spec, mode="update"))
    return tb.read_table(spark, spec).groupBy("k").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))


# published twice; what is there already is skipped
@query("SELECT 'N' || n_regionkey AS id, min(n_nationkey) AS first_nation, count(*) AS published FROM (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1) GROUP BY 1, n_regionkey")
def published_nodes(spark, sf):
    folder = f"{checkpoint_folder(spark)}/nodes-{uuid.uuid4().hex}"
    nodes = table(spark, sf, "nation").groupBy(F.concat(F.lit("N"), F.col("n_regionkey")).alias("id")).agg(F.min("n_nationkey").alias("first_nation"))
    tb.publish_nodes(nodes.filter("first_nation < 3").unionByName(nodes.filter("first_nation < 3")), folder, "region")
    tb.publish_nodes(nodes, folder, "region")
    return tb.read_published(spark, folder, nodes.schema).groupBy("id").agg(F.min("first_nation").alias("first_nation"), F.count(F.lit(1)).alias("published"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31') WHERE rn = 1""")
def latest_per_key(spark, sf):
    # the newest version decides; versions loaded on the same day are told apart by the order key
    df = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("version"), "o_orderdate"
    )
    lo, hi = dt.datetime(1996, 1, 1), dt.datetime(2000, 12, 31)
    kept = tb.read_as_of(df, job_ts="o_orderdate", frm=lo, to=hi).drop("o_orderdate")
    return tb.read_as_of(kept, ["o_custkey"], job_ts="version").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, NULL::DOUBLE AS limit_usd, s_acctbal FROM supplier")
def conformed_schema(spark, sf):
    schema = T.StructType(
        [T.StructField("s_suppkey", T.StringType()), T.StructField("limit_usd", T.DoubleType()), T.StructField("s_acctbal", T.DoubleType())]
    )
    return tb.conform(table(spark, sf, "supplier"), schema)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-08-15' - INTERVAL 18 MONTH")
def retention_cut(spark, sf):
    return tb.retain(table(spark, sf, "orders"), "o_orderdate", 18, dt.date(1999, 8, 15)).select("o_orderkey")


@query("""
SELECT "column", (SELECT count(*) FROM orders) AS rows, nulls, round(nulls * 100.0 / (SELECT count(*) FROM orders), 2) AS null_pct FROM (
  SELECT 'o_orderkey' AS "column", 0::BIGINT AS nulls UNION ALL SELECT 'o_custkey', 0
  UNION ALL SELECT 'status', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders)""")
def table_null_profile(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return profiles.table_profile(df)


# --- sampling -----------------------------------------------------------------------


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t FROM s)
SELECT o_custkey, CASE WHEN t <= t // 3 THEN n ELSE least(n, greatest(floor(n * (t // 3) / t), 1)) END::BIGINT AS kept
FROM s, t""")
def stratified_row_counts(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    kept = sampling.stratified_cap(orders, "o_custkey", "o_orderkey", orders.count() // 3, seed=5)
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("kept"))


@query()
def hashed_row_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2, seed=3)


@query("SELECT customer_id, min(txn_ts)::DATE AS first_day, count(*) AS n FROM trx GROUP BY 1", trx=True)
def enriched_scan(spark, sf):
    return transactions(spark, sf, ["customer_id", "txn_ts"]).groupBy("customer_id").agg(
        F.min("txn_ts").cast("date").alias("first_day"), F.count(F.lit(1)).alias("n")
    )
