"""Operators that split hot groups, against plain single-task definitions."""

import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidewatch.functions.order import with_order_key
from tidewatch.operators import components, entity as er, explain as ex, relate, sampling
from tidewatch.operators.neighbours import with_neighbours
from tidewatch.operators.percentiles import percentiles
from tidewatch.operators.relate import join_report, trace


def test_neighbours_equal_the_window(spark):
    rng = random.Random(1)
    # a hot entity with two thirds of the rows, and a hot amount inside it
    rows = [("hot" if rng.random() < 0.66 else f"e{rng.randrange(5)}", 5.0 if rng.random() < 0.4 else float(rng.randrange(300)), rng.randrange(40), i) for i in range(4000)]
    rows += [("hot", None, 1, 4001), ("hot", None, 2, 4002)]
    df = spark.createDataFrame(rows, "e string, v double, d int, id int")
    w = Window.partitionBy("e").orderBy("v", "d", "id")
    want = {(r["id"], r["p"], r["n"]) for r in df.withColumn("p", F.lag("id").over(w)).withColumn("n", F.lead("id").over(w)).collect()}
    out = with_neighbours(df, "e", "v", ["d", "id"], ["id"], ranges=16)
    got = {(r["id"], r["prev"]["id"] if r["prev"] else None, r["next"]["id"] if r["next"] else None) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("seed,values", [(0, 5), (1, 1000), (2, 1)])
def test_percentiles_equal_numpy(spark, seed, values):
    rng = np.random.default_rng(seed)
    rows = [("a" if rng.random() < 0.7 else "b", float(rng.integers(values))) for _ in range(1500)]
    df = spark.createDataFrame([*rows, ("c", None)], "g string, v double")
    probs = {f"p{int(p * 100)}": p for p in (0, 0.1, 0.5, 0.77, 1)}
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", probs).collect()}
    disc = {r["g"]: r for r in percentiles(df, ["g"], "v", probs, "discrete", few_groups=True, count_first=False).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        vals = np.array([v for k, v in rows if k == g])
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(vals, p))
            assert disc[g][n] == np.quantile(vals, p, method="inverted_cdf")


def test_stratified_cap(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("k"), "id")
    out = sampling.stratified_cap(df, "k", "id", 300, seed=1)
    got = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    assert got["hot"] == 200 and all(v == 10 for k, v in got.items() if k != "hot")
    assert {r["id"] for r in out.collect()} == {r["id"] for r in sampling.stratified_cap(df, "k", "id", 300, seed=1).collect()}
    assert sampling.stratified_cap(df, "k", "id", 5000).count() == 3000
    n = sampling.hash_sample(df, "id", 0.3).count()
    assert 800 < n < 1000


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(400, 500)] + [(i, i + 1) for i in range(600, 640)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    assert got == want
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def _grams(t):
    t = f" {t} "
    return {t[i : i + 2] for i in range(len(t) - 1)}


def test_lsh_pairs_equal_brute_force_in_a_hot_bucket(spark):
    # near copies that fill one bucket, cut into cells of two blocks of 20
    texts = [f"international trading company number {a}{b}" for a, b in itertools.product("abcdefghij", "klmnopqrstu")]
    want = {tuple(sorted(p)) for p in itertools.combinations(texts, 2) if len(_grams(p[0]) & _grams(p[1])) / len(_grams(p[0]) | _grams(p[1])) >= 0.8}
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string")
    got = [(r["text_a"], r["text_b"]) for r in er.lsh_pairs(df, "t", block_size=20, bands=32).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_pair_everything_once(spark):
    df = spark.range(100).select(F.when(F.col("id") < 70, 1).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("x"))
    left, right = er._cells(df, ["k"], "x", 9)
    j = left.join(right, ["k", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("x_b")))
    got = [tuple(sorted((r["x"], r["x_b"]))) for r in j.collect()]
    assert len(got) == len(set(got)) == 70 * 69 // 2
    assert left.groupBy("k", "_i", "_j").count().agg(F.max("count")).first()[0] < 30


def test_minhash_estimates_jaccard(spark):
    from tidewatch.functions.text import char_ngrams

    a, b = "blue harbour shipping ltd", "blue harbour shipping limited"
    df = spark.createDataFrame([(a,), (b,), ("x",)], "t string")
    sig = [r[0] for r in df.select(er.minhash(char_ngrams(F.col("t")), 512)).collect()]
    true = len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b))
    same = np.mean([x == y for x, y in zip(sig[0], sig[1])])
    assert abs(same - true) < 0.08 and len(sig[2]) == 512


def test_edit_distance_with_swaps(spark):
    for a, b, d in [("abcd", "abdc", 1), ("", "abc", 3), ("kitten", "sitting", 3), ("ca", "abc", 2), ("same", "same", 0)]:
        assert er._transposing_distance(a, b) == d
    df = spark.createDataFrame([("abcd", "abdc"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(er.damerau_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.75, 1.0]


def test_cliques_equal_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        nodes = range(8)
        adj = {n: set() for n in nodes}
        for a, b in itertools.combinations(nodes, 2):
            if rng.random() < 0.5:
                adj[a].add(b)
                adj[b].add(a)
        full = [set(c) for k in range(1, 9) for c in itertools.combinations(nodes, k) if all(y in adj[x] for x, y in itertools.combinations(c, 2))]
        want = {frozenset(c) for c in full if not any(c < d for d in full)}
        assert set(er._cliques(adj)) == want


def test_cluster_methods(spark):
    # a chain 1-2-3, a pair 10-11, a star, copies only
    edges = [(1, 2, 0.9), (2, 3, 0.8), (10, 11, 0.85), *[(100, 100 + i, 0.9 if i == 1 else 0.85) for i in range(1, 40)]]
    people = spark.createDataFrame([(i, 2 if i in (2, 50) else 1) for i in (1, 2, 3, 10, 11, 50, 60, *range(100, 140))], "profile long, copies long")
    out = {r["profile"]: r for r in er.cluster(spark.createDataFrame(edges, "a long, b long, score double"), people).collect()}
    assert out[1]["clique"] == out[2]["clique"] and 3 not in out and 60 not in out
    assert out[2]["mean_score"] == 0.95 and out[1]["mean_score"] == 0.9 and out[1]["clique_size"] == 3
    assert out[10]["clique"] == out[11]["clique"] and out[10]["clique_size"] == 2
    assert out[50]["method"] == "copies" and out[50]["clique_size"] == 2
    # members of a star are in pairs only: the best pair is a party, the other leaves are alone
    assert out[100]["clique"] == out[101]["clique"] and not any(100 + i in out for i in range(2, 40))


def test_cliques_of_a_star_and_a_clique(spark):
    """Hubs with thousands of matches, all shared with a second hub, beside a dense group: each search holds little."""
    leaves, group = range(100, 3100), range(10, 30)
    pairs = [(1, i) for i in leaves] + [(2, i) for i in leaves] + [(1, 2)] + list(itertools.combinations(group, 2)) + [(1, i) for i in group]
    degree = __import__("collections").Counter(i for p in pairs for i in p)
    order = lambda i: (degree[i], i)
    rows = [(*sorted(p, key=order), *sorted(degree[i] for i in p), 0.9) for p in pairs]
    edges = spark.createDataFrame(rows, "x long, y long, x_degree long, y_degree long, score double")
    people = spark.createDataFrame([(i, 1) for i in [1, 2, *leaves, *group]], "profile long, copies long")
    for most_links in (500_000, 50):
        found, big = er.searches(edges, people, most_links)
        sizes = found.select(F.size("later") + F.coalesce(F.size("links"), F.lit(0)))
        assert max(r[0] for r in sizes.collect() if r[0] is not None) <= 20 + 20 * 19 // 2
        assert (big.count() > 0) == (most_links == 50)
        out = {r["profile"]: r for r in er.cluster(spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a long, b long, score double"), people, most_links).collect()}
        # the hub may prefer another of its equally good cliques
        assert {out[i]["clique_size"] for i in group} <= {20, 21} and len({out[i]["clique"] for i in group}) == 1


@pytest.mark.parametrize("most_links", [500_000, 0, 4])
def test_cluster_equals_whole_graph_search(spark, most_links):
    rng = random.Random(7)
    nodes = list(range(45))
    edges = [(a, b, round(rng.uniform(0.8, 1), 2)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.25]
    adj = {n: set() for n in nodes}
    score = {}
    for a, b, s in edges:
        adj[a].add(b)
        adj[b].add(a)
        score[a, b] = score[b, a] = s
    best = {}
    for c in er._cliques(adj):
        members = sorted(c)
        name = __import__("hashlib").sha256("|".join(map(str, members)).encode()).hexdigest()
        for m in members if len(members) > 1 else ():
            entry = (round(sum(score[m, o] for o in members if o != m) / (len(members) - 1), 6), name)
            best[m] = max(best.get(m, entry), entry)
    people = spark.createDataFrame([(n, 1) for n in nodes], "profile long, copies long")
    out = er.cluster(spark.createDataFrame(edges, "a long, b long, score double"), people, most_links).collect()
    assert {r["profile"]: (r["mean_score"], r["clique"]) for r in out}.items() <= best.items()
    sizes = __import__("collections").Counter(c for _, c in best.values())
    assert {r["profile"] for r in out} == {m for m, (_, c) in best.items() if sizes[c] > 1}


def _addresses(rng, n, letters="abcdefghijklmnopqrstuvwxyz0123456789 .,-ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(12, 30))) for _ in range(n)]


@pytest.mark.parametrize("swaps", [False, True])
def test_pairs_under_one_name_equal_all_pairs(spark, swaps):
    """The index of grams loses no pair, also of short, empty, repetitive and edited addresses."""
    rng = random.Random(11)
    base = _addresses(rng, 12, "abcd1 ")
    texts = base + ["", "a", "ab", "ba", "aaaaaaaa", "aaaaaab", "abababab", "babababa"] + _addresses(rng, 10)
    for _ in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(t))
            what = rng.random()
            if what < 0.3:
                t[i] = rng.choice("abcdxyz")
            elif what < 0.5:
                t.insert(i, rng.choice("abcdxyz"))
            elif what < 0.7 and len(t) > 2:
                del t[i]
            elif i:
                t[i - 1], t[i] = t[i], t[i - 1]
        texts.append("".join(t))
    people = spark.createDataFrame([(i, "one name", t) for i, t in enumerate(sorted(set(texts)))], "profile long, normalized_name string, AD string")
    none = spark.createDataFrame([], "text_a string, text_b string")
    got, want = ({tuple(r) for r in er.score_pairs(people, none, transpositions=swaps, few=few).collect()} for few in (10, 10_000))
    assert got == want and len(want) > 100


def test_a_common_name_costs_less_than_all_pairs(spark):
    n = 20_000
    rows = spark.createDataFrame([("name", i, a) for i, a in enumerate(_addresses(random.Random(12), n))], "k string, profile long, AD string")
    assert er.near_texts(rows, "k", "profile", "AD", 0.6).count() < 0.01 * n * n / 2


def test_packed_pages(spark):
    rows = spark.range(25).select(F.lit("a").alias("k"), F.col("id").cast("string").alias("cn"), F.lit(1).alias("c")).unionByName(
        spark.createDataFrame([("b", "x", 2)], "k string, cn string, c int")
    )
    out = ex.packed(rows, ["k"], {"cn": "cn", "c": "c"}, "j", page=10).collect()
    parsed = [(r["k"], r["part"], eval(r["j"])["data"]) for r in out]
    assert sorted(e["cn"] for k, _, d in parsed for e in d if k == "a") == sorted(str(i) for i in range(25))
    assert len([1 for k, *_ in parsed if k == "a"]) > 1
    assert [(p, d) for k, p, d in parsed if k == "b"] == [(0, [{"cn": "x", "c": 2}])]


def test_trace_bounds(spark):
    acts = spark.sql("select 'a' e, date'2024-01-01' d")
    days = ["2023-12-30", "2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01", "2024-02-02"]
    rows = spark.createDataFrame([("a", d) for d in days] + [("b", "2024-01-05")], "e string, s string").select("e", F.to_timestamp_ntz("s").alias("txn_ts"))
    for size in (1_000_000, 1):
        got = sorted(str(r["txn_ts"])[:10] for r in trace(acts, rows, "e", "d", before=1, after=1, rows_per_task=size).collect())
        assert got == days[1:5]


def test_only_heavy_months_are_split(spark):
    """The hot entity-month is dealt into parts; activities of other months are not repeated."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 100)).alias("e"), F.lit("2024-01-05").cast("timestamp_ntz").alias("txn_ts"), "id")
    heavy = relate.heavy_keys(rows.withColumn("m", F.lit(1)), ["e", "m"], 1000)
    assert [tuple(r) for r in heavy.collect()] == [("hot", 1, 4)]
    acts = rows.select("e").distinct().withColumn("d", F.lit("2024-01-01").cast("date"))
    assert trace(acts, rows, "e", "d", rows_per_task=1000).count() == 5000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = largest_task(spark, lambda: trace(acts, rows, "e", "d", rows_per_task=250).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 3000


def test_join_report_with_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    r = join_report(a, b, "k", "k", "left").first()
    assert (r["left_rows"], r["joined_rows"], r["left_unique_keys"], r["left_unmatched"], r["match_rate_left"]) == (4, 4, 2, 1, 75.0)


def largest_task(spark, run):
    """Most shuffle records that one task read while ``run`` ran."""
    store = spark.sparkContext._jsc.sc().statusStore()
    lists = spark._jvm.scala.jdk.javaapi.CollectionConverters
    stages = lambda: {s.stageId(): s for s in lists.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = set(stages())
    run()
    most = 0
    for i, s in stages().items():
        if i not in before:
            for t in lists.asJava(store.taskList(i, s.attemptId(), 100_000)):
                if t.taskMetrics().isDefined():
                    most = max(most, t.taskMetrics().get().shuffleReadMetrics().recordsRead())
    return most


@pytest.mark.parametrize("count_first", [True, False])
def test_percentile_tasks_do_not_grow(spark, count_first):
    """One group of nearly distinct values: no task reads rows in proportion to its size."""
    most = []
    for n in (100_000, 1_000_000):
        df = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7 + 1).alias("v"))
        most.append(largest_task(spark, percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}, count_first=count_first, few_groups=True).collect))
    assert most[1] < (1_000_000 / 6 if count_first else 60_000)


def test_order_key(spark):
    import struct

    rng = random.Random(8)
    doubles = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-9, 9) for _ in range(500)]
    doubles += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 4.0, 1 - 2**-53]
    doubles += [2.0**e for e in range(-1074, 1024)] + [-(2.0**e) * (1 + 2**-52) for e in range(-1022, 1024)] + [2.0**e * (1 - 2**-53) for e in range(-1000, 1024)]
    doubles = [d for d in doubles if d == d]
    rows = with_order_key(spark.createDataFrame([(d,) for d in doubles], "d double"), "d", "k").collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["d"])))[0]
        assert r["k"] == (-bits if r["d"] < 0 else bits)
    assert with_order_key(spark.createDataFrame([(float("nan"),)], "d double"), "d", "k").first()["k"] == (1 << 63) - 1


def test_percentiles_of_other_types(spark):
    rng = random.Random(4)
    rows = [(Decimal(rng.randrange(-500, 500)).scaleb(-2), rng.randrange(-9, 9), Decimal(rng.randrange(10**20)).scaleb(-3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a decimal(12,2), b int, c decimal(25,3)")
    for i, c in enumerate("abc"):
        got = percentiles(df, [], c, {"m": 0.5, "z": 1.0, "s": 0.01}, "discrete").first()
        values = sorted(r[i] for r in rows)
        assert (got["m"], got["z"], got["s"]) == (values[199], values[-1], values[3])
    assert percentiles(df.filter("false"), [], "a", {"m": 0.5}).first()["m"] is None
    assert percentiles(df.filter("false"), ["b"], "a", {"m": 0.5}).count() == 0


def test_task_helpers_travel_by_value(tmp_path):
    """Executors without this package can load the helpers."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((er._clique_rows, er._transposing_distance)))
    code = "import pickle; fs = pickle.load(open('f.pkl', 'rb')); assert len(fs) == 2"
    subprocess.run([sys.executable, "-P", "-c", code], cwd=tmp_path, check=True)


MISSED = ["382c1cbf 9334bb56", "1c4e13b1 f0221606", "1dee7ead 0cd183ea", "99241cb1 28641226", "9e7c75da d869b269", "62a70c4b d1395bb6"]


def test_lsh_pairs_near_the_threshold_are_found(spark):
    # pairs of similarity 0.80 and 0.81 that shared none of 16 bands of 4
    df = spark.createDataFrame([(x,) for t in MISSED for x in (t, f"{t}st")], "t string")
    got = {(r["text_a"], r["text_b"]) for r in er.lsh_pairs(df, "t").collect()}
    assert got == {(t, f"{t}st") for t in MISSED}


def test_entity_joins_plan_no_broadcast(spark, tmp_path):
    # small files, many rows: the planner goes by the size of the files, which says nothing about exploded or computed rows
    spark.range(2000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    accounts = ids.select("id", F.md5(F.floor(F.col("id") / 2).cast("string")).alias("normalized_name"), F.lit("x").alias("AD"))
    people = er.profiles(accounts)
    pairs = er.score_pairs(people, er.lsh_pairs(people, "normalized_name"))
    existing = people.select(F.col("profile").alias("id"), F.lit("P").alias("party"))
    for out in (pairs, er.attach_new(pairs, existing)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "_name" not in line], joins


def test_pairs_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(17)) for _ in range(150)]
    texts += [t[:i] + "x" + t[i + 1 :] for t in texts[:50] for i in (0, 8)] + [t + c for t in texts[50:100] for c in ("s", "st")] + ["", "a", "é" * 90, "é" * 91]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    verified = spark.sparkContext.accumulator(0)

    def counted(a, b, n):
        def similar(x, y):
            verified.add(1)
            g, h = ({f" {t} "[i : i + 2] for i in range(len(t) + 1)} for t in (x, y))
            return len(g & h) / len(g | h)

        return F.udf(similar, "double")(a, b)

    monkeypatch.setattr(er, "_jaccard", counted)
    # with one row per band nearly all pairs meet
    got = {(r["text_a"], r["text_b"]) for r in er.lsh_pairs(df, "t", bands=48, rows=1).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(_grams(a) & _grams(b)) >= 0.8 * len(_grams(a) | _grams(b))}
    assert got == want and len(want) >= 50
    assert verified.value < 100 * len(want)


def test_minhash_agreement_of_an_unlike_pair(spark):
    # names of similarity 0.03: nine equal components of 64 are no fault, sixty are
    from tidewatch.plans.party_queries import agreement

    rows = spark.createDataFrame([(0.030303, 9 / 64), (0.030303, 60 / 64), (1.0, 63 / 64), (0.0, 1 / 64), (1.0, 1.0), (0.0, 0.0), (0.8, 0.2)], "p double, q double")
    assert [r[0] for r in rows.select(agreement(F.col("p"), F.col("q"), F.lit(64))).collect()] == [True, False, False, False, True, True, False]


def test_minhash_signatures_move_names_only(spark):
    # grams and signatures of all names were broadcast, as the file of parts is small
    from tidewatch.plans.party_queries import minhash_signatures

    plan = minhash_signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    lines = plan.splitlines()
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and max(i for i, line in enumerate(lines) if "ArrowEvalPython" in line) < min(moved)


def test_percentiles_count_the_rows_once(spark):
    # every round made the keys of all rows again: the source was read three times
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return float(v % 97)

    df = spark.range(500).select((F.col("id") % 2).alias("g"), watched("id").alias("v"))
    got = {r["g"]: r["m"] for r in percentiles(df, ["g"], "v", {"m": 0.5}, few_groups=True).collect()}
    want = {g: float(np.median([i % 97 for i in range(500) if i % 2 == g])) for g in (0, 1)}
    assert got == want
    assert seen.value <= 1000  # the filter and the count


def test_each_name_pair_is_verified_once(spark):
    # similar names meet in many of the 48 bands; each pair was verified in all of them
    df = spark.createDataFrame([(f"{i:05d} holding company{x}",) for i in range(20) for x in ("", "s")], "t string")
    plan = er.lsh_pairs(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    verify = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    once = next(i for i, line in enumerate(lines) if "Aggregate [text_a" in line)
    assert verify < once and plan.count("ArrowEvalPython") == 1  # the step above works on what the one below gives


def test_a_batch_meets_names_that_lie_stored(spark):
    # known, repeated and new names in one batch; bands are made for the new ones only
    rows = [(i, f"{i // 3:04d} holding company{'s' * (i % 3 == 2)}", f"{i // 3:012d}{i % 3}") for i in range(60)]
    people = spark.createDataFrame(rows, "profile long, normalized_name string, AD string").withColumn("copies", F.lit(1).cast("long"))
    known = people.filter("profile % 3 = 0")
    parties = known.select(F.col("profile").alias("id"), F.concat(F.lit("P"), F.floor(F.col("profile") / 3)).alias("party"))
    state = er.Matched(known, er.name_bands(known, "normalized_name"), parties)
    got, after = er.match_batch(state, people)
    pairs = er.score_pairs(people, er.lsh_pairs(people, "normalized_name"))
    want = er.attach_all(pairs, parties)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 40
    assert after.bands.select("text").distinct().count() == 40 and after.bands.count() == 40 * er.BANDS
