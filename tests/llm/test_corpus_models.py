"""Whitening, codes of vectors and the quality machine against brute force and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import codes, quality, whitening
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def vectors_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    return rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=np.float64), rows["label"].tolist()


def brute_codes(ids, x, labels, parts=8, entries=16, rounds=6):
    """``x`` holds integers; rows are (id, vector, label)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))
    x = x[order]
    width = -(-x.shape[1] // parts)
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def nearest(p):
        d = ((cut[p][:, None] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            own, _ = nearest(p)
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p][e] = cut[p][own == e].sum(axis=0) // (own == e).sum()
    got = [nearest(p) for p in range(parts)]
    error = sum(d for _, d in got)
    by_label = Counter()
    for i, e in zip(order, error):
        by_label[labels[i]] += int(e)
    text = ",".join(str(c) for b in books for e in b.tolist() for c in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    code = ["".join(f"{got[p][0][i]:02x}" for p in range(parts)) for i in range(len(x))]
    return sorted(((ids[i], c, int(e), by_label[labels[i]], sha) for i, c, e in zip(order, code, error)), key=str)


def test_codes(spark):
    ids, v, labels = vectors_of(spark, SF)
    got = QUERIES["op13_vector_codes"](spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = brute_codes(ids.tolist(), np.floor(4096 * v).astype(np.int64), labels)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("kind", ["clustered", "equal", "steps"])
def test_balls(kind):
    """Sums and assignments over the tree equal those over the points, also with ties and copies."""
    rng = np.random.default_rng(5)
    if kind == "clustered":
        points = (rng.integers(-9, 9, (12, 6)) * 1000)[rng.integers(12, size=3000)] + rng.integers(-40, 40, (3000, 6))
    elif kind == "equal":
        points = np.full((500, 6), 7)
    else:
        points = rng.integers(-2, 3, (2000, 6))
    balls = codes.tree(points)
    assert (points[balls["order"]] == balls["points"]).all()
    for low, high, centre, radius, total in zip(*[balls[k] for k in ("low", "high", "centre", "radius", "sums")]):
        inside = balls["points"][low:high]
        assert (inside.sum(axis=0) == total).all()
        assert codes.squared(inside, centre).max() <= radius**2
    for entries in (points[:16].copy(), np.concatenate([points[:4], points[:4]]), points[:1]):
        away = codes.squared(points[:, None], entries[None])
        own, error = codes.assigned(balls, entries)
        assert (own == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
        sums = codes.sums_by_entry(balls, entries)
        for e in range(len(entries)):
            assert sums[e, 0] == (own == e).sum() and (sums[e, 1:] == points[own == e].sum(axis=0)).all()
    if kind == "clustered":
        seen = sum(len(at) for what, at, _ in codes.owners(balls, points[:16]) if what == "points")
        assert seen < len(points) / 2  # most points lie in balls that one entry owns


ODD = [
    (0, [0.5, -0.25, 1.0], 1, "x"), (1, [0.5, 0.75, -1.0], None, "x"), (2, None, 1, "x"), (3, [float("nan"), 0.0, 0.0], 1, "x"),
    (4, [0.0, None, 0.0], 1, "x"), (5, [float("-inf"), 0.0, 0.0], 1, "x"), (6, [1.0], 1, "x"), (7, [], 1, "x"),
    (1, [0.5, 0.75, -1.0], None, "x"), (1, [0.1, 0.2, 0.3], 2, "x"), (None, [0.0, 0.0, 1e-4], 2, "x"), (9, [-1.0, 0.0, 0.0], 1, "x"),
]
KEPT = [r for r in ODD if r[1] is not None and len(r[1]) == 3 and all(c is not None and np.isfinite(c) for c in r[1])]


def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int, error string")


def test_codes_odd(spark):
    x = np.floor(4096 * np.array([r[1] for r in KEPT], dtype=np.float32).astype(np.float64)).astype(np.int64)
    want = brute_codes([r[0] for r in KEPT], x, [r[2] for r in KEPT])
    for few in (50_000, 0):
        got, books = codes.compress(odd(spark), few_labels=few)
        assert sorted(map(tuple, got.drop("label").collect()), key=str) == want
    assert [b.shape for b in books] == [(6, 1)] * 3 + [(6, 0)] * 5
    assert codes.compress(odd(spark).limit(0))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.compress(odd(spark).selectExpr("vec_id", "array(1e9D) AS embedding", "label"))


def test_blocks(spark, monkeypatch):
    """Blocks of a few rows give the same codes."""
    monkeypatch.setattr(codes, "BLOCK", 64 * 7)
    ids, v, labels = vectors_of(spark, "/root/testdata/sf0.001")
    got = codes.compress(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))[0].drop("label")
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(ids.tolist(), np.floor(4096 * v).astype(np.int64), labels)


def check_whitened(got, ids, v, components):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    components = min(components, v.shape[1])
    assert len(got) == n * components
    deviation = Counter((i, int(d)) for i, d in zip(ids, ((n * x - total) ** 2).sum(axis=1)) for _ in range(components))
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == deviation
    for k in range(components):
        mine = [r for r in got if r["component"] == k + 1]
        assert {r["n"] for r in mine} == {n}
        assert all(r["explained"] == pytest.approx(max(0, e[k]) / e.sum(), rel=1e-9, abs=1e-12) for r in mine)
        if e[k] <= 1e-12 * e[0]:
            assert all(r["whitened"] is None for r in mine)
            continue
        found = sorted((r["deviation"], round(r["whitened"], 6)) for r in mine)
        want = (y @ w[:, k] / np.sqrt(e[k])).tolist()
        both = [sorted((int(d), round(s * z, 6)) for d, z in zip(((n * x - total) ** 2).sum(axis=1), want)) for s in (1, -1)]
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(found, sign)) for sign in both)


def test_whitening(spark):
    ids, v, _ = vectors_of(spark, SF)
    df = QUERIES["op11_whitened_vectors"](spark, SF)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = df.collect()
    check_whitened(got, ids.tolist(), v, 32)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_odd(spark):
    v = np.array([r[1] for r in KEPT], dtype=np.float32).astype(np.float64)
    got = whitening.whiten(odd(spark)).collect()
    check_whitened(got, [r[0] for r in KEPT], v, 32)
    assert whitening.whiten(odd(spark).limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(0, None, None, None)}
    line = spark.createDataFrame([(i, [i / 8, i / 4]) for i in range(40)], "vec_id long, embedding array<double>")
    check_whitened(whitening.whiten(line).collect(), list(range(40)), np.array([[i / 8, i / 4] for i in range(40)]), 32)


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(0, 0, 1, [2 * 10**9, 5]), (0, 1, 2, [0, 5])], "slot int, at long, vec_id long, x array<long>")
    got = {r["vec_id"]: (r["deviation"], r["y"]) for r in whitening.centred(rows, 4, [2 * 10**9, 20]).collect()}
    assert got == {1: (None, [1.5e9, 0.0]), 2: (4 * 10**18, [-5e8, 0.0])}


# ---- quality --------------------------------------------------------------------


def test_pairs_by_sums_of_squares():
    """The linear-time score equals the sum over all pairs of features."""
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    rows = [(rng.permutation(50)[:k], rng.normal(size=k)) for k in (1, 7, 30)]
    size = np.array([len(a) for a, _ in rows])
    got = m.raw(*[np.concatenate([r[i] for r in rows]) for i in (0, 1)], np.cumsum(size) - size)
    for (a, x), g in zip(rows, got):
        pairs = sum(m.factors[a[i]] @ m.factors[a[j]] * x[i] * x[j] for i in range(len(a)) for j in range(i))
        assert g == pytest.approx(0.3 + m.linear[a] @ x + pairs)


def test_fit_learns_an_interaction():
    """Neither feature alone tells the label, both together do."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(2, size=(2, 800))
    rows = [(np.array([2000 + i, 3000 + j]), np.ones(2)) for i, j in zip(a, b)]
    m = quality.fit(rows, (a == b).astype(float), np.ones(800), rounds=40)
    p = quality.chance(m.raw(np.concatenate([r[0] for r in rows]), np.ones(1600), np.arange(0, 1600, 2)))
    assert ((p > 0.5) == (a == b)).mean() > 0.98


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_quality"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and labels.get(i) is not None]
    for q in (0, 1):
        assert np.mean([p == q for want, p in held if want == q]) > 0.95


def test_quality_labels_of_held_out_rows_do_not_teach(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and more {'!!!' * (i % 2)}", 9) for i in range(200)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    spoilt = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (sorted(map(tuple, quality.judge(docs, x).collect())) for x in (labels, spoilt))
    assert a == b


def test_quality_odd(spark):
    rows = [(1, None, None, "u"), (2, "", 0, "u"), (None, "a b", 3, "u"), (4, "x" * 300_000, 7, "u"), (4, "w " * 100_000, None, "u"), (5, "Fine text here.", 15, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, None), (None, 1), (4, 7), (77, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in got if r["doc_id"] == 1] == [r["score"] for r in quality.judge(docs.drop("n_chars"), labels).collect() if r["doc_id"] == 1]
    assert quality.judge(docs.limit(0), labels).count() == 0
    some = quality.judge(docs, spark.createDataFrame([(5, 1), (4, 0), (4, 0)], "doc_id long, quality int")).count()
    assert some == len(rows)
