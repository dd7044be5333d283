"""Nearest neighbours by largest inner product with a hash-prefix forest.

Each tree gives every vector a string of sign bits of random hyperplanes; sorted, the strings
that share a prefix are one stretch. A query starts at its longest prefixes and
ascends in all trees at once, one bit at a time, until the stretches together hold the
wanted number of candidates; these are scored exactly. Vectors are dealt into bands of similar
length, each with its own forest and its own ascent, so that short vectors never fill the quota
of long ones. Within a band they get one more component that makes their lengths equal, so that
the largest inner product is the smallest angle.

How far a query ascends follows from counts by band, tree and prefix. Stretches are spread over
blocks of a bounded number of vectors and queries, so a common vector or prefix is never one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import arrow_map, per_task, written

TREES, BITS, SEED = 24, 24, 11
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 2_000
#: The longest vector of a band is at most so many times as long as its shortest.
BAND = 1.25


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part: of the most frequent length,
    every component finite, not all zero, with an id."""
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = clean.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return clean.filter(F.size("embedding") == (sizes["size"] if sizes else 0))


def banded(vectors: DataFrame) -> DataFrame:
    """The vectors with their length, their band (0 holds the longest) and the largest length of the band."""
    largest = F.array_max(F.transform("embedding", F.abs))  # squares of the shares cannot overflow
    shares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    sized = vectors.withColumn("largest", largest).withColumn("length", F.col("largest") * F.sqrt(shares)).drop("largest")
    top = sized.agg(F.max("length").alias("m")).first()["m"] or 1.0
    cut = sized.withColumn("band", F.floor((F.log(F.lit(top)) - F.log("length")) / float(np.log(BAND))).cast("int"))
    return cut.join(F.broadcast(cut.groupBy("band").agg(F.max("length").alias("top"))), "band")  # some thousand bands at most, by the range of doubles


def hashed(vectors: DataFrame, trees: int) -> DataFrame:
    """Of banded vectors: vec_id, embedding, band, codes (one for each tree) and the codes of the same vector as a query."""

    @per_task
    def factory():
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

        def rows(cols):
            x = np.asarray(cols["embedding"].flatten(), dtype=np.float64).reshape(len(cols["vec_id"]), -1)
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng(SEED).normal(size=(d + 1, trees * BITS))
            length, top = (np.asarray(cols[c], dtype=np.float64) for c in ("length", "top"))
            extra = np.sqrt(np.maximum(1 - (length / top) ** 2, 0))[:, None]
            as_query = (x / top[:, None]) @ planes[d][:d]
            as_vector = as_query + extra * planes[d][d]
            codes = [((side > 0).reshape(len(x), trees, BITS) @ weights).tolist() for side in (as_vector, as_query)]
            return {"vec_id": cols["vec_id"], "embedding": cols["embedding"], "band": cols["band"], "codes": codes[0], "query_codes": codes[1]}

        return rows

    return arrow_map(vectors, factory, "vec_id long, embedding array<double>, band int, codes array<long>, query_codes array<long>")


def levels(index: DataFrame, queries: DataFrame, share: float, least: int, depth: int, trees: int) -> DataFrame:
    """query_id, band, level: the longest prefix (at most ``depth`` bits) at which all trees of the band
    together hold the wanted number of candidates: ``share`` of its rows, or ``least`` rows in every tree.
    Level 0, the whole band, where that many entries would be four times its rows."""
    n = F.count(F.lit(1))
    wanted = F.greatest(F.floor(F.col("rows") * share), F.least("rows", F.lit(least)) * trees)
    bands = F.broadcast(index.groupBy("band").agg(n.alias("rows")).withColumn("wanted", wanted))
    deep = index.select("band", F.posexplode("codes").alias("tree", "code")).groupBy("band", "tree", F.shiftright("code", BITS - depth).alias("prefix")).agg(n.alias("n"))
    every = F.explode(F.sequence(F.lit(1), F.lit(depth)))
    counts = deep.withColumn("level", every).groupBy("band", "tree", "level", F.expr(f"shiftright(prefix, {depth} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
    asked = queries.select("query_id", F.posexplode("query_codes").alias("tree", "code")).withColumn("level", every)
    asked = asked.select("query_id", "tree", "level", F.expr(f"shiftright(code, {BITS} - level)").alias("prefix"))
    some = counts.join(bands.filter("wanted < 4 * rows"), "band")
    held = asked.join(some, ["tree", "level", "prefix"]).groupBy("query_id", "band", "level").agg(F.sum("n").alias("n"), F.first("wanted").alias("wanted"))
    found = held.filter(F.col("n") >= F.col("wanted")).groupBy("query_id", "band").agg(F.max("level").alias("level"))
    whole = queries.select("query_id").crossJoin(bands.select("band"))
    return whole.join(found, ["query_id", "band"], "left").select("query_id", "band", F.coalesce("level", F.lit(0)).alias("level"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, share: float = 0.6, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Candidates are all other rows; ``share`` is how many entries of the trees a query collects in each band
    of lengths, as a share of its rows (an entry may be found in several trees). Scores are inner
    products in double precision; ties go to the smaller id. NULL, zero and non-finite vectors, and
    vectors of another length than most, take no part; rows that repeat an id are one vector (one of them).
    """
    index = written(hashed(banded(usable(vectors)).dropDuplicates(["vec_id"]), trees))
    depth = min(BITS, max(1, int(np.ceil(np.log2(trees / share))) + 6))
    queries = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "query_codes")
    # with few rows everything is a candidate
    climbs = written(levels(index, queries, share, 50 * k, depth, trees))
    roots = F.broadcast(climbs.groupBy("band").agg(F.min("level").alias("root")))

    def shard():
        return F.expr(f"shiftright(code, {BITS} - root)").alias("shard")

    entries = index.select("vec_id", "embedding", "band", F.posexplode("codes").alias("tree", "code")).join(roots, "band")
    entries = entries.select("vec_id", "embedding", "band", "tree", "code", shard())
    wants = climbs.join(roots, "band").join(queries, "query_id").select("query_id", "query", "band", "level", "root", F.posexplode("query_codes").alias("tree", "code"))
    # every tree holds the whole band
    wants = wants.filter("level > 0 OR tree = 0").select("query_id", "query", "band", "tree", "code", "level", shard())
    sizes = index.select("band", F.posexplode("codes").alias("tree", "code")).join(roots, "band").groupBy("band", "tree", shard()).agg(F.count(F.lit(1)).alias("vectors"))
    asks = wants.groupBy("band", "tree", "shard").agg(F.count(F.lit(1)).alias("queries"))
    place = ["band", "tree", "shard"]
    grid = sizes.join(asks, place).select(
        *place, F.ceil(F.col("vectors") / BLOCK_VECTORS).alias("rows"), F.ceil(F.col("queries") / BLOCK_QUERIES).alias("columns")
    )
    key = [*place, "row", "column"]
    blocks = entries.join(grid, place).select(
        "vec_id", "embedding", "code", *place, F.pmod(F.xxhash64("vec_id"), "rows").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("column")
    )
    asking = wants.join(grid, place).select(
        "query_id", "query", "code", "level", *place, F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), F.pmod(F.xxhash64("query_id"), "columns").alias("column")
    )

    def search(left, right):
        import pyarrow as pa

        ids = np.asarray(left["vec_id"].combine_chunks())
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(ids) and len(right):
            x = np.asarray(left["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
            q = np.asarray(right["query"].combine_chunks().flatten(), dtype=np.float64).reshape(len(right), -1)
            code = np.asarray(left["code"].combine_chunks())
            order = np.lexsort((ids, code))
            ids, x, code = ids[order], x[order], code[order]
            names, own, level = (np.asarray(right[c].combine_chunks()) for c in ("query_id", "code", "level"))
            free = BITS - level
            low = np.searchsorted(code, (own >> free) << free)
            high = np.searchsorted(code, ((own >> free) + 1) << free)
            for i in range(len(names)):
                a, z = low[i], high[i]
                if a == z:
                    continue
                score = np.einsum("ij,j->i", x[a:z], q[i])
                part = ids[a:z]
                keep = part != names[i]
                score, part = score[keep], part[keep]
                if len(part) > k:
                    edge = np.partition(-score, k - 1)[k - 1]
                    some = np.flatnonzero(-score <= edge)
                    score, part = score[some], part[some]
                best = np.lexsort((part, -score))[:k]
                found["query_id"].append(np.full(len(best), names[i]))
                found["vec_id"].append(part[best])
                found["score"].append(score[best])
        none = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, none[c]) for c, v in found.items()})

    hits = blocks.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    distinct = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return distinct.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
