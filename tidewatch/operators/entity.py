"""Entity resolution: accounts that belong to one party.

The order is: collapse exact copies, MinHash bands over distinct names, pairs
inside a band bucket verified by Jaccard similarity, field scores, components,
cliques. Copies never meet each other in a pair, and a bucket too large for one
task is cut into cells that each compare two blocks of it.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.text import char_ngrams
from tidewatch.operators.explain import packed
from tidewatch.session import cut_lineage, shuffled

# The task-side helpers below travel with their tasks, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Defaults of the resolution.
NGRAM = 2
PERMUTATIONS = 64
BANDS, BAND_ROWS = 48, 5
JACCARD = 0.8
WEIGHTS = {"normalized_name": 0.5, "AD": 0.5}
MATCH = 0.8
AUTO_CONFIRM_FROM = 0.8
# States of a match.
CANDIDATE, MANUAL_CONFIRM, MANUAL_REJECT, AUTO_CONFIRM = 0, 1, 2, 3


def normalise(df: DataFrame, id: str, name: str, address: str, country: str | None = None, effective: str | None = None) -> DataFrame:
    """Graph field names, and the lower-cased name that is matched."""
    return df.select(
        F.col(id).alias("id"),
        F.col(name).alias("NM"),
        F.col(address).alias("AD"),
        F.lower(name).alias("normalized_name"),
        (F.col(country) if country else F.lit(None).cast("string")).alias("CT"),
        (F.col(effective) if effective else F.lit(None).cast("timestamp")).alias("effective_date"),
    )


def profiles(accounts: DataFrame) -> DataFrame:
    """Distinct (name, address) pairs: smallest id as profile, number of copies."""
    return (
        accounts.filter(F.col("normalized_name").isNotNull() & F.col("AD").isNotNull())
        .groupBy("normalized_name", "AD")
        .agg(F.min("id").alias("profile"), F.count(F.lit(1)).alias("copies"))
    )


# --- MinHash bands -----------------------------------------------------------


def _signatures(hashes: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have hashes, and their MinHash signatures: for each of ``k`` seeds the smallest mixed hash."""
    kept = np.array([h is not None and len(h) > 0 for h in hashes], bool)
    rows = [np.asarray(h, np.int64) for h, has in zip(hashes, kept) if has]
    out = np.empty((len(rows), k), np.uint64)
    if rows:
        flat = np.concatenate(rows).view(np.uint64)
        starts = np.cumsum([0, *[len(r) for r in rows[:-1]]])
        seeds = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, k, np.uint64)
        for i, seed in enumerate(seeds):
            mixed = (flat ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            out[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
    return kept, out.view(np.int64)


def _listed(kept: np.ndarray, values: np.ndarray) -> pd.Series:
    found = iter(values)
    return pd.Series([next(found) if has else None for has in kept], dtype=object)


def minhash(grams: Column, k: int = PERMUTATIONS) -> Column:
    """MinHash signature of an array of grams, as array<bigint>: the smallest of the
    grams' hashes for each of ``k`` seeds. NULL for an empty or NULL array."""

    @F.pandas_udf("array<bigint>")
    def signature(hashes: pd.Series) -> pd.Series:
        return _listed(*_signatures(hashes, k))

    return signature(F.transform(grams, lambda g: F.xxhash64(g)))


def band_keys(hashes: Column, bands: int, rows: int) -> Column:
    """One hash per band of the signature of the grams' hashes; NULL where there is none."""

    @F.pandas_udf("array<bigint>")
    def keys(hashes: pd.Series) -> pd.Series:
        kept, signature = _signatures(hashes, bands * rows)
        out = np.zeros((len(signature), bands), np.uint64)
        for part in range(rows):
            out = (out ^ signature[:, part::rows].view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(29)
        return _listed(kept, out.view(np.int64))

    return keys(hashes)


def _cells(df: DataFrame, key: Sequence[str], order: str, block_size: int) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of a self-join whose large groups are cut into cells.

    A group of n rows has B = ceil(n / block_size) blocks; every unordered pair
    of rows meets in exactly one cell (i, j) with i <= j, and a cell holds at
    most two blocks. Groups of one row are dropped, nothing else.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block_size).cast("int")
    rows = df.join(shuffled(sizes), list(key)).withColumn("_b", blocks).withColumn(
        "_i", F.pmod(F.xxhash64(F.lit(11), order), F.col("_b")).cast("int")
    ).drop("_n")
    left = rows.withColumn("_j", F.explode(F.sequence("_i", F.col("_b") - 1))).drop("_b")
    right = rows.withColumnRenamed("_i", "_jj").withColumn("_ii", F.explode(F.sequence(F.lit(0), F.col("_jj")))).drop("_b")
    right = right.select(*key, F.col("_ii").alias("_i"), F.col("_jj").alias("_j"), *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in key])
    return left, right


def _jaccard(a: Column, b: Column, n: int) -> Column:
    """Jaccard similarity of two texts' grams (``char_ngrams``); as a Python helper it makes them once per pair."""

    @F.pandas_udf(T.DoubleType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        made: dict[str, frozenset] = {}

        def grams(t: str) -> frozenset:
            if t not in made:
                padded = f" {t} "
                made[t] = frozenset(padded[i : i + n] for i in range(max(len(padded) - n + 1, 1)))
            return made[t]

        out = []
        for x, y in zip(a, b):
            g, h = grams(x), grams(y)
            shared = len(g & h)
            out.append(shared / (len(g) + len(h) - shared))
        return pd.Series(out, dtype=float)

    # else a filter on the result moves below the step that leaves each pair once
    return similar.asNondeterministic()(a, b)


def _gram_bits(hashes: Column) -> Column:
    """A long with one bit set for each gram, by the last six bits of its hash."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(bit(h)))


def _may_pass(threshold: float) -> Column:
    """False only for pairs below the threshold: at a Jaccard similarity t two sets of m and n grams differ in
    (m + n) * (1 - t) / (1 + t) grams, and every bit in which they differ takes a gram that only one has."""
    most = (F.col("grams") + F.col("grams_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9
    return F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b"))) <= most


def name_bands(texts: DataFrame, text: str, n: int = NGRAM, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(text, bits, grams, band, key): the band table of the distinct texts, one row per band.

    The table can be stored: texts of a later batch meet it by (band, key), see ``new_name_pairs``.
    Signatures are made once, for all that read the table, and kept as one row per text. ``bits`` and
    ``grams``, the number of grams, tell most pairs that meet by chance without a look at the texts.
    """
    distinct = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    hashes = F.transform(char_ngrams(F.col("text"), n), lambda g: F.xxhash64(g))
    keyed = cut_lineage(distinct.select("text", _gram_bits(hashes).alias("bits"), F.size(hashes).alias("grams"), band_keys(hashes, bands, rows).alias("keys")))
    return keyed.select("text", "bits", "grams", F.posexplode("keys").alias("band", "key"))


def _verified_names(met: DataFrame, threshold: float, n: int = NGRAM) -> DataFrame:
    """(text_a, text_b, jaccard) of the pairs (text, text_b) that pass; a pair that met in several bands is verified once."""
    pairs = met.filter(_may_pass(threshold)).select(F.least("text", "text_b").alias("text_a"), F.greatest("text", "text_b").alias("text_b")).distinct()
    pairs = pairs.withColumn("jaccard", _jaccard(F.col("text_a"), F.col("text_b"), n)).filter(F.col("jaccard") >= threshold)
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


#: What is known of two texts that met.
_MET = ("text", "bits", "grams", "text_b", "bits_b", "grams_b")


def _second(banded: DataFrame) -> DataFrame:
    """A band table as the other side of a join."""
    return banded.select("band", "key", *[F.col(c).alias(f"{c}_b") for c in _MET[:3]])


def _bucket_pairs(banded: DataFrame, block_size: int) -> DataFrame:
    left, right = _cells(banded, ["band", "key"], "text", block_size)
    return left.join(shuffled(right), ["band", "key", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("text") < F.col("text_b")))


def lsh_pairs(
    texts: DataFrame,
    text: str,
    threshold: float = JACCARD,
    n: int = NGRAM,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    block_size: int = 2000,
) -> DataFrame:
    """(text_a, text_b, jaccard) of distinct texts that share a band and pass.

    ``texts`` is reduced to distinct values first. Where a pair meets, its gram bits drop it unless it may
    pass; only what is left is moved, to verify each pair once. A pair at the
    default threshold shares none of the default bands with probability 5e-9.
    """
    return _verified_names(_bucket_pairs(name_bands(texts, text, n, bands, rows), block_size), threshold, n)


def new_name_pairs(fresh: DataFrame, stored: DataFrame, threshold: float = JACCARD, block_size: int = 2000) -> DataFrame:
    """The pairs of ``lsh_pairs`` in which at least one text is new, from two band tables (``name_bands``).

    New texts meet the stored ones of their buckets and each other; stored texts do not meet
    again. Texts that are stored already are not new.
    """
    return _pairs_with_new(fresh.join(shuffled(stored.select("text").distinct()), "text", "left_anti"), stored, threshold, block_size)


def _pairs_with_new(fresh: DataFrame, stored: DataFrame, threshold: float, block_size: int) -> DataFrame:
    """``new_name_pairs`` of texts that are all new."""
    met = fresh.join(shuffled(_second(stored)), ["band", "key"]).select(*_MET).unionByName(_bucket_pairs(fresh, block_size).select(*_MET))
    return _verified_names(met, threshold)


# --- pair scores -------------------------------------------------------------


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b), longest))


def _transposing_distance(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours is one edit, also if more is edited
    between them: a matrix over the texts' prefixes that remembers where each letter stood last."""
    n, m = len(a), len(b)
    far = n + m
    cost = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        cost[i + 1][1] = i
    for j in range(m + 1):
        cost[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i in range(1, n + 1):
        column = 0  # where this row's letter stood last in b
        for j in range(1, m + 1):
            k, last = row_of.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            if same:
                column = j
            swapped = cost[k][last] + (i - k - 1) + 1 + (j - last - 1)
            cost[i + 1][j + 1] = min(cost[i][j] + (not same), cost[i + 1][j] + 1, cost[i][j + 1] + 1, swapped)
        row_of[a[i - 1]] = i
    return cost[n + 1][m + 1]


def damerau_similarity(a: Column, b: Column) -> Column:
    """Like ``similarity`` but counting transpositions; a Python helper per pair."""

    @F.pandas_udf(T.DoubleType())
    def dist(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(_transposing_distance(p, q)) for p, q in zip(x, y)])

    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(dist(a, b), longest))


#: Profiles of one name that are compared all with all; larger names go through an index of grams.
FEW_PROFILES = 256
#: Grams known as common, so that an index prefers the others.
COMMON_GRAMS = 1000


def _pair_keys(tokens: Column) -> Column:
    """One hash for each pair of tokens."""
    following = lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))
    return F.flatten(F.transform(tokens, following))


def near_texts(rows: DataFrame, key: str, id: str, text: str, least: float, lost: int = 2, block_size: int = 2000) -> DataFrame:
    """(id, id_b): under each key, the pairs of rows whose texts can have a similarity of ``least`` or more.

    A text r with d distinct two-letter grams keeps at least d - ``lost`` * k of them after k edits, and
    k is at most (1 - least) times the longer text. So the longer text shares a pair of grams with the
    shorter one, and one even among its first ``lost`` * k + 2 grams, in an order that puts common grams
    last. Pairs meet by the hash of two grams; where only one gram must be shared, by that
    one; texts of which none must be shared (very short or repetitive ones) are compared with
    all that are not longer, in blocks. No pair is lost.
    """
    size = F.length(text)
    grams = rows.select(F.col(key).alias("_key"), F.col(id).alias("_id"), size.alias("_len"), char_ngrams(F.col(text), 2).alias("_grams")).filter(F.col("_len").isNotNull())
    each = grams.select("_key", "_id", "_len", F.explode("_grams").alias("_g")).select("_key", "_id", "_len", F.xxhash64("_g").alias("_g"))
    common = each.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_g").limit(COMMON_GRAMS)
    ranked = each.join(F.broadcast(common), "_g", "left").groupBy("_key", "_id", "_len").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g")))).alias("_order")
    )
    edits = F.floor(F.col("_len") * F.lit(1 - least) + 1e-6)
    texts = cut_lineage(
        ranked.select("_key", "_id", "_len", F.transform("_order", lambda e: e["g"]).alias("_t"), (F.lit(lost) * edits).cast("int").alias("_gone"))
        .withColumn("_must", F.size("_t") - F.col("_gone"))
    )
    long_ = lambda d, keys: d.select("_key", F.explode(keys).alias("_h"), F.col("_id").alias("r"), F.col("_len").alias("r_len"))
    short = lambda keys: texts.select("_key", F.explode(keys).alias("_h"), F.col("_id").alias("t"), F.col("_len").alias("t_len"))
    first = lambda n: F.slice("_t", F.lit(1), F.col("_gone") + n)
    two = long_(texts.filter("_must >= 2"), _pair_keys(first(2))).join(short(_pair_keys(F.col("_t"))), ["_key", "_h"])
    one = long_(texts.filter("_must = 1"), first(1)).join(short(F.col("_t")), ["_key", "_h"])
    # no gram must be shared: every block of the key's texts
    free = texts.filter("_must < 1")
    blocks = texts.join(free.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("_b"))
    every = free.join(blocks, "_key").select("_key", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_h"), F.col("_id").alias("r"), F.col("_len").alias("r_len"))
    dealt = texts.join(blocks, "_key").select("_key", F.pmod(F.xxhash64("_id"), F.col("_b")).cast("int").alias("_h"), F.col("_id").alias("t"), F.col("_len").alias("t_len"))
    zero = every.join(dealt, ["_key", "_h"])
    out = None
    for met in (two, one, zero):
        fits = (F.col("t_len") >= F.col("r_len") * least - 1e-6) & ((F.col("t_len") < F.col("r_len")) | ((F.col("t_len") == F.col("r_len")) & (F.col("t") < F.col("r"))))
        met = met.filter(fits).select(F.least("r", "t").alias(id), F.greatest("r", "t").alias(f"{id}_b"))
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def _with_fresh(keyed: DataFrame, fresh: DataFrame, block_size: int) -> DataFrame:
    """Pairs of profiles under one ``_name`` with at least one new profile; a name's profiles are cut into blocks,
    and each new one visits them all."""
    rows = keyed.join(shuffled(fresh.select("profile", F.lit(True).alias("_new")).distinct()), "profile", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    sizes = rows.groupBy("_name").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("_b"), F.max("_new").alias("_any")).filter("_any").select("_name", "_b")
    rows = rows.join(shuffled(sizes), "_name")
    left = rows.filter("_new").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_b", "_new")
    right = rows.withColumn("_i", F.pmod(F.xxhash64(F.lit(11), "profile"), F.col("_b")).cast("int"))
    right = right.select("_name", "_i", *[F.col(c).alias(f"{c}_b") for c in keyed.columns if c != "_name"], F.col("_new").alias("_new_b"))
    once = (~F.col("_new_b") & (F.col("profile") != F.col("profile_b"))) | (F.col("profile") < F.col("profile_b"))
    return left.join(shuffled(right), ["_name", "_i"]).filter(once)


def score_pairs(
    people: DataFrame,
    name_pairs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    threshold: float = MATCH,
    block_size: int = 2000,
    transpositions: bool = False,
    few: int = FEW_PROFILES,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """(a, b, score) of profiles whose weighted field similarity reaches the threshold.

    Profiles meet when their names are equal or form a name pair. Under a name with more than
    ``few`` profiles they meet by the field with the most weight besides the name: if all other
    fields were equal it would still need a certain similarity, which ``near_texts`` finds
    by shared grams. The score is part of the join, so only matches leave it. With ``fresh``, a
    table of profiles, only pairs with at least one of them are made.
    """
    fields = list(weights)
    cols = ["profile", *fields]
    p = cut_lineage(people.select(*cols))
    other = p.select(*[F.col(c).alias(f"{c}_b") for c in cols])
    wanted = [*cols, *[f"{c}_b" for c in cols]]

    # same name: self-join in cells, or by an index where the name has many profiles
    keyed = p.withColumn("_name", F.col("normalized_name"))
    field = max((f for f in fields if f != "normalized_name"), key=lambda f: weights[f], default=None)
    least = (threshold - (sum(weights.values()) - weights[field])) / weights[field] if field else 0.0
    indexed = None
    if fresh is not None:
        indexed = _with_fresh(keyed, fresh, block_size).select(*wanted)
        keyed = None
    elif least > 0:
        many = keyed.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select("_name")
        large = cut_lineage(keyed.join(many, "_name", "left_semi"))
        if not large.isEmpty():
            met = near_texts(large, "_name", "profile", field, least, 3 if transpositions else 2, block_size)
            indexed = met.join(shuffled(large.select(*cols)), "profile").join(shuffled(large.select(*[F.col(c).alias(f"{c}_b") for c in cols])), "profile_b").select(*wanted)
            keyed = keyed.join(many, "_name", "left_anti")
    same = indexed
    if keyed is not None:
        left, right = _cells(keyed, ["_name"], "profile", block_size)
        same = left.join(shuffled(right), ["_name", "_i", "_j"]).filter(
            (F.col("_i") < F.col("_j")) | (F.col("profile") < F.col("profile_b"))
        ).select(*wanted)
        same = same.unionByName(indexed) if indexed is not None else same
    # different names: through the name pairs
    near = (
        p.join(shuffled(name_pairs.select(F.col("text_a").alias("normalized_name"), F.col("text_b").alias("_other"))), "normalized_name")
        .join(shuffled(other), F.col("_other") == F.col("normalized_name_b"))
    )
    near = near.select(*wanted)
    if fresh is not None:
        # name pairs hold a new name, but not only new profiles
        new = shuffled(fresh.select("profile").distinct())
        one = near.join(new, "profile", "left_semi")
        near = one.unionByName(near.join(new, "profile", "left_anti").join(shuffled(new.withColumnRenamed("profile", "profile_b")), "profile_b", "left_semi").select(*wanted))
    met = same.unionByName(near)

    def total(measure) -> Column:
        return sum((F.lit(w) * measure(F.col(f), F.col(f"{f}_b")) for f, w in weights.items()), F.lit(0.0))

    # edits are at least the difference in length: a cheap bound that loses nothing
    def bound(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.coalesce(F.try_divide(F.least(F.length(x), F.length(y)), longest), F.lit(1.0))

    met = met.filter(total(bound) >= threshold - 1e-6)
    if transpositions:
        # a swap counts as two plain edits, which bounds what it can gain
        def ceiling(x: Column, y: Column) -> Column:
            return 1 - (1 - similarity(x, y)) / 2

        met = met.filter(F.round(total(ceiling), 6) >= threshold).withColumn("score", F.round(total(damerau_similarity), 6))
    else:
        met = met.withColumn("score", F.round(total(similarity), 6))
    return met.filter(F.col("score") >= threshold).select(
        F.least("profile", "profile_b").alias("a"), F.greatest("profile", "profile_b").alias("b"), "score"
    )


def damerau_pairs(people: DataFrame, name_pairs: DataFrame, **kw) -> DataFrame:
    return score_pairs(people, name_pairs, transpositions=True, **kw)


# --- parties -----------------------------------------------------------------


def _cliques(neighbours: dict, root: frozenset = frozenset()) -> list[frozenset]:
    """Maximal cliques (Bron-Kerbosch with pivoting) of a graph, each with ``root`` added."""
    found: list[frozenset] = []
    stack = [(root, set(neighbours), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            found.append(r)
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda u: len(neighbours[u] & p))
        for v in sorted(p - neighbours[pivot]):
            stack.append((r | {v}, p & neighbours[v], x & neighbours[v]))
            p = p - {v}
            x = x | {v}
    return found


def _cliques_from(begin: tuple, copies_begin: tuple, score_begin: float, later: Iterable[Mapping], links: Iterable[Mapping]) -> list[tuple]:
    """(profile, clique, mean score, root, second, size) for the cliques that begin with the one or two profiles
    of ``begin`` and go on among ``later``, profiles after them that match all of them; maximal among those."""
    score, copies, neighbours, rank = {}, dict(zip(begin, copies_begin)), {}, {}
    if len(begin) == 2:
        score[begin] = score[begin[::-1]] = score_begin
    for e in later:
        p = e["profile"]
        for b, s in zip(begin, (e["score"], e["second_score"])):
            score[b, p] = score[p, b] = s
        copies[p], rank[p] = e["copies"], (e["degree"], p)
        neighbours[p] = set()
    for e in links:
        a, b = e["a"], e["b"]
        score[a, b] = score[b, a] = e["score"]
        neighbours[a].add(b)
        neighbours[b].add(a)
    rows = []
    for clique in _cliques(neighbours, frozenset(begin)):
        members = sorted(clique)
        size = sum(copies[m] for m in members)
        name = hashlib.sha256("|".join(map(str, members)).encode()).hexdigest()
        second = begin[1] if len(begin) == 2 else min((m for m in members if m not in begin), key=rank.get)
        for m in members:
            total = (copies[m] - 1) + sum(copies[o] * score[m, o] for o in members if o != m)
            rows.append((m, name, round(total / (size - 1), 6), begin[0], second, len(members)))
    return rows


def _clique_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["profile", "clique", "mean_score", "root", "second", "size"]
    for pdf in batches:
        rows = []
        for v in pdf.itertuples():
            begin = (v.root, v.second) if v.split else (v.root,)
            later, links = (x if x is not None else () for x in (v.later, v.links))
            rows += _cliques_from(begin, (v.copies, v.second_copies)[: len(begin)], v.score, later, links)
        yield pd.DataFrame(rows, columns=names)


#: Matches among one profile's later neighbours that one search takes at once.
MOST_LINKS = 500_000


def _named(edges: DataFrame, x: str, y: str, score: str, *more: Column) -> DataFrame:
    return edges.select(F.col("x").alias(x), F.col("y").alias(y), F.col("score").alias(score), *more)


def _triangles(edges: DataFrame) -> DataFrame:
    """x before y before z: an edge between two later neighbours of x."""
    both = _named(edges, "x", "y", "xy").join(shuffled(_named(edges, "x", "z", "xz", F.col("y_degree").alias("z_degree"))), "x")
    return both.join(shuffled(_named(edges, "y", "z", "yz")), ["y", "z"])


def searches(edges: DataFrame, copies: DataFrame, most_links: int = MOST_LINKS) -> tuple[DataFrame, DataFrame]:
    """One row per clique search, and the roots whose searches are split.

    A search goes from a root over its ``later`` neighbours with the ``links`` between
    them, or from a root and a ``second`` over their common later neighbours.
    """
    later_of = edges.join(shuffled(copies.withColumnRenamed("profile", "y")), "y").withColumnRenamed("x", "root")
    triangles = _triangles(edges).withColumnRenamed("x", "root")
    big = cut_lineage(triangles.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_links).select("root"))
    member = F.struct(F.col("y").alias("profile"), "score", F.lit(0.0).alias("second_score"), "copies", F.col("y_degree").alias("degree"))
    link = lambda a, b, score: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("score"))
    links = triangles.join(big, "root", "left_anti").groupBy("root").agg(F.collect_list(link("y", "z", "yz")).alias("links"))
    later = later_of.join(big, "root", "left_anti").groupBy("root").agg(F.collect_list(member).alias("later"))
    whole = later.join(shuffled(copies.withColumnRenamed("profile", "root")), "root").join(shuffled(links), "root", "left").select(
        "root", "copies", F.lit(False).alias("split"), F.col("root").alias("second"), F.lit(0).cast("long").alias("second_copies"), F.lit(0.0).alias("score"), "later", "links"
    )
    if big.isEmpty():
        return whole, big
    around = triangles.join(big, "root", "left_semi")
    third = F.struct(F.col("z").alias("profile"), F.col("xz").alias("score"), F.col("yz").alias("second_score"), "copies", F.col("z_degree").alias("degree"))
    thirds = around.join(copies.withColumnRenamed("profile", "z"), "z").groupBy("root", F.col("y").alias("second")).agg(F.collect_list(third).alias("later"))
    # edges z - w between two common later neighbours of root and second
    ends = around.select("root", F.col("y").alias("second"), "z")
    inner = around.select("root", F.col("y").alias("z"), F.col("z").alias("w"), F.col("yz").alias("zw")).join(ends, ["root", "z"])
    inner = inner.join(ends.withColumnRenamed("z", "w"), ["root", "second", "w"]).groupBy("root", "second").agg(F.collect_list(link("z", "w", "zw")).alias("links"))
    pairs = _named(edges, "root", "second", "score").join(big, "root", "left_semi")
    split = pairs.join(thirds, ["root", "second"], "left").join(inner, ["root", "second"], "left").withColumn("split", F.lit(True))
    split = split.join(copies.withColumnRenamed("profile", "root"), "root").join(copies.withColumnsRenamed({"profile": "second", "copies": "second_copies"}), "second")
    return whole.unionByName(split.select(*whole.columns)), big


def maximal_cliques(edges: DataFrame, copies: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(profile, clique, mean_score): the members of all maximal cliques of two or more profiles.

    ``edges``: x, y, x_degree, y_degree, score, x before y in the order of (degree, profile). A
    clique is found from its first member, among that member's later neighbours: those have
    at least its degree, so there are at most sqrt(2 * edges) of them, and a hub has hardly any.
    Where the matches between them are over ``most_links`` the search is split by the second member,
    and each part holds the common later neighbours of both. What an earlier profile would
    extend is found afterwards, by joining each clique with the earlier neighbours of its first two members.
    """
    id_type = dict(edges.dtypes)["x"]
    searched, big = searches(edges, copies, most_links)
    schema = f"profile {id_type}, clique string, mean_score double, root {id_type}, second {id_type}, size int"
    found = cut_lineage(searched.mapInPandas(_clique_rows, schema))
    # not maximal: an earlier profile matches all members (first the root, then the second, then the others)
    cliques = found.filter(F.col("profile") == F.col("root")).select("clique", "root", "second", "size")
    before = edges.select(F.col("x").alias("earlier"), "y")
    by = cliques.join(before.withColumnRenamed("y", "root"), "root").join(before.withColumnRenamed("y", "second"), ["earlier", "second"]).select("clique", "earlier", "size")
    between = (
        # a profile between the first two that matches all: only where the search was split by the second
        cliques.join(big, "root", "left_semi")
        .join(edges.select(F.col("x").alias("root"), F.col("y").alias("earlier")), "root").join(before.withColumnRenamed("y", "second"), ["earlier", "second"]).select("clique", "earlier", "size")
    )
    by = by.unionByName(between)
    rest = found.filter("profile <> root AND profile <> second").select("clique", F.col("profile").alias("y"))
    met = by.join(rest, "clique").join(before, ["earlier", "y"]).groupBy("clique", "earlier", "size").agg(F.count(F.lit(1)).alias("n"))
    extended = met.filter("n = size - 2").select("clique").unionByName(by.filter("size = 2").select("clique")).distinct()
    return found.join(extended, "clique", "left_anti").select("profile", "clique", "mean_score")


def cluster(pairs: DataFrame, people: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(profile, clique, mean_score, clique_size, method).

    Profiles take their best maximal clique (by mean score, ties by name), see
    ``maximal_cliques``; work follows the matches around a profile and not the size of a
    component. Profiles that only have exact copies form a party of their own. ``clique_size``
    counts accounts.
    """
    # read several times below: computed once, in shared storage
    pairs = cut_lineage(pairs)
    copies = cut_lineage(people.select("profile", "copies"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("profile")).groupBy("profile").agg(F.count(F.lit(1)).alias("degree"))
    ends = pairs.join(shuffled(degree.select(F.col("profile").alias("a"), F.col("degree").alias("da"))), "a").join(
        shuffled(degree.select(F.col("profile").alias("b"), F.col("degree").alias("db"))), "b"
    )
    before = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda x, y: F.when(before, F.col(x)).otherwise(F.col(y))
    edges = ends.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), pick("da", "db").alias("x_degree"), pick("db", "da").alias("y_degree"), "score")
    found = maximal_cliques(cut_lineage(edges), copies, most_links)
    best = found.groupBy("profile").agg(F.max(F.struct("mean_score", "clique")).alias("_b")).select("profile", "_b.clique", "_b.mean_score")
    alone = copies.filter("copies > 1").join(shuffled(degree), "profile", "left_anti").select(
        "profile", F.sha2(F.col("profile").cast("string"), 256).alias("clique"), F.lit(1.0).alias("mean_score")
    )
    chosen = best.withColumn("method", F.lit("clique")).unionByName(alone.withColumn("method", F.lit("copies"))).join(shuffled(copies), "profile")
    chosen = cut_lineage(chosen)
    accounts = chosen.groupBy("clique").agg(F.sum("copies").alias("clique_size")).filter("clique_size > 1")
    return chosen.drop("copies").join(shuffled(accounts), "clique")


def resolve(accounts: DataFrame, bands: int = BANDS, **scoring) -> DataFrame:
    """Accounts with their party: id, party, mean_score, clique_size and fields."""
    people = cut_lineage(profiles(accounts))
    pairs = score_pairs(people, lsh_pairs(people, "normalized_name", bands=bands), **scoring)
    parties = cluster(pairs, people)
    return (
        accounts.join(shuffled(people.select("normalized_name", "AD", "profile")), ["normalized_name", "AD"])
        .join(shuffled(parties), "profile")
        .select(F.col("id").alias("source"), "clique", "mean_score", "clique_size", "method", "NM", "AD", "CT", "effective_date")
    )


def attach_new(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Unassigned accounts matched to assigned ones take the best-scoring party.

    ``pairs``: (a, b, score); ``existing``: (id, party). Returns (id, party,
    mean_score), ties by party.
    """
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score")
    )
    fresh = both.join(shuffled(existing.select("id")), "id", "left_anti")
    by_party = (
        fresh.join(shuffled(existing.select(F.col("id").alias("other"), "party")), "other")
        .groupBy("id", "party").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    )
    return by_party.groupBy("id").agg(
        F.max_by(F.struct("party", "mean_score"), F.struct("mean_score", "party")).alias("_p")
    ).select("id", "_p.*")


def attach_all(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """``attach_new`` until nothing changes: (id, party, mean_score, round).

    Accounts that take a party in one round are assigned ones in the next, so a new account that
    matches only other new ones follows them. Rounds are as many as the longest such chain.
    """
    known, out, number = existing.select("id", "party"), None, 0
    while True:
        number += 1
        got = cut_lineage(attach_new(pairs, known).withColumn("round", F.lit(number)))
        out = got if out is None else out.unionByName(got)
        if got.isEmpty():
            return out
        known = cut_lineage(known.unionByName(got.select("id", "party")))


@dataclass(frozen=True)
class Matched:
    """What was matched so far: profiles, the band table of their names, and the party of the assigned ones."""

    people: DataFrame
    bands: DataFrame
    parties: DataFrame


def match_batch(state: Matched, people: DataFrame, block_size: int = 2000, **scoring) -> tuple[DataFrame, Matched]:
    """Attach the profiles of a batch: (id, party, mean_score, round), and the state for the next batch.

    Only pairs with a new profile are made: new names meet the stored band table, and
    new profiles those under their own and the met names. Profiles that no chain of matches
    connects to a party stay unassigned; ``cluster`` makes parties of their pairs.
    """
    fresh = cut_lineage(people.join(shuffled(state.people.select("profile")), "profile", "left_anti"))
    # names are told apart before they get bands, which are many times as many rows
    given = fresh.select(F.col("normalized_name").alias("text")).distinct()
    had = state.people.select(F.col("normalized_name").alias("text")).distinct()
    bands = name_bands(given.join(shuffled(had), "text", "left_anti"), "text")
    names = _pairs_with_new(bands, state.bands, JACCARD, block_size)
    # names that were stored before may pair with each other, too, once one of them has a new profile
    again = given.join(shuffled(had), "text", "left_semi")
    old = state.bands.join(shuffled(again), "text")
    names = names.unionByName(_verified_names(old.join(shuffled(_second(state.bands)), ["band", "key"]).filter("text <> text_b"), JACCARD)).distinct()
    everyone = state.people.select(*people.columns).unionByName(fresh)
    pairs = cut_lineage(score_pairs(everyone, names, block_size=block_size, fresh=fresh, **scoring))
    attached = attach_all(pairs, state.parties)
    parties = state.parties.select("id", "party").unionByName(attached.select("id", "party"))
    return attached, Matched(everyone, state.bands.unionByName(bands.select(*state.bands.columns)), parties)


def match_state(score: Column, threshold: float = AUTO_CONFIRM_FROM) -> Column:
    """Confirmed automatically from the threshold on; -1 turns that off."""
    if threshold == -1:
        return F.lit(CANDIDATE).cast("long")
    return F.when(score >= threshold, F.lit(AUTO_CONFIRM)).otherwise(F.lit(CANDIDATE)).cast("long")


def load_parties(edges: DataFrame, nodes: DataFrame, states: Sequence[int] = (AUTO_CONFIRM, MANUAL_CONFIRM)) -> DataFrame:
    """Parties of two or more accounts in the given match states.

    ``edges``: id (account), source_node (party), data (JSON with SC, ST);
    ``nodes``: id, data (JSON with NM, AD).
    """
    parsed = edges.withColumn("_d", F.from_json("data", "SC double, ST string")).select(
        F.col("id").alias("account_id"), F.col("source_node").alias("party_id"),
        F.col("_d.SC").alias("mean_score"), F.col("_d.ST").cast("int").alias("ST"),
    ).filter(F.col("ST").isin(list(states)))
    fields = nodes.withColumn("_d", F.from_json("data", "NM string, AD string")).select(
        F.col("id").alias("account_id"), "_d.NM", "_d.AD"
    )
    rows = parsed.join(fields, "account_id")
    several = rows.groupBy("party_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("party_id")
    return rows.join(several, "party_id", "left_semi")


def party_members(rows: DataFrame, party: str = "party_id", member: str = "account_id") -> DataFrame:
    """JSON list of members per party, with a blank after each colon."""
    out = packed(rows.select(party, F.col(member).cast("string").alias(member)), [party], {member: member}, "_json")
    inner = F.get_json_object("_json", "$.data")
    return out.select(party, "part", F.regexp_replace(inner, '":', '": ').alias("party_accounts"))


def party_graph(result: DataFrame, existing_parties: DataFrame, effective: Column, threshold: float = AUTO_CONFIRM_FROM) -> tuple[DataFrame, DataFrame]:
    """New party nodes, and an edge from each party to its accounts."""
    nodes = (
        result.select(F.col("clique").alias("id")).distinct()
        .join(existing_parties.select("id"), "id", "left_anti")
        .select(
            "id", F.col("id").alias("PI"),
            *[F.lit(None).cast("string").alias(c) for c in ("NM", "AD", "CT")],
            F.lit(1).cast("long").alias("CN"),
            F.lit(None).cast("timestamp").alias("UON"), F.lit(None).cast("string").alias("UBY"),
            effective.alias("effective_date"),
        )
    )
    edges = result.select(
        F.col("source").alias("id"), F.col("clique").alias("source_node"), F.col("source").alias("target_node"),
        F.col("mean_score").alias("SC"), match_state(F.col("mean_score"), threshold).alias("ST"), effective.alias("effective_date"),
    )
    return nodes, edges
