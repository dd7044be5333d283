"""Benchmark decontamination: item-sized windows of documents that repeat a benchmark item.

DataFrame functions only. Texts are words (runs of ASCII letters and digits and of anything
beyond ASCII, lower-cased) and five-word shingles. Windows as long as an item are
placed where a document holds one of the item's *anchors*: so many of its rarest shingles
that no window of the wanted similarity can lack them all. An anchor says where the item
would start; as words may have been put in, left out or changed before it, windows start at
every place that is off by no more than such a window allows. Each window gets a SimHash fingerprint
of its shingles, weighted by how often they occur; fingerprints within the radius agree with the
item's in one of eight blocks up to a few bits, and the items list all such block values,
so an equi-join finds every one. Candidates are verified on the shingle multisets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
SIMILAR = 0.8
#: Fingerprints differ in about 10 of 64 bits at similarity 0.8; 23 is over four deviations more.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Anchors (24 bytes each) that may be broadcast.
BROADCAST_ANCHORS = 500_000


def shingled(df: DataFrame, key: str) -> DataFrame:
    """key, shingles: the hashes of the text's shingles in their order; none under five words."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    hashed = _once(df, [key], "words", F.transform(words, lambda w: F.xxhash64(w)))
    shingle = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)]))
    return _once(hashed.filter(F.size("words") >= SHINGLE), [key], "shingles", shingle)


def _once(df: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """keys and a column that is computed once: filters above do not move below it and repeat its expression."""
    return df.select(*keys, F.explode(F.array(value)).alias(name))


def anchors(items: DataFrame, similar: float) -> DataFrame:
    """shingle, offset and size (shingles of the item) of every anchor.

    A window at least ``similar`` lacks at most (1 - similar) of the item's shingles, so
    the rarest ones that together exceed this share are enough.
    """
    placed = items.select("item_id", F.size("shingles").alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
    rarity = placed.groupBy("shingle").agg(F.countDistinct("item_id").alias("items"))
    own = placed.groupBy("item_id", "size", "shingle").agg(F.count(F.lit(1)).alias("times")).join(rarity, "shingle")
    before = F.sum("times").over(Window.partitionBy("item_id").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    chosen = own.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= F.col("size") * (1 - similar) + 1e-9)
    return placed.join(chosen.select("item_id", "shingle"), ["item_id", "shingle"]).select("shingle", "offset", "size").distinct()


def slack(size: Column, similar: float) -> Column:
    """How far the start of a window of ``size`` shingles may lie from where a shared shingle puts it.

    Two multisets of one size that are ``similar`` differ in at most (1 - similar) / (1 + similar) of their
    shingles each; where the shared ones keep their order, no more than these can stand before a
    shared one on one side only.
    """
    return F.floor(size * ((1 - similar) / (1 + similar)) + 1e-9).cast("int")


def windows(docs: DataFrame, marks: DataFrame, similar: float) -> DataFrame:
    """doc_id, start, size, window: the shingles of the item-sized windows that anchors place.

    A document shorter than the item is one window.
    """
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))

    def within(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(x, last))

    at = F.col("pos") - F.col("offset")
    hits = docs.select("doc_id", "shingles", F.size("shingles").alias("n"), F.posexplode("shingles").alias("pos", "shingle"))
    # the anchors of one copy mostly give the same range of starts, which is cut out of the document once
    ends = [within(at - slack(F.col("size"), similar)).alias("low"), within(at + slack(F.col("size"), similar)).alias("high"), "size"]
    stretch = F.slice("shingles", F.col("low") + 1, F.col("high") - F.col("low") + F.col("size")).alias("stretch")
    if marks.count() <= BROADCAST_ANCHORS:
        ranges = hits.join(F.broadcast(marks), "shingle").select("doc_id", "shingles", *ends).select("doc_id", "low", "high", "size", stretch).distinct()
    else:
        found = hits.drop("shingles").join(marks, "shingle").select("doc_id", *ends).distinct()
        ranges = docs.join(found, "doc_id").filter(F.col("low") < F.size("shingles")).select("doc_id", "low", "high", "size", stretch)
    placed = ranges.select("doc_id", "low", "size", "stretch", F.explode(F.sequence("low", "high")).alias("start"))
    return placed.select("doc_id", "start", "size", F.slice("stretch", F.col("start") - F.col("low") + 1, F.col("size")).alias("window")).filter(F.size("window") > 0).distinct()


def fingerprints(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """keys, shingles and a 64-bit SimHash: a bit is set if most of the shingles set it.

    Each of 32 sums holds two counters of 32 bits, more than an array's length needs, so a
    fingerprint is one pass of plain sums.
    """
    lanes = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(lanes))).alias(f"s{i}") for i in range(32)]
    summed = df.select(*keys, shingles, F.explode(shingles).alias("h")).groupBy(*keys, shingles).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for i in range(32):
        for lane in range(2):
            count = F.shiftrightunsigned(f"s{i}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            pos = 32 * lane + i
            value = (1 << pos) - (1 << 64 if pos == 63 else 0)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, shingles, bits.alias("fingerprint"))


def _block(fingerprint: str) -> Column:
    """An array of (block number, its bits)."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)])


def candidates(found: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Windows and items of one size whose fingerprints differ in at most ``radius`` bits.

    Of eight blocks one differs in at most radius // 8 bits; the items list every
    value of every block that is so near.
    """
    near = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), k)]
    spread = items.select("item_id", "size", "item", F.col("fingerprint").alias("item_fp"), F.explode(_block("fingerprint")).alias("b"))
    spread = spread.select("*", F.explode(F.array(*[F.lit(x) for x in near])).alias("flip")).select(
        "item_id", "size", "item", "item_fp", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("flip")).alias("value")
    )
    cut = found.select("*", F.explode(_block("fingerprint")).alias("b")).select("*", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    met = cut.join(spread, ["size", "block", "value"]).withColumn("differ", F.col("fingerprint").bitwiseXOR(F.col("item_fp")))
    # of the blocks in which a pair meets, the first one counts
    earlier = F.lit(False)
    for b in range(BLOCKS - 1):
        own = F.bit_count(F.shiftrightunsigned("differ", b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
        earlier = earlier | ((F.col("block") > b) & (own <= radius // BLOCKS))
    return met.filter((F.bit_count("differ") <= radius) & ~earlier)


def similarity(a: str, b: str) -> Column:
    """The weighted Jaccard similarity of two shingle multisets."""

    def times(bag: str, x: Column) -> Column:
        return F.size(F.filter(F.col(bag), lambda y: y == x))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity and start (word) of every document that repeats an item.

    Where several windows repeat the item, the most similar one counts, and of equal ones the first. Found are
    windows whose shared shingles keep their order; of a copy with its parts in another order only those that
    start where an anchor puts them. Texts
    and items of under five words (NULL and empty ones too) have no shingles and match nothing. Rows
    that repeat an id are one document; a NULL id matches nothing.
    """
    items = shingled(benchmark.filter(F.col("item_id").isNotNull()), "item_id")
    found = windows(shingled(docs.filter(F.col("doc_id").isNotNull()), "doc_id"), anchors(items, similar), similar)
    found = fingerprints(found, ["doc_id", "start", "size"], "window")
    sized = items.select("item_id", F.size("shingles").alias("size"), F.col("shingles").alias("item"))
    pairs = candidates(found, fingerprints(sized, ["item_id", "size"], "item"), radius)
    best = pairs.withColumn("similarity", similarity("window", "item")).filter(F.col("similarity") >= similar)
    top = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("t"))
    return top.select("doc_id", "item_id", F.col("t.similarity").alias("similarity"), (-F.col("t.back")).cast("long").alias("start"))
