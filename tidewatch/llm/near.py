"""Near-duplicate documents by BagMinHash, bands and exact verification.

A document is the multiset of its five-word shingles. Every shingle owns Poisson processes,
one for each strip of weights [0, 1), [1, 2), [2, 4), [4, 8) and so on; a document sees the points
below the shingle's count. A strip that lies only partly below is split in halves, point by
point, until a half is inside or outside. Points carry a signature component; a component keeps
the smallest point seen, and a process stops where no component can improve. Two documents
agree in a component with probability equal to their weighted Jaccard similarity.

Bands of components collide into buckets, and pairs in a bucket are verified on the multisets
themselves. A bucket never emits all its pairs: members meet the bucket's first document,
verified links merge documents into classes, and only buckets that still hold several classes go on:
small ones compare members of different classes, large ones go through their member with the most
links and then an exact prefix filter. No link between the classes of a bucket is lost. At
similarity 0.8 the default bands miss one pair in 20,000, less above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import Spans, arrow_map, chunks, mix, one_text_per_id, signed, words_bytes, written
from tidewatch.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 25, 5
SIMILAR = 0.8
#: Buckets up to this size compare all members of different classes at once.
SMALL_BUCKET = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str) -> list[bytes]:
    return words_bytes(text.lower())


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count): the shingle multisets of texts; under five words, all words are one shingle."""
    words = [normal_words(t) for t in texts]
    spans = Spans(words, (1,))
    sizes = spans.stop - spans.first
    each = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(texts)), each)
    if not len(text):
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none
    first = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + spans.first[text]
    last = np.minimum(first + SHINGLE, spans.stop[text]) - 1
    h = mix(spans.hashes(first, last, 1))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    return text[new], h[new], np.diff(np.append(new, len(h)))


def bag_minhash(n_texts: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) signatures; components of texts without shingles stay infinite."""
    sig = np.full((n_texts, size), np.inf)
    flat = sig.reshape(-1)
    # processes: one for each strip that starts below the count
    owner, seed, width, below = [text], [mix(shingle)], [np.ones(len(text))], [np.ones(len(text))]
    low = 1
    while True:
        more = count > low
        if not more.any():
            break
        owner.append(text[more])
        seed.append(mix(shingle[more] + np.uint64(low * int(_GOLD) % 2**64)))
        width.append(np.full(more.sum(), float(low)))
        below.append(np.minimum(count[more] - low, low).astype(float))
        low *= 2
    owner, seed, width, below = (np.concatenate(x) for x in (owner, seed, width, below))
    x = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        r = mix(seed + np.uint64(step * int(_GOLD) % 2**64))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
        r = mix(r ^ _GOLD)
        part = ((r >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        hit = np.ones(len(owner), dtype=bool)
        cut = np.flatnonzero(below < width)
        if len(cut):
            # split the strip in halves until the point's half is inside or outside
            bits, lo, half = mix(r[cut] + _GOLD), np.zeros(len(cut)), width[cut] / 2
            open_ = np.arange(len(cut))
            inside = np.zeros(len(cut), dtype=bool)
            while len(open_):
                lo[open_] += half[open_] * (bits[open_] & np.uint64(1)).astype(float)
                bits[open_] = mix(bits[open_])
                b = below[cut][open_]
                done_in = lo[open_] + half[open_] <= b
                done_out = lo[open_] >= b
                inside[open_[done_in]] = True
                half[open_] /= 2
                open_ = open_[~(done_in | done_out)]
            hit[cut] = inside
        at = owner[hit] * size + part[hit].astype(np.int64)
        np.minimum.at(flat, at, x[hit])
        worst = sig.max(axis=1)
        on = x < worst[owner]
        owner, seed, width, below, x = owner[on], seed[on], width[on], below[on], x[on]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) one number for each band's components."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(31) + bits[:, :, i] + np.uint64(i))
    return mix(key + np.arange(BANDS, dtype=np.uint64) * _GOLD)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the word sequence), bands; texts without words do not appear."""

    def rows(cols):
        ids, texts = cols["doc_id"].to_pylist(), cols["text"].to_pylist()
        out = {k: [] for k in ("doc_id", "k1", "k2", "bands")}
        for a, z in chunks(texts):
            part = texts[a:z]
            text, shingle, count = bags(part)
            keys = signed(band_keys(bag_minhash(len(part), text, shingle, count, BANDS * ROWS)))
            spans = Spans([normal_words(t) for t in part], (0, 1))
            some = np.flatnonzero(spans.stop > spans.first)
            k = [signed(spans.hashes(spans.first[some], spans.stop[some] - 1, w)).tolist() for w in (0, 1)]
            out["doc_id"] += [ids[a + i] for i in some.tolist()]
            out["k1"] += k[0]
            out["k2"] += k[1]
            out["bands"] += [keys[i] for i in some.tolist()]
        return out

    return arrow_map(docs, rows, "doc_id long, k1 long, k2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity: the weighted Jaccard similarity of each pair's shingle multisets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def rows(cols):
        a, b = cols["a"].to_pylist(), cols["b"].to_pylist()
        ta, tb = cols["text_a"].to_pylist(), cols["text_b"].to_pylist()
        sims = []
        for lo, hi in chunks(tb, 500_000):
            # a document that meets many others is cut once
            place: dict[str, int] = {}
            ia = [place.setdefault(t, len(place)) for t in ta[lo:hi]]
            ib = [place.setdefault(t, len(place)) for t in tb[lo:hi]]
            text, shingle, count = bags(list(place))
            edges = np.searchsorted(text, np.arange(len(place) + 1))
            bag = [(shingle[s:e], count[s:e]) for s, e in zip(edges[:-1], edges[1:])]
            for x, y in zip(ia, ib):
                (hx, cx), (hy, cy) = bag[x], bag[y]
                at = np.searchsorted(hx, hy)
                at[at == len(hx)] = 0
                same = hx[at] == hy if len(hx) else np.zeros(len(hy), bool)
                both = int(np.minimum(cx[at[same]], cy[same]).sum())
                either = int(cx.sum() + cy.sum()) - both
                sims.append(both / either if either else 0.0)
        return {"a": a, "b": b, "similarity": sims}

    return arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), rows, "a long, b long, similarity double")


def similar_prefixes(texts: DataFrame, similar: float) -> DataFrame:
    """a, b: all pairs of different classes that can reach the similarity; texts have doc_id, text, class.

    Prefix filter: in one order of all shingles, the rarest first, two similar documents share one
    of the first shingles that make up more than 1 - similar of either. A document that
    differs by its own edits has nothing but its own shingles there and meets no one.
    """

    def rows(cols):
        ids, texts_, classes_ = cols["doc_id"].to_pylist(), cols["text"].to_pylist(), cols["class"].to_pylist()
        out = {k: [] for k in ("doc_id", "class", "total", "shingle", "times")}
        for a, z in chunks(texts_):
            text, shingle, count = bags(texts_[a:z])
            total = np.zeros(z - a, dtype=np.int64)
            np.add.at(total, text, count)
            for k, v in zip(out, (np.array(ids[a:z])[text], np.array(classes_[a:z])[text], total[text], signed(shingle), count)):
                out[k].append(v.astype(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()} if out["times"] else None

    held = arrow_map(texts.select("doc_id", "text", "class"), rows, "doc_id long, class long, total long, shingle long, times long")
    rarity = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"))
    before = F.sum("times").over(Window.partitionBy("doc_id").orderBy("docs", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    prefix = held.join(rarity.filter("docs > 1"), "shingle", "left").withColumn("docs", F.coalesce("docs", F.lit(1)))
    prefix = prefix.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= (1 - similar) * F.col("total") + 1e-9).filter("docs > 1")
    prefix = prefix.select("shingle", "doc_id", "class", "total", (F.col("total") - F.col("before")).alias("left"))
    # one side holds only members of other classes than the shingle's largest
    by_class = prefix.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = by_class.groupBy("shingle").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("shingle", F.col("top.class").alias("top"))
    minor = prefix.join(largest, "shingle").filter("class <> top").drop("top", "classes")
    x, y = ([F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "class", "total", "left")] for side in "xy")
    # what two documents share from their first common shingle on must make up the similarity
    needed = similar / (1 + similar) * (F.col("total_x") + F.col("total_y")) - 1e-9
    met = minor.select("shingle", *x).join(prefix.select("shingle", *y), "shingle").filter(
        (F.col("class_x") != F.col("class_y")) & (F.col("left_x") >= needed) & (F.col("left_y") >= needed)
    )
    met = met.select(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_node_per_text(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text with a doc_id of its own for each text, and the pairs (doc_id, b) of
    ids that were given out to further texts of a document; None where no id has several texts.

    The smallest text keeps the id. Given-out ids lie beyond all others.
    """
    again = written(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"))
    if again.isEmpty():
        return known, None
    texts = known.join(again, "doc_id", "left_semi").distinct()
    firsts = texts.groupBy("doc_id").agg(F.min("text").alias("_first"))
    ends = known.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    number = F.monotonically_increasing_id()
    node = F.lit(ends["most"] + 1) + number if ends["most"] < 1 << 62 else F.lit(ends["least"] - 1) - number
    further = written(texts.join(firsts, "doc_id").filter("text <> _first").select("doc_id", "text", node.alias("b")))
    renamed = known.join(further, ["doc_id", "text"], "left").select(F.coalesce("b", "doc_id").alias("doc_id"), "text")
    return written(renamed.distinct()), further.select("doc_id", "b")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id (the smallest id of its class) of every row, one row for each row of ``docs``.

    Documents are linked if their shingle multisets have a weighted Jaccard similarity
    of ``similar`` or more; classes are the connected components. Rows with the same
    words are linked outright. A text without words (also NULL) is a class of its own;
    a NULL id has no class (NULL). Rows that repeat an id are one document, whatever
    their texts: each of them is compared, and all are in one class.
    """
    docs = one_text_per_id(docs)
    every = docs.select("doc_id")
    known, further = one_node_per_text(docs.filter(F.col("doc_id").isNotNull()))
    signed_docs = written(signatures(known))
    groups = signed_docs.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = signed_docs.select("doc_id", "k1", "k2").join(groups, ["k1", "k2"]).filter("doc_id > rep").select("doc_id", "rep")
    keys = signed_docs.select("doc_id", F.explode("bands").alias("bucket")).join(copies.select("doc_id").distinct(), "doc_id", "left_anti").distinct()
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(keys.join(shared.select("bucket"), "bucket"))
    # equal rows of an id are one text
    texts = written(known.dropDuplicates(["doc_id"]).join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))

    # each document meets one bucket's first document, so most classes form at once
    first = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"))
    pairs = buckets.join(first, "bucket").filter("doc_id > a").groupBy(F.col("doc_id").alias("b")).agg(F.min("a").alias("a"))
    tested = verified(pairs.select("a", "b"), texts)
    if further is not None:
        # the texts of one id are linked, through the first copies of their words
        first_copy = copies.distinct()
        ends = further.select(F.col("doc_id").alias("x"), F.col("b").alias("y"))
        for end, name in (("x", "a"), ("y", "b")):
            ends = ends.join(first_copy.select(F.col("doc_id").alias(end), F.col("rep").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
        same = ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1.0).alias("similarity"))
        tested = tested.unionByName(same).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    tested = written(tested)

    def classes_of(pairs_tested: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = pairs_tested.filter(F.col("similarity") >= similar).select("a", "b")
        found = connected_components(links, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("class"))
        return links, written(found)

    def still_mixed(labels: DataFrame) -> DataFrame:
        """bucket, doc_id, class, n of the buckets that hold several classes."""
        at = buckets.join(labels, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
        sizes = at.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count(F.lit(1)).alias("n"))
        return at.join(sizes.filter("c0 < c1").select("bucket", "n"), "bucket")

    links, labels = classes_of(tested)
    mixed = written(still_mixed(labels).select("bucket", "doc_id", "class", "n"))
    # small buckets: all members of different classes
    few = mixed.filter(F.col("n") <= SMALL_BUCKET)
    met = few.select("bucket", F.col("doc_id").alias("a"), F.col("class").alias("x")).join(few.select("bucket", F.col("doc_id").alias("b"), F.col("class").alias("y")), "bucket").filter("a < b and x <> y")
    # large ones: the member with the most links so far meets those it is not linked to
    many = mixed.filter(F.col("n") > SMALL_BUCKET)
    degrees = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = many.join(degrees, "doc_id", "left").withColumn("key", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("doc_id")).alias("back"), F.col("class").alias("class")))
    hubs = ranked.groupBy("bucket").agg(F.max("key").alias("hub")).select("bucket", (-F.col("hub.back")).alias("hub"), F.col("hub.class").alias("hub_class"))
    around = many.join(hubs, "bucket").filter("class <> hub_class").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
    pairs = met.select("a", "b").unionByName(around).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = written(tested.unionByName(verified(pairs, texts)))
    # large buckets of several classes even so: every pair that can be similar enough
    labels = classes_of(tested)[1]
    rest = still_mixed(labels).filter(F.col("n") > SMALL_BUCKET).groupBy("doc_id").agg(F.first("class").alias("class"))
    pairs = written(similar_prefixes(texts.join(rest, "doc_id"), similar).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        labels = classes_of(tested.unionByName(written(verified(pairs, texts))))[1]

    result = every.join(copies.distinct(), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    result = result.join(labels.select(F.col("doc_id").alias("rep"), "class"), "rep", "left")
    return result.select("doc_id", F.coalesce("class", "rep").alias("class_id"))
