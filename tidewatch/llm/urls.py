"""URL filters: rules first, then naive Bayes over segmented host and path words.

Host names run words together. Labels are cut at hyphens and digits, and each part is
segmented by unigram Viterbi with counts from all URLs; a multinomial naive Bayes model
scores the words of host and path by how often they stand there. Its block class spreads from
seeds: hosts with an unwanted word are examples, all others are first taken for clean, and
rounds of expectation maximisation then count each by its own odds. Counts and scores are joins
and aggregations over all pages; only the segmentation of one label (at most 63 characters) is code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import arrow_map, written

#: The rules (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words that mark hosts as unwanted; hosts that hold one are the model's first examples.
UNWANTED = (
    "spam farm pills cheap pharmacy viagra casino poker bets bet betting win jackpot slots lottery adult porn sex xxx escort dating ads track tracker "
    "tracking click banner popup free loan loans payday crypto warez crack torrent keygen malware phish scam fake replica doorway linkfarm"
).split()
#: Everyday words of host names.
NEUTRAL = "www blog mail shop news web site online home page mobile media store info data cloud app dev docs wiki forum help support search music video photo book city world times post daily the and for".split()

LONGEST_WORD = 20
#: Rounds in which pages without an unwanted word are counted in both classes by their own odds.
ROUNDS = 2


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host (A-Z lower-cased) and path of every row; without ``://`` both are empty."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    cut = pages.select("page_id", rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    return cut.select(
        "page_id",
        F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(F.substr("rest", F.length("raw") + 1), r"^[^?#]*", 0).alias("path"),
    )


def matched(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # a longer one is put in front
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        rule = F.when(fits, rule_host + prefix).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _parts(text: Column) -> Column:
    """Runs of letters (and of what lies beyond ASCII)."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x60\x7B-\x7F]+"), lambda w: F.length(w) > 0)


def unigrams(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """word, n: in how many distinct label parts and distinct hosts' paths a word stands by itself.

    Parts of hyphenated labels are words that their owner has already cut apart, so they
    count; an unbroken label counts only if it is short. The fixed words count as ``SEED``.
    """
    spark = hosts.sparkSession
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).distinct()
    whole = labels.withColumn("cut", _parts(F.col("label")))
    own = whole.filter((F.size("cut") > 1) | (F.length("label") <= 4)).select(F.explode("cut").alias("word"))
    seen = paths.select(F.explode(F.array_distinct("path_words")).alias("word"))
    seeds = spark.createDataFrame([(w, SEED) for w in sorted({*UNWANTED, *NEUTRAL})], "word string, n long")
    counted = own.unionByName(seen).filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


#: What a fixed word counts at least.
SEED = 20


def viterbi(part: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest cut of ``part`` into words; a stretch that is no known word costs
    ``unknown`` plus a charge for every letter."""
    best = [(0.0, 0)]
    for end in range(1, len(part) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            cost = costs.get(part[start:end])
            options.append((best[start][0] + (unknown + 2.3 * (end - start) if cost is None else cost), start))
        best.append(min(options, key=lambda o: (o[0], o[1])))
    words, end = [], len(part)
    while end:
        start = best[end][1]
        words.append(part[start:end])
        end = start
    return words[::-1]


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, words: every distinct part in its likeliest words.

    The possible words of a part (at most 63 * 20 substrings) are joined to the counts,
    so no dictionary is held anywhere.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    unknown = math.log(total)
    stretches = (
        parts.select("part", F.explode(F.sequence(F.lit(1), F.greatest(F.length("part"), F.lit(1)))).alias("at"))
        .select("part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("part") - F.col("at") + 1))).alias("size"))
        .select("part", F.substr("part", F.col("at"), F.col("size")).alias("word"))
        .distinct()
    )
    costs = stretches.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def rows(cols):
        parts, known = cols["part"].to_pylist(), cols["known"].to_pylist()
        return {
            "part": parts,
            "words": [viterbi(p, {k["word"]: math.log(total / k["n"]) for k in ks or []}, unknown) for p, ks in zip(parts, known)],
        }

    return arrow_map(parts.join(costs, "part", "left"), rows, "part string, words array<string>")


def tokens_of(pairs: DataFrame) -> DataFrame:
    """pair, word, times: the words of each pair's host, and those of its path behind a slash."""
    hosts = pairs.select("host").distinct()
    # the last label (the registry's) says nothing about content, unless it is the only one
    labels = F.split("host", r"\.")
    kept = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1)))
    host_parts = hosts.select("host", F.explode(F.flatten(F.transform(kept, _parts))).alias("part"))
    words = segmented(host_parts.select("part").distinct(), unigrams(hosts, pairs))
    host_words = host_parts.join(words, "part").select("host", F.explode("words").alias("word")).groupBy("host", "word").agg(F.count(F.lit(1)).alias("times"))
    path_words = pairs.select("pair", F.explode("path_words").alias("word")).groupBy("pair", F.concat(F.lit("/"), "word").alias("word")).agg(F.count(F.lit(1)).alias("times"))
    return pairs.select("pair", "host").join(host_words, "host").select("pair", "word", "times").unionByName(path_words)


def fit(pairs: DataFrame, tokens: DataFrame, blocked: DataFrame) -> tuple[DataFrame, float]:
    """word and weight (the log ratio of its smoothed shares in the classes), and the log ratio of the classes.

    ``blocked`` (pair, p) says with which probability a pair's pages are of the block class. Sums
    are of decimals, so that they do not depend on the order of rows.
    """
    p = F.round("p", 6).cast("decimal(7,6)")
    shares = pairs.select("pair", "pages").join(blocked, "pair").select("pair", (F.col("pages") * p).alias("bad"), (F.col("pages") * (1 - p)).alias("good"))
    # stored, so that joins with tokens shuffle both sides: Spark then splits the rows of a hot word
    by_word = written(tokens.join(shares, "pair").groupBy("word").agg(*[F.sum(F.col("times") * F.col(c)).cast("double").alias(c) for c in ("bad", "good")]))
    sums = by_word.agg(*[F.coalesce(F.sum(F.round(c, 6).cast("decimal(30,6)")), F.lit(0)).cast("double").alias(c) for c in ("bad", "good")], F.count(F.lit(1)).alias("words")).first()
    prior = shares.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("bad", "good")]).first()
    ratio = F.log((F.col("bad") + 1) / F.lit(sums["bad"] + sums["words"] + 1)) - F.log((F.col("good") + 1) / F.lit(sums["good"] + sums["words"] + 1))
    return by_word.select("word", F.round(ratio, 9).cast("decimal(20,9)").alias("weight")), math.log((prior["bad"] + 1) / (prior["good"] + 1))


def scores(pairs: DataFrame, tokens: DataFrame, weights: DataFrame, start: float) -> DataFrame:
    """pair and score, the probability of the block class; 0 for pairs without words."""
    odds = tokens.join(weights, "word").groupBy("pair").agg(F.sum(F.col("times") * F.col("weight")).cast("double").alias("odds"))
    score = F.when(F.col("odds").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("odds") + start))))
    return pairs.select("pair", "seed").join(odds, "pair", "left").select("pair", "seed", score.alias("score"))


def judge(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every page.

    The rules decide where one fits. Elsewhere a page is blocked if its words are likelier in the
    block class. Hosts that hold an unwanted word are that class's examples; the other
    pages belong to the other class at first, and in each of ``rounds`` more fits to both by
    their scores. Words count as often as they stand in host and path. Rows whose url is NULL or
    holds no ``://`` have empty parts and no words: the verdict is allow. A host of one label
    keeps it, longer ones lose their last. Repeated page ids keep their rows.
    """
    rows = parsed(pages)
    rule, says = matched(F.col("host"), F.col("path"))
    # one row per host and bag of path words: everything after this is per distinct pair
    rows = rows.select("*", rule.alias("rule"), says.alias("says"), F.concat_ws(" ", F.array_sort(_parts(F.col("path")))).alias("path_key"))
    pairs = rows.groupBy("host", "path_key").agg(F.count(F.lit(1)).alias("pages")).withColumn("pair", F.monotonically_increasing_id())
    pairs = written(pairs).withColumn("path_words", F.filter(F.split("path_key", " "), lambda w: F.length(w) > 0))
    tokens = written(tokens_of(pairs))
    unwanted = tokens.filter(F.col("word").isin(list(UNWANTED))).select("pair").distinct().withColumn("seed", F.lit(1.0))
    seeded = written(pairs.select("pair", "host", "path_key", "pages").join(unwanted, "pair", "left"))

    blocked = seeded.select("pair", F.coalesce("seed", F.lit(0.0)).alias("p"))
    for i in range(rounds + 1):
        scored = scores(seeded, tokens, *fit(seeded, tokens, blocked))
        if i < rounds:
            blocked = written(scored.select("pair", F.coalesce("seed", "score").alias("p")))
    known = seeded.select("pair", "host", "path_key").join(scored.select("pair", "score"), "pair").drop("pair")
    return rows.join(known, ["host", "path_key"]).select(
        "page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
