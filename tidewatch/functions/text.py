"""Text predicates and measures as plain column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.session import shuffled

# Texts that stand for "no value".
NO_VALUE_TEXTS = ["", "none", "null", "unknown", "nil"]

# Punctuation dropped from names before they are compared.
NAME_PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~]"""

# Fixed value: distance reported when one of the names has no comparable word.
NO_WORDS_DISTANCE = 100986000.0


def no_value(df: DataFrame, column: str) -> Column:
    """True for NULL, NaN (float columns only) and texts that mean "nothing"."""
    c = F.col(column)
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, T.StringType):
        return c.isNull() | F.trim(F.lower(c)).isin(NO_VALUE_TEXTS)
    return c.isNull()


def keywords_of(df: DataFrame, group: str, keyword: str, limit: int = 5000) -> dict[str, list[str]]:
    """Read a keyword dimension to the driver after checking that it is small."""
    rows = df.select(F.lower(group).alias("g"), F.col(keyword).alias("k")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} keywords; use keyword_hits, which joins the table")
    out: dict[str, list[str]] = {}
    for g, k in sorted((r["g"], r["k"]) for r in rows):
        out.setdefault(g, []).append(k)
    return out


def keyword_flags(df: DataFrame, text: str, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per group: the first whole-word hit (any case) and whether there is one."""
    hits, flags = {}, {}
    for group, words in keywords.items():
        alternatives = "|".join(re.escape(w) for w in words)
        hit = F.regexp_extract(F.col(text), rf"(?i)\b({alternatives})\b", 1)
        hits[f"{group}_risky_keyword"] = F.when(hit != "", hit)
        flags[f"is_{group}_kw_found"] = F.col(f"{group}_risky_keyword").isNotNull()
    return df.withColumns(hits).withColumns(flags)


# Letters with their marks, digits and the underscore, of any script.
WORD = r"\p{L}\p{M}\p{N}_"


def _words(c: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), rf"[^{WORD}]+"), lambda w: w != ""))


def keyword_hits(df: DataFrame, key: str, text: str, keywords: DataFrame, group: str, keyword: str) -> DataFrame:
    """(key, group, keyword): whole-word hits (any case) of a keyword table of any size.

    Each keyword is anchored at the one of its words that the fewest texts hold, so a common
    first word ("the ...") draws nothing; a keyword with a word that no text holds is
    dropped at once. Texts meet the keywords by those words, and the whole keyword is then looked for.
    Nothing is listed on the driver. Words are of any script; a keyword without a letter or
    digit hits nothing.
    """
    table = keywords.select(F.col(group).alias("_g"), F.col(keyword).alias("_k")).distinct()
    words = df.select(key, F.explode(_words(F.col(text))).alias("_w"))
    texts = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    parts = table.select("_g", "_k", F.explode(_words(F.col("_k"))).alias("_w"))
    rarest = parts.join(shuffled(texts), "_w", "left").groupBy("_g", "_k").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w"))).alias("_a"))
    anchored = rarest.filter("_a.n > 0").select("_g", "_k", F.col("_a.w").alias("_w"))
    # a hash table of the anchors: the words, which grow with the texts, are neither broadcast nor sorted
    met = words.join(anchored.hint("shuffle_hash"), "_w").select(key, "_g", "_k").distinct()
    pattern = F.concat(F.lit(rf"(?iu)(?<![{WORD}])\Q"), "_k", F.lit(rf"\E(?![{WORD}])"))
    found = met.join(shuffled(df.select(key, text)), key).filter(F.regexp_like(F.col(text), pattern))
    return found.select(key, F.col("_g").alias(group), F.col("_k").alias(keyword)).distinct()


def name_words(c: Column) -> Column:
    """Lower-case words of four or more letters, punctuation read as blanks."""
    words = F.split(F.lower(F.regexp_replace(c, NAME_PUNCTUATION, " ")), " +")
    return F.filter(words, lambda w: F.length(w) > 3)


def name_distance(a: Column, b: Column) -> Column:
    """Mean edit distance from the shorter name's words to their closest word.

    The whole-text edit distance is taken instead when it is smaller.
    """
    wa, wb = name_words(a), name_words(b)
    a_first = F.size(wa) <= F.size(wb)
    short = F.when(a_first, wa).otherwise(wb)
    long = F.when(a_first, wb).otherwise(wa)
    closest = F.transform(
        short, lambda s: F.array_min(F.transform(long, lambda t: F.levenshtein(s, t)))
    )
    total = F.aggregate(closest, F.lit(0.0), lambda acc, d: acc + d)
    usable = F.coalesce((F.size(wa) > 0) & (F.size(wb) > 0), F.lit(False))
    by_word = F.when(usable, F.try_divide(total, F.size(short))).otherwise(F.lit(NO_WORDS_DISTANCE))
    return F.least(by_word, F.levenshtein(a, b))


def name_match(a: Column, b: Column, threshold: float = 1) -> Column:
    """True when two names are closer than ``threshold`` edits per word."""
    return F.coalesce(name_distance(a, b) < threshold, F.lit(False))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the text padded with one blank each side."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))),
            lambda i: F.substring(padded, i, F.lit(n)),
        )
    )
