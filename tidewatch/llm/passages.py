"""Substring dedup: passages that stand in an earlier document are removed.

Level-wise doubling. At the first level (half the length asked for) every window of the
full length is represented by its *anchor*, the half-length window inside it with the
smallest hash; equal windows have equal anchors, and neighbouring windows share theirs, so
about two in twenty-seven half-length windows are kept. Anchors that stand in one document
alone are dropped. The others are extended to twice the length:

* an anchor together with all windows it represents is a *class* (the words those windows
  span); every member of a class but those in its earliest document is repeated as it stands,
  without a look at single windows;
* only the earliest document of a class, and only where an anchor has several classes, needs its
  windows compared one by one; they are hashed at the full length and joined.

Copies of a passage inside one context cost one row per anchor, not one per word.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import Spans, arrow_map, chunks, join_with_counts, one_text_per_id, signed, words_bytes


def _tag(text: str) -> int:
    """Tells texts under one id apart."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 0x7FFFFF


def pack_mark(tag: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Windows that start at first .. first + more (< 256), in one number."""
    return (tag << 40) | (first << 8) | more


def anchors(spans: Spans, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first and last window start that it represents, text) over a buffer."""
    half = (length + 1) // 2
    reach = length - half + 1  # half-length windows inside a window
    text_of = np.repeat(np.arange(len(spans.first)), spans.stop - spans.first)
    h = spans.windows(half)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < reach:  # all texts together are shorter than one window
        return none.view(np.uint64), none, none, none
    # the smallest hash, of equal ones the leftmost: high bits of the hash, then the position
    places = np.uint64((1 << max(24, len(h).bit_length())) - 1)
    key = (h & ~places) | np.arange(len(h), dtype=np.uint64)
    low, size = key, 1
    while size * 2 <= reach:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    p = np.arange(len(low))
    valid = spans.stop[text_of[p]] - p >= length
    p, at = p[valid], (low[valid] & places).astype(np.int64)
    if not len(p):
        return none.view(np.uint64), none, none, none
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
    first = p[new]
    last = p[np.append(new[1:], len(p)) - 1]
    return h[at[new]], first, last, text_of[first]


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor and place: anchor, words (hash of all its windows), doc_id, mark."""

    def rows(cols):
        ids, texts = cols["doc_id"].to_pylist(), cols["text"].to_pylist()
        out = {k: [] for k in ("anchor", "words", "doc_id", "mark")}
        for a, z in chunks(texts):
            spans = Spans([words_bytes(t) for t in texts[a:z]], (0, 1))
            h, first, last, text = anchors(spans, length)
            tags = np.array([_tag(t) for t in texts[a:z]], dtype=np.int64)
            out["anchor"].append(signed(h))
            out["words"].append(signed(spans.hashes(first, last + length - 1, 1)))
            out["doc_id"].append(np.array(ids[a:z], dtype=np.int64)[text])
            out["mark"].append(pack_mark(tags[text], first - spans.first[text], last - first))
        return {k: np.concatenate(v) for k, v in out.items()} if out["mark"] else None

    return arrow_map(docs, rows, "anchor long, words long, doc_id long, mark long")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Every window of the wanted classes in their earliest documents: its hash, doc_id, mark."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("words").alias("class_words"))

    def rows(cols):
        ids, texts = cols["doc_id"].to_pylist(), cols["text"].to_pylist()
        out = {k: [] for k in ("w1", "w2", "doc_id", "mark")}
        for a, z in chunks(texts):
            spans = Spans([words_bytes(t) for t in texts[a:z]], (0, 1))
            h, first, last, text = anchors(spans, length)
            c = signed(spans.hashes(first, last + length - 1, 1))
            keep = np.zeros(len(h), dtype=bool)
            edges = np.searchsorted(text, np.arange(z - a + 1))
            for i in range(z - a):
                own = slice(edges[i], edges[i + 1])
                classes = set(zip(cols["anchors"][a + i].as_py(), cols["class_words"][a + i].as_py()))
                keep[own] = [x in classes for x in zip(signed(h)[own].tolist(), c[own].tolist())]
            first, last, text = first[keep], last[keep], text[keep]
            sizes = last - first + 1
            p = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            text = np.repeat(text, sizes)
            tags = np.array([_tag(t) for t in texts[a:z]], dtype=np.int64)
            out["w1"].append(signed(spans.hashes(p, p + length - 1, 0)))
            out["w2"].append(signed(spans.hashes(p, p + length - 1, 1)))
            out["doc_id"].append(np.array(ids[a:z], dtype=np.int64)[text])
            out["mark"].append(pack_mark(tags[text], p - spans.first[text], np.zeros(len(p), dtype=np.int64)))
        return {k: np.concatenate(v) for k, v in out.items()} if out["mark"] else None

    return arrow_map(docs.join(lists, "doc_id"), rows, "w1 long, w2 long, doc_id long, mark long")


def _with_id(docs: DataFrame) -> DataFrame:
    """The same plan wherever texts are joined, so that they are shuffled once."""
    return one_text_per_id(docs).filter(F.col("doc_id").isNotNull())


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, mark: windows of ``length`` words that also start in a document with a smaller id."""
    if not 2 <= length <= 256:
        raise ValueError("length must be from 2 to 256 words")
    docs = _with_id(docs)
    places = _occurrences(docs, length)
    # always true, but it keeps both columns wherever classes are used, so that they are shuffled once
    classes = places.groupBy("anchor", "words").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest <= latest")
    # first level: anchors of one document alone do not survive
    alive = (
        classes.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("classes"), F.min("earliest").alias("a"), F.max("earliest").alias("z"))
        .filter("classes > 1 and a < z")
        .select("anchor")
    )
    # twice the length: whole classes first
    later = (
        join_with_counts(places, classes.filter("earliest < latest").select("anchor", "words", "earliest"), ["anchor", "words"])
        .filter("doc_id > earliest")
        .select("doc_id", "mark")
    )
    # then window by window where an anchor stands in several surroundings
    wanted = classes.join(alive, "anchor", "left_semi").select(F.col("earliest").alias("doc_id"), "anchor", "words")
    single = _windows(docs, wanted, length)
    firsts = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest < latest")
    shared = join_with_counts(single, firsts.select("w1", "w2", "earliest"), ["w1", "w2"]).filter("doc_id > earliest").select("doc_id", "mark")
    return later.unionByName(shared)


def covered(n_words: int, marks: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    first = (marks >> 8) & 0xFFFFFFFF
    np.add.at(edge, first, 1)
    np.add.at(edge, first + (marks & 0xFF) + length, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space).

    A word goes if a window of ``length`` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. NULL and empty texts have no words. A
    NULL id is smaller than none and greater than none: its row is kept as it is. Rows that
    repeat an id never remove each other's words, and each row is answered for itself.
    """
    marks = repeated(docs, length).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))

    def rows(cols):
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for i, (doc, text) in enumerate(zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist())):
            words = words_bytes(text)
            gone = 0
            if cols["marks"][i].is_valid:
                m = np.asarray(cols["marks"][i].values, dtype=np.int64)
                m = m[m >> 40 == _tag(text)]
                bad = covered(len(words), m, length)
                gone = int(bad.sum())
                words = [w for w, b in zip(words, bad.tolist()) if not b]
            kept = b" ".join(words)
            for k, v in zip(out, (doc, len(words) + gone, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))):
                out[k].append(v)
        return out

    nameless = one_text_per_id(docs).filter(F.col("doc_id").isNull()).withColumn("marks", F.lit(None).cast("array<long>"))
    both = _with_id(docs).join(marks, "doc_id", "left").unionByName(nameless)
    return arrow_map(both, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
