"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into full windows of the longest tier and one rest. Rests are
routed to tiers by size; long windows are opened by long rests and their gaps filled
from the shorter tiers, and what is left of a shorter tier forms windows of that size
where it fills them exactly (such windows are powers of two and take no padding) or
else windows of the next tier. The plan is made over the histogram of lengths, which has
at most one entry per length whatever the corpus size; pieces then look up their
place by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import arrow_map, one_text_per_id, per_task, written

TIERS = (128, 256, 512, 1024)
END_ID = 0
_LONG_SPACE = re.compile(r"\s{2000}")


def read_vocabulary(path_json: str, path_ranks: str) -> tuple[str, bytes]:
    """The vocabulary as the tokenizers library reads it, and as ranks."""
    with open(path_json, encoding="utf-8") as a, open(path_ranks, "rb") as b:
        return a.read(), b.read()


def encoder(vocabulary: tuple[str, bytes], pattern: str):
    """text -> ids of the byte-level vocabulary. The ranks give the same ids as the
    tokenizers library several times faster; texts with huge runs of white space, which
    are beyond the rank encoder's pattern engine, go to the library itself."""
    import base64

    import tiktoken

    text, ranks = vocabulary
    table = {base64.b64decode(k): int(v) for k, v in (line.split() for line in ranks.splitlines() if line)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    slow = []

    def encode(t: str) -> np.ndarray:
        if len(t) > 2000 and _LONG_SPACE.search(t):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_str(text))
            return np.array(slow[0].encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(fast.encode_to_numpy(t, allowed_special="all"), dtype=np.uint32)

    return encode


@dataclass(frozen=True)
class Pattern:
    """Windows alike: the lengths in their order, and how many such windows there are."""

    lengths: tuple[int, ...]
    times: int
    tier: int


def plan_windows(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns that place every length of the histogram exactly as often as it occurs."""
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    sizes = sorted(left)
    longest = tiers[-1]
    plan = []

    def fill(first: int, room: int) -> list[int]:
        chosen, used = [first], Counter({first: 1})
        gap = room - first
        at = bisect.bisect_right(sizes, gap) - 1
        while gap and at >= 0:
            size = sizes[at]
            spare = left[size] - used[size]
            if spare > 0:
                # as many as are there for one window
                n = min(spare, gap // size)
                chosen += [size] * n
                used[size] += n
                gap -= n * size
            at = min(at - 1, bisect.bisect_right(sizes, gap) - 1)
        return chosen

    def take(chosen: list[int], tier: int) -> None:
        used = Counter(chosen)
        times = min(left[k] // n for k, n in used.items())
        plan.append(Pattern(tuple(chosen), times, tier))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                sizes.remove(k)

    while sizes:
        first = sizes[-1]
        own = next(t for t in tiers if t >= first)
        # a shorter window only where it is filled exactly; else a window of the longest tier
        for room in (t for t in tiers if own <= t < longest):
            chosen = fill(first, room)
            if sum(chosen) == room:
                take(chosen, room)
                break
        else:
            take(fill(first, longest), longest)
    return plan


def placements(plan: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: rank from which an entry holds, its copies in a window, its first
    sequence id, the window's tier, and the offsets of its copies."""
    out: dict[int, list] = {}
    seen: Counter = Counter()
    base = 0
    for p in plan:
        at, offsets = 0, {}
        for size in p.lengths:
            offsets.setdefault(size, []).append(at)
            at += size
        for size, starts in offsets.items():
            out.setdefault(size, []).append((seen[size], len(starts), base, p.tier, starts))
            seen[size] += len(starts) * p.times
        base += p.times
    return out


def cut(docs: DataFrame, vocabulary: tuple[str, bytes], pattern: str, window: int) -> DataFrame:
    """Pieces of every document: full windows, then the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @per_task
    def factory():
        encode = encoder(shared.value, pattern)

        def rows(cols):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, text in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist()):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for k, v in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        out[k].append(v)
            return out

        return rows

    return arrow_map(one_text_per_id(docs), factory, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: tuple[str, bytes], pattern: str, tiers: tuple[int, ...] = TIERS, step: int = 64, block: int = 1_000_000) -> DataFrame:
    """One row per piece with its sequence, offset, tier and training step.

    Every id of every document (its ids and one end id) lies in exactly one piece. NULL
    and empty texts are one piece of the end id; repeated rows are packed each for
    itself; an empty table gives no piece. ``step`` sequences make a step; sequences are
    dealt round over the steps, so that each step has its share of every pattern and so
    of tokens, pieces and padding. ``block`` bounds the rows that are ranked together.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, vocabulary, pattern, tiers[-1]))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    plan = plan_windows(histogram, tiers)
    steps = max(1, -(-sum(p.times for p in plan) // step))
    where = spark.sparkContext.broadcast(placements(plan))

    # rank among equal lengths: a rank inside each block, and the rows of the blocks before
    blocks = max(1, -(-max(histogram.values(), default=0) // block), sum(histogram.values()) // 20_000)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        blocked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before.select("length", "block", F.coalesce("before", F.lit(0)).alias("before")), ["length", "block"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("inside") + F.col("before")).alias("rank"))
    )

    @per_task
    def place():
        table = {size: (np.array([e[0] for e in entries]), entries) for size, entries in where.value.items()}

        def rows(cols):
            out = {k: [] for k in ("sequence_id", "offset", "tier")}
            for size, rank in zip(cols["length"].to_pylist(), cols["rank"].to_pylist()):
                froms, entries = table[size]
                first, copies, base, tier, offsets = entries[int(np.searchsorted(froms, rank, side="right")) - 1]
                window, slot = divmod(rank - first, copies)
                out["sequence_id"].append(base + window)
                out["offset"].append(offsets[slot])
                out["tier"].append(tier)
            return out | {c: cols[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}

        return rows

    placed = arrow_map(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long")
    return placed.withColumn("step", F.col("sequence_id") % F.lit(steps))
