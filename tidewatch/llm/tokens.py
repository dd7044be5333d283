"""Token counts by pre-token: pieces are counted per distinct pre-token, never as ids.

No piece of the vocabulary holds a space mark after another character, and none holds a
line feed, so a text falls into pre-tokens (a run of spaces and what follows it, or a
line feed and what follows it) that are encoded independently of each other.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import arrow_map, one_text_per_id, per_task

#: After one leading space (the library's own): spaces and what follows, or a line feed and what follows.
_PRE = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> Counter:
    """Pre-token -> times in the text; the empty text has none."""
    return Counter(_PRE.findall(" " + text.replace("▁", " "))) if text else Counter()


def piece_counts(pieces, words: list[str]) -> list[int]:
    """Pieces of each pre-token. A pre-token loses its first space, as the encoder puts
    one before every text; one that starts with a line feed pays that space back."""
    sizes = [len(x) for x in pieces.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)]
    # a lone space is the encoder's empty text, but one piece inside a text
    return [n + (w == " ") - (w[0] == "\n") for n, w in zip(sizes, words)]


def _load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    """The vocabulary file, from the driver; about half a megabyte goes with each task."""
    with open(path, "rb") as f:
        return f.read()


def frequent(docs: DataFrame, model: bytes, size: int, sample_docs: int) -> dict[str, int]:
    """Pieces of the ``size`` pre-tokens found most often in about ``sample_docs`` documents.

    Both bounds are parameters: what is broadcast never grows with the corpus, and
    which pre-tokens are in it changes no result, only how much is shuffled.
    """

    def rows(cols):
        c: Counter = Counter()
        for t in cols["text"].to_pylist():
            c.update(pre_tokens(t))
        return {"word": list(c), "n": list(c.values())}

    n = docs.count()
    share = int(1_000_000 * min(1.0, sample_docs / n)) if n else 0
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text")
    top = arrow_map(sample, rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in top.filter(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(size).select("word").toLocalIterator()]
    return dict(zip(words, piece_counts(_load(model), words))) if words else {}


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, head: int = 200_000, sample_docs: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every document.

    Pieces of the head pre-tokens are counted once and broadcast (at most ``head``
    strings of at most 64 characters). The other pre-tokens go, with their frequency in
    each document, to the task that owns the pre-token; it counts the pieces once and
    gives every document its sum. Empty and NULL texts have 0 tokens; rows that repeat
    an id are counted each for itself.
    """
    spark = docs.sparkSession
    rows_in = one_text_per_id(docs).withColumn("row", F.monotonically_increasing_id())
    known = spark.sparkContext.broadcast(frequent(one_text_per_id(docs), model, head, sample_docs))
    proto = spark.sparkContext.broadcast(model)

    @per_task
    def split():
        have = known.value

        def rows(cols):
            out = {k: [] for k in ("row", "doc_id", "n_bytes", "n", "rest")}
            for row, doc, text in zip(cols["row"].to_pylist(), cols["doc_id"].to_pylist(), cols["text"].to_pylist()):
                total, rest = 0, []
                for w, n in pre_tokens(text).items():
                    k = have.get(w)
                    if k is None:
                        rest.append({"word": w, "times": n})
                    else:
                        total += n * k
                for k, v in zip(out, (row, doc, len(text.encode()), total, rest)):
                    out[k].append(v)
            return out

        return rows

    parts = arrow_map(rows_in.select("row", "doc_id", "text"), split, "row long, doc_id long, n_bytes long, n long, rest array<struct<word:string,times:int>>")
    # the document's own figures travel with its first pre-token, or alone
    own = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).otherwise(0).alias(c) for c in ("n_bytes", "n")]
    tail = parts.select("row", "doc_id", "n_bytes", "n", F.posexplode_outer("rest").alias("pos", "w")).select(
        "row", "doc_id", *own, F.col("w.word").alias("word"), F.col("w.times").alias("times")
    )

    @per_task
    def count():
        pieces = _load(proto.value)
        last = {"word": None, "n": 0}

        def rows(cols):
            words = cols["word"].to_pylist()
            fresh = [w for i, w in enumerate(words) if w is not None and w != (words[i - 1] if i else last["word"])]
            sizes = iter(piece_counts(pieces, fresh) if fresh else [])
            n = []
            for w, times, own_n in zip(words, cols["times"].to_pylist(), cols["n"].to_pylist()):
                if w is not None and w != last["word"]:
                    last["word"], last["n"] = w, next(sizes)
                n.append(own_n + (last["n"] * times if w is not None else 0))
            return {"row": cols["row"], "doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n": n}

        return rows

    by_word = tail.repartition(F.coalesce("word", F.col("row").cast("string"))).sortWithinPartitions("word")
    sums = arrow_map(by_word, count, "row long, doc_id long, n_bytes long, n long")
    return (
        sums.groupBy("row", "doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
