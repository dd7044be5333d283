"""Quality of texts by a factorisation machine.

Features are hashed words, structure statistics in steps, and the size that the table states.
The score of a text with features x is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the last sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so it takes time
linear in the features. Features are made where the texts lie; the fit runs in one task over
a bounded sample of them, and its arrays come back.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import BATCH_ROWS, chunks, fitted
from tidewatch.llm.vectors import batch_map

BITS = 16
RANK = 8
#: The first buckets are those of structure and size.
OWN = 1024
#: Steps of one statistic, at most.
STEPS = 32
#: Words that a task remembers the buckets of.
REMEMBERED = 200_000

STATISTICS = (
    "words", "mean word", "longest word", "distinct words", "most frequent word", "capitals", "capital words", "digits",
    "marks", "marks at word ends", "kinds of marks", "line length", "repeated lines", "short lines", "stated size",
)


# ---- features -------------------------------------------------------------------


def _step(share: float) -> int:
    """A share from 0 to 1 in steps that are narrow near 0."""
    return min(STEPS - 1, int(round((STEPS - 1) * share**0.5)))


def _log_step(size: float) -> int:
    return min(STEPS - 1, int(2 * np.log2(1 + max(0.0, size))))


def statistics(text: str, stated: int | None) -> list[int]:
    """The step of every statistic, in the order of ``STATISTICS``."""
    raw = text.split()
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = np.bincount(codes, minlength=256)
    seen = max(1, len(codes))
    marks = np.r_[kinds[33:48], kinds[58:65], kinds[91:97], kinds[123:127]]
    n = max(1, len(raw))
    counted: dict[str, int] = {}
    for w in raw:
        counted[w] = counted.get(w, 0) + 1
    capital = sum(k for w, k in counted.items() if len(w) > 1 and w.isupper())
    ended = sum(k for w, k in counted.items() if not w[-1].isalnum())
    return [
        _log_step(len(raw)), _log_step(sum(map(len, raw)) / n), _log_step(max(map(len, counted), default=0)),
        _step(len(counted) / n), _step(max(counted.values(), default=0) / n), _step(kinds[65:91].sum() / seen),
        _step(capital / n), _step(kinds[48:58].sum() / seen), _step(marks.sum() / seen), _step(ended / n),
        int(min(STEPS - 1, (marks > 0).sum())), _log_step(n / max(1, len(lines))),
        _step(1 - len(set(lines)) / max(1, len(lines))), _step(sum(len(line) < 20 for line in lines) / max(1, len(lines))),
        0 if stated is None else _log_step(stated),
    ]


class Words(dict):
    """The bucket of a word: its crc32, in lower case and without what is no letter or digit at its ends."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        low = word.lower()
        a, z = 0, len(low)
        while a < z and not low[a].isalnum():
            a += 1
        while z > a and not low[z - 1].isalnum():
            z -= 1
        at = self[word] = OWN + zlib.crc32((low[a:z] or low).encode("utf-8", "surrogatepass")) % ((1 << BITS) - OWN)
        return at


def features(text: str, stated: int | None, buckets: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text: every statistic's step counts 1, and words share a length of 1."""
    steps = [STEPS * i + s for i, s in enumerate(statistics(text, stated))]
    at, n = np.unique(np.array([buckets[w] for w in text.split()], dtype=np.int64), return_counts=True)
    value = np.sqrt(n)
    value = value / max(1e-12, np.sqrt((value * value).sum()))
    return np.concatenate([np.array(steps, dtype=np.int64), at]), np.concatenate([np.ones(len(steps)), value])


# ---- the machine ----------------------------------------------------------------


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; every text has features, which begin at ``starts``."""
        scaled = self.factors[at] * value[:, None]
        whole = np.add.reduceat(scaled, starts, axis=0)
        own = np.add.reduceat((scaled * scaled).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[at] * value, starts) + 0.5 * ((whole * whole).sum(axis=1) - own)


def chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.05, shrink: float = 1e-5, seed: int = 3) -> Machine:
    """Logistic loss by AdaGrad over small batches, each label weighted."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(1 << BITS), rng.normal(0, 0.02, (1 << BITS, RANK)))
    if not len(labels):
        return machine
    share = float((weights * labels).sum() / weights.sum())
    machine.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    seen_linear, seen_factors = np.full(1 << BITS, 1e-3), np.full((1 << BITS, RANK), 1e-3)
    weights = weights / weights.mean()
    for _ in range(rounds):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at, value = (np.concatenate([rows[k][j] for k in some]) for j in (0, 1))
            size = np.array([len(rows[k][0]) for k in some])
            starts = np.cumsum(size) - size
            off = np.repeat((chance(machine.raw(at, value, starts)) - labels[some]) * weights[some] / len(some), size)
            scaled = machine.factors[at] * value[:, None]
            whole = np.repeat(np.add.reduceat(scaled, starts, axis=0), size, axis=0)
            used, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, weights=off * value) + shrink * machine.linear[used]
            each = (off * value)[:, None] * (whole - scaled)
            h = np.stack([np.bincount(back, weights=each[:, f]) for f in range(RANK)], axis=1) + shrink * machine.factors[used]
            seen_linear[used] += g * g
            seen_factors[used] += h * h
            machine.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            machine.factors[used] -= rate * h / np.sqrt(seen_factors[used])
            machine.bias -= rate * float(off[starts].sum())
    return machine


# ---- on Spark -------------------------------------------------------------------


def held_out() -> F.Column:
    """Documents whose crc32 of the id leaves 2 modulo 4; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _stated(docs: DataFrame):
    kind = docs.schema["n_chars"].dataType.typeName() if "n_chars" in docs.columns else ""
    return F.col("n_chars").cast("long") if kind in ("byte", "short", "integer", "long") else F.lit(None).cast("long")


def featured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the features (at, value) of each row's whole text."""
    schema = StructType([*[docs.schema[c] for c in carry], *StructType.fromDDL("at array<int>, value array<double>").fields])

    def read(batches):
        buckets = Words()
        for batch in batches:
            text, stated = batch.column(len(carry)).to_pylist(), batch.column(len(carry) + 1).to_pylist()
            got = [features(t or "", s, buckets) for t, s in zip(text, stated)]
            yield {c: batch.column(i) for i, c in enumerate(carry)} | {"at": [a.astype(np.int32) for a, _ in got], "value": [v for _, v in got]}

    return batch_map(docs.select(*carry, "text", _stated(docs).alias("_stated")), read, schema, BATCH_ROWS)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """quality, weight and features of at most ``bound`` labelled documents of each label, drawn by a hash.

    A document with contradicting labels teaches nothing. The weight says how many documents
    of its label one stands for.
    """
    per_id = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    sure = per_id.agg(F.min(label).cast("int").alias("quality"), F.max(label).cast("int").alias("_most")).filter("quality = _most").drop("_most")
    draw = F.xxhash64("doc_id", F.lit("draw"))
    ids = docs.select("doc_id").distinct().join(sure, "doc_id")
    counts = {r["quality"]: r["n"] for r in ids.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for q, n in sorted(counts.items()):
        some = ids.filter(F.col("quality") == q).orderBy(draw, "doc_id").limit(bound).withColumn("weight", F.lit(n / min(n, bound)))
        drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        drawn = ids.withColumn("weight", F.lit(1.0)).limit(0)
    # at most two times ``bound`` ids; of rows that repeat an id, one text is learned
    texts = docs.select("doc_id", "text", _stated(docs).alias("n_chars")).join(F.broadcast(drawn), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return featured(texts.withColumn("_one", one).filter("_one = 1"), ["doc_id", "quality", "weight"])


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 2000) -> Machine:
    """A machine fitted in one task on the features of at most ``bound`` documents of each label."""

    def arrays_of(table):
        rows = [(np.array(a, dtype=np.int64), np.array(v)) for *_, a, v in table]
        m = fit(rows, np.array([r[1] for r in table], dtype=float), np.array([r[2] for r in table], dtype=float))
        return {"bias": np.array(m.bias), "linear": m.linear, "factors": m.factors.astype(np.float32)}

    arrays = fitted(training_rows(docs, labels, label, bound), arrays_of)
    return Machine(float(arrays["bias"]), arrays["linear"], arrays["factors"].astype(np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text and its stated size."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def read(batches):
        m, buckets = Machine(*shared.value), Words()
        for batch in batches:
            text, stated = [t or "" for t in batch.column(2).to_pylist()], batch.column(3).to_pylist()
            found = []
            for a, z in chunks(text, 2_000_000):
                got = [features(t, s, buckets) for t, s in zip(text[a:z], stated[a:z])]
                size = np.array([len(at) for at, _ in got])
                found.append(chance(m.raw(np.concatenate([at for at, _ in got]), np.concatenate([v for _, v in got]), np.cumsum(size) - size)))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    rows = docs.select("doc_id", held_out().alias("held_out"), "text", _stated(docs).alias("_stated"))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("held_out boolean, score double, predicted int").fields])
    return batch_map(rows, read, schema, BATCH_ROWS)


def judge(docs: DataFrame, labels: DataFrame, bound: int = 2000, threshold: float = 0.7) -> DataFrame:
    """Learn ``labels.quality`` and score all documents.

    Only labels of ids whose crc32 modulo 4 is not 2 teach. A NULL text is empty and is scored
    by its structure, as empty ones are. Repeated ids give a row each. Labels that are NULL or
    neither 0 nor 1 teach nothing; without any usable label every score is near one half.
    """
    return score(docs, learned(docs, labels, bound=bound), threshold)
