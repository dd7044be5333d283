"""Helpers shared by the operators: Arrow maps, shared folder, exact hashes of spans of words."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.session import checkpoint_folder


#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow over plain columns: ``rows(dict of column -> list)`` gives a dict of columns.

    ``rows`` may also be a factory marked by ``per_task``: it is then called once in
    each task and its result is used for every batch.
    """
    # rows hold whole texts: small batches bound what a task and its worker hold at once
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, out = df.columns, to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def column(values, kind):
            if isinstance(values, pa.Array):
                return values if values.type == kind else values.cast(kind)
            return pa.array(values, type=kind)

        fn = rows() if getattr(rows, "per_task", False) else rows
        for batch in batches:
            got = fn({n: batch.column(i) for i, n in enumerate(names)})
            if got is not None:
                yield pa.RecordBatch.from_arrays([column(got[f.name], f.type) for f in out], schema=out)
            del got, batch
        pa.default_memory_pool().release_unused()  # the worker outlives the task

    return df.mapInArrow(run, schema)


def per_task(factory: Callable) -> Callable:
    factory.per_task = True
    return factory


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Arrays that ``fit`` makes of all rows of a bounded sample, in one task; only they come to the driver.

    Rows reach ``fit`` as tuples in the order of their values.
    """
    n = len(sample.columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(n)])]
        rows.sort(key=lambda r: [(v is not None, v) for v in r])
        out = io.BytesIO()
        np.savez(out, **fit(rows))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["arrays"])

    found = sample.repartition(1).mapInArrow(run, "arrays binary").first()
    if found is None:  # Spark runs no task over a sample that it knows to be empty
        return fit([])
    arrays = np.load(io.BytesIO(bytes(found["arrays"])))
    return {k: arrays[k] for k in arrays.files}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    base = checkpoint_folder(spark)
    return f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_with_counts(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table that was aggregated by the same (integer) keys.

    Joined on keys of its own, so that both sides are shuffled for the join: only then does
    Spark split the rows of a hot key over tasks.
    """
    own = [F.col(k).bitwiseXOR(F.lit(1)).alias(f"_{k}") for k in keys]
    rest = [c for c in counts.columns if c not in keys]
    joined = rows.select("*", *own).join(counts.select(*rest, *own), [f"_{k}" for k in keys])
    return joined.drop(*[f"_{k}" for k in keys])


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and ``row``: a whole row as one column, which operators read the text from and pass on untouched."""
    return docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def is_carried(docs: DataFrame) -> bool:
    return docs.columns == ["doc_id", "row"]


def texts_of(cols: dict) -> list[str]:
    """The texts of a batch of plain or carried rows; NULL is empty."""
    texts = cols["text"] if "text" in cols else cols["row"].field("text")
    return [t or "" for t in texts.to_pylist()]


def carry_schema(docs: DataFrame, more: str) -> StructType:
    """The fields of ``more`` (DDL), and ``row`` where docs carry their rows."""
    fields = list(StructType.fromDDL(more).fields)
    return StructType(fields + ([docs.schema["row"]] if is_carried(docs) else []))


def one_text_per_id(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and further columns, whatever else the table holds."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


# ---- spans of words -------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A span has two hashes, polynomials over its bytes (words joined by one space): one modulo 2^64, which is fast, and
#: one modulo this prime, for which unequal spans of n bytes agree with probability n / PRIME at most, whatever they hold.
PRIME = (1 << 61) - 1
_P, _31, _30, _LOW31, _LOW30 = (np.uint64(x) for x in (PRIME, 31, 30, (1 << 31) - 1, (1 << 30) - 1))
# Two odd numbers below the prime, taken at random once.
_BASES = (0x0B1E5A7C93D4F26B, 0x16C80F3D72A95E41)
_BLOCK = 1 << 14
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_power_cache: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any uint64 modulo the prime."""
    x = (x >> np.uint64(61)) + (x & _P)
    return np.minimum(x, x - _P)  # below the prime the difference wraps round and is larger


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits; in blocks that stay in the cache."""
    out = np.empty(len(a), dtype=np.uint64)
    for i in range(0, len(a), _BLOCK):
        x, y = a[i : i + _BLOCK], b[i : i + _BLOCK]
        xh, xl, yh, yl = x >> _31, x & _LOW31, y >> _31, y & _LOW31
        middle = xh * yl
        middle += xl * yh
        xh *= yh
        xh += xh
        xl *= yl
        xh += xl
        xh += middle >> _30
        middle &= _LOW30
        middle <<= _31
        xh += middle
        out[i : i + _BLOCK] = _reduced(xh)
    return out


def _powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** i (or its inverse) for i < n, modulo 2^64 (0) or the prime (1); doubled as needed."""
    have = _power_cache.get((which, inverse), np.ones(1, dtype=np.uint64))
    modulus = PRIME if which else 1 << 64
    base = pow(_BASES[which], -1, modulus) if inverse else _BASES[which]
    while len(have) < n:
        step = np.full(len(have), pow(base, len(have), modulus), dtype=np.uint64)
        have = np.concatenate([have, _times(have, step) if which else have * step])
    _power_cache[which, inverse] = have
    return have[:n]


def _sums_at(data: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """The polynomial modulo the prime of the first k bytes, for every k of sorted ``places``.

    Halves of the powers are summed apart; with bytes of 9 bits a block's sums stay below 2^64, and
    only those asked for are reduced.
    """
    powers = _powers(1, len(data))
    out = [np.zeros(len(p), dtype=np.uint64) for p in places]
    before = np.zeros(1, dtype=np.uint64)
    for i in range(0, len(data), _BLOCK):
        code = data[i : i + _BLOCK] + np.uint64(1)
        own = powers[i : i + _BLOCK]
        high, low = np.cumsum(code * (own >> _31)), np.cumsum(code * (own & _LOW31))

        def upto(k: np.ndarray) -> np.ndarray:
            h = _reduced(high[k])
            # times 2^31: a rotation of 61 bits
            return _reduced((((h & _LOW30) << _31) | (h >> _30)) + _reduced(low[k]) + before)

        for place, values in zip(places, out):
            a, z = np.searchsorted(place, (i, i + len(code)), side="right")
            values[a:z] = upto(place[a:z] - i - 1)
        before = upto(np.array([len(code) - 1]))
    return out


def words_bytes(text: str) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


class Spans:
    """Hashes of spans of words: equal words give equal hashes, wherever they stand.

    A polynomial over the bytes is summed once; the hash of a span is a difference of two
    sums, so it costs the same at every length. Several texts may lie in one buffer; ``first``
    and ``stop`` say which words are a text's.
    """

    def __init__(self, texts: list[list[bytes]], which: tuple[int, ...] = (0,)):
        data = np.frombuffer(b" ".join(b" ".join(t) for t in texts if t), dtype=np.uint8)
        gaps = np.flatnonzero(data == 32)
        some = np.ones(1 if len(data) else 0, dtype=np.int64)
        self.start = np.concatenate((some * 0, gaps + 1))
        self.end = np.concatenate((gaps, some * len(data)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.stop = self.first + sizes
        self.n, self.bytes = len(self.start), len(data)
        # for each hash, the sums up to every word's start and end
        self.sums = {}
        if 0 in which:
            s = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[data] * _powers(0, len(data)), out=s[1:])
            self.sums[0] = s[self.start], s[self.end]
        if 1 in which:
            self.sums[1] = tuple(_sums_at(data, self.start, self.end))

    def hashes(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words first..last (inclusive) for each pair, as uint64."""
        (starts, ends), powers = self.sums[which], _powers(which, self.bytes + 1, True)
        out = np.empty(len(first), dtype=np.uint64)
        for i in range(0, len(first), _BLOCK):
            a, z = first[i : i + _BLOCK], last[i : i + _BLOCK]
            back = powers[self.start[a]]
            size = (self.end[z] - self.start[a]).astype(np.uint64)
            if which:
                out[i : i + _BLOCK] = _times(_reduced(ends[z] + (_P - starts[a])), back) + size * np.uint64(_BASES[1])
            else:
                out[i : i + _BLOCK] = mix((ends[z] - starts[a]) * back + size)
        return out

    def windows(self, length: int, which: int = 0) -> np.ndarray:
        """Hash of every window of ``length`` words by its start, over the borders of texts too."""
        p = np.arange(max(0, self.n - length + 1))
        return self.hashes(p, p + length - 1, which)


def chunks(texts: list, size: int = 1_000_000):
    """Ranges of texts of about ``size`` characters together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
