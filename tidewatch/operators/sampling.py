"""Repeatable down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a slice, about.
SLICE_ROWS = 1 << 16


def stratified_cap(df: DataFrame, key: str, row_id: str, max_rows: int, seed: int = 0, slice_bits: int | None = None) -> DataFrame:
    """At most about ``max_rows`` rows, each key keeping its share (at least one row).

    Rows are taken in the order of a hash of ``row_id``. The hash is cut into
    slices: whole slices below a key's quota are kept, whole slices above it are
    dropped, and only the slice at the quota is sorted. A key with a third of all
    rows is therefore never in one task. The number of slices follows the
    counted rows.
    """
    total = df.count()
    slice_bits = slice_bits or max(6, (total // SLICE_ROWS).bit_length())
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    # the top bits of a signed hash order the slices as the hash does
    rows = df.withColumns({"_h": h, "_s": F.shiftright(h, 64 - slice_bits)})
    sizes = rows.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_n"))
    if total <= max_rows:
        return df
    per_key = Window.partitionBy(key)
    along = per_key.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.sum("_n").over(per_key) * F.lit(max_rows) / F.lit(total))
    plan = sizes.select(
        key, "_s",
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"),
        "_n",
        F.greatest(quota, F.lit(1)).alias("_quota"),
    ).filter("_before < _quota")
    kept = rows.join(plan, [key, "_s"])
    rank = F.row_number().over(Window.partitionBy(key, "_s").orderBy("_h", row_id))
    whole = kept.filter("_before + _n <= _quota").select(*df.columns)
    edge = (
        kept.filter("_before + _n > _quota")
        .withColumn("_rn", rank)
        .filter("_before + _rn <= _quota")
        .select(*df.columns)
    )
    return whole.unionByName(edge)


def hash_sample(df: DataFrame, row_id: str, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable row sample: the same rows for the same ids and seed."""
    buckets = 1_000_000
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(buckets)) < int(fraction * buckets))
