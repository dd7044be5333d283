"""Reading, checking, routing and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.sources.versions import State, VersionedTable

JOB_TS = "tr_job_ts"


@dataclass(frozen=True)
class TableSpec:
    """A named table: schema, key, ingestion mode and partitioning."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    mode: str = "append"  # append | update | overwrite
    time_col: str | None = None
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class FlatFileSpec:
    """A delimited file: declared schema, and formats of its date columns."""

    schema: T.StructType
    delimiter: str = ","
    header: bool = True
    date_formats: Mapping[str, str] | None = None


def read_flat(spark: SparkSession, path: str, spec: FlatFileSpec) -> DataFrame:
    """Flat file with a declared schema; each date column may have its own format."""
    formats = dict(spec.date_formats or {})
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in formats else f.dataType) for f in spec.schema]
    )
    df = spark.read.schema(raw).csv(path, header=spec.header, sep=spec.delimiter)
    cols = []
    for f in spec.schema:
        c = F.col(f.name)
        if f.name in formats:
            c = F.try_to_timestamp(c, F.lit(formats[f.name])).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _predicate(p: Column | str) -> Column:
    return F.expr(p) if isinstance(p, str) else p


def route(df: DataFrame, targets: Mapping[str, Column | str], default: str | None = None) -> dict[str, DataFrame]:
    """Split rows by predicate; rows that match none go to ``default``."""
    out = {name: df.filter(_predicate(p)) for name, p in targets.items()}
    if default is not None:
        hit = F.lit(False)
        for p in targets.values():
            hit = hit | F.coalesce(_predicate(p), F.lit(False))
        rest = df.filter(~hit)
        out[default] = out[default].unionByName(rest) if default in out else rest
    return out


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, and the rejected ones with the failed columns."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in rules.items()])
    )
    good = F.lit(True)
    for p in rules.values():
        good = good & F.coalesce(p, F.lit(False))
    return df.filter(good), df.filter(~good).withColumn("rejected_by", F.array_join(failed, ","))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order; missing ones become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def retain(df: DataFrame, time_col: str, months: int, as_of) -> DataFrame:
    """Rows of the last ``months`` months before ``as_of``."""
    dtype = df.schema[time_col].dataType
    start = F.add_months(F.lit(as_of).cast("date"), -months).cast(dtype)
    return df.filter(F.col(time_col) >= start)


def read_as_of(
    df: DataFrame, keys: Sequence[str] = (), job_ts: str = JOB_TS, frm=None, to=None
) -> DataFrame:
    """Rows loaded in a job-time range; with ``keys`` only the latest per key.

    The latest row is a decomposable ``max_by``, so a key with very many versions
    is reduced before the shuffle.
    """
    dtype = df.schema[job_ts].dataType
    if frm is not None:
        df = df.filter(F.col(job_ts) >= F.lit(frm).cast(dtype))
    if to is not None:
        df = df.filter(F.col(job_ts) <= F.lit(to).cast(dtype))
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[F.col(c).cast("string") for c in rest])
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(job_ts), tie)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns)


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed keys replaced, new keys added, the others kept.

    NULL keys are keys like others. Of several changes to one key one is taken, by the
    order of all its values, whatever order the rows come in.
    """
    one = _one_of_each(changes, keys)
    marked = one.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return existing.join(marked, same, "left_anti").unionByName(one)


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def _one_of_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, chosen by the rows' values and so always the same."""
    rest = [c for c in df.columns if c not in keys]
    # the values themselves where Spark orders them; maps by their JSON
    order = F.struct(*[F.to_json(c) if _has_map(df.schema[c].dataType) else F.col(c) for c in rest]) if rest else F.lit(1)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_row"))
    return best.select("_row.*")


def versioned(spark: SparkSession, spec: TableSpec) -> VersionedTable:
    return VersionedTable(spark, spec.path, spec.schema, spec.partition_by)


def read_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """The latest whole state of a table."""
    kept = versioned(spark, spec)
    return kept.read() if kept.exists() else spark.read.schema(spec.schema).parquet(spec.path)


def write_table(df: DataFrame, spec: TableSpec) -> None:
    """Append, overwrite or key-upsert a parquet table with the declared schema.

    A table becomes versioned by its first update (see ``VersionedTable``): from then on every mode
    swaps whole states in one step, an update writes only the folders that hold changed keys, and
    the table is read with ``read_table``. Before, it is a plain parquet folder.
    """
    out = conform(df, spec.schema)
    spark = df.sparkSession
    if spec.mode not in ("append", "overwrite", "update"):
        raise ValueError(f"unknown mode {spec.mode!r}")
    kept = versioned(spark, spec)
    if not kept.exists() and spec.mode != "update":
        if spec.partition_by:
            # AQE splits a partition value that holds a large share of the rows
            out = out.hint("rebalance", *spec.partition_by)
        writer = out.write.partitionBy(*spec.partition_by) if spec.partition_by else out.write
        writer.mode(spec.mode).parquet(spec.path)
        return
    if spec.mode == "append":
        kept.append(out)
    elif spec.mode == "overwrite":
        kept.overwrite(out)
    else:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(spec.path)
        if not kept.exists() and fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            kept.adopt(spark.read.schema(spec.schema).parquet(spec.path))
        kept.merge(out, spec.keys, upsert)


def publish_nodes(df: DataFrame, path: str, node_type: str) -> None:
    """Append nodes of a type, one row per id; ids already there are skipped."""
    _publish(df, f"{path.rstrip('/')}/node_type={node_type}", ["id"])


def publish_edges(df: DataFrame, path: str, edge_type: str, src: str, dst: str) -> None:
    """Append edges of a type between two node types, one row per (id, ends)."""
    keyed = df.withColumns({"source_type": F.lit(src), "target_type": F.lit(dst)})
    _publish(keyed, f"{path.rstrip('/')}/edge_type={edge_type}", ["id", "source_node", "target_node"])


def _publish(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Adds the rows of new keys in one step; a run that comes second sees what the first one added."""
    table = VersionedTable(df.sparkSession, path, df.schema)
    one = _one_of_each(df, keys)

    def change(state: State):
        return (one.join(table.read(state).select(*keys), list(keys), "left_anti") if state.folders else one), state.folders

    table.commit(change)


def read_published(spark: SparkSession, path: str, schema: T.StructType, type_col: str = "node_type") -> DataFrame:
    """All published rows under a path, with their type; ``schema`` as they were published."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{type_col}=*"))
    out = None
    for status in found or []:
        name = status.getPath().getName()
        part = VersionedTable(spark, f"{path.rstrip('/')}/{name}", schema).read().withColumn(type_col, F.lit(name.split("=", 1)[1]))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema).withColumn(type_col, F.lit(None).cast("string"))
