import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from tidewatch.functions import enrich
from tidewatch.sources import tables as tb


def test_flat_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;d;x\n1;20240131;2.5\n2;bad;\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DateType()), T.StructField("x", T.DoubleType())])
    rows = tb.read_flat(spark, str(tmp_path / "t.csv"), tb.FlatFileSpec(schema, ";", True, {"d": "yyyyMMdd"})).collect()
    assert [tuple(r) for r in rows] == [(1, dt.date(2024, 1, 31), 2.5), (2, None, None)]


def test_write_modes(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("extra", T.DoubleType())])
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    change = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    for mode, want in (("append", 4), ("overwrite", 2)):
        spec = tb.TableSpec(str(tmp_path / mode), schema, ("k",), mode)
        tb.write_table(df, spec)
        tb.write_table(change, spec)
        assert spark.read.parquet(spec.path).count() == want
    spec = tb.TableSpec(str(tmp_path / "update"), schema, ("k",), "update", partition_by=("v",))
    tb.write_table(df, spec)
    tb.write_table(change, spec)
    got = {(r["k"], r["v"], r["extra"]) for r in tb.read_table(spark, spec).collect()}
    assert got == {(1, "a", None), (2, "B", None), (3, "c", None)}
    with pytest.raises(ValueError):
        tb.write_table(df, tb.TableSpec(str(tmp_path / "x"), schema, (), "merge"))


def test_publish_skips_known(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, x int")
    path = str(tmp_path / "nodes")
    tb.publish_nodes(nodes, path, "AC")
    tb.publish_nodes(nodes.unionByName(spark.createDataFrame([("c", 3)], "id string, x int")), path, "AC")
    tb.publish_nodes(nodes, path, "PR")
    published = tb.read_published(spark, path, nodes.schema)
    got = {(r["node_type"], r["id"]) for r in published.collect()}
    assert got == {("AC", "a"), ("AC", "b"), ("AC", "c"), ("PR", "a"), ("PR", "b")} and published.count() == 5
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "b")], "id string, source_node string, target_node string")
    tb.publish_edges(edges, str(tmp_path / "edges"), "TX", "AC", "AC")
    tb.publish_edges(edges, str(tmp_path / "edges"), "TX", "AC", "AC")
    schema = edges.withColumns({"source_type": F.lit(""), "target_type": F.lit("")}).schema
    assert [tuple(r) for r in tb.read_published(spark, str(tmp_path / "edges"), schema, "edge_type").collect()] == [("t", "a", "b", "AC", "AC", "TX")]


def test_validate_and_route(spark):
    df = spark.createDataFrame([(1, "OWNER"), (2, "DISPONENT"), (3, None), (None, "OWNER")], "id int, type string")
    ok, bad = tb.validate(df, {"id": F.col("id").isNotNull(), "type": F.col("type") == "OWNER"})
    assert ok.count() == 1 and sorted(r["rejected_by"] for r in bad.collect()) == ["id", "type", "type"]
    parts = tb.route(df, {"o": F.col("type") == "OWNER", "d": "type = 'DISPONENT'"}, "o")
    assert {k: v.count() for k, v in parts.items()} == {"o": 3, "d": 1}


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1)), ("a", 2, dt.datetime(2024, 2, 1)), ("b", 9, dt.datetime(2024, 3, 1))], "k string, v int, tr_job_ts timestamp_ntz")
    got = {r["k"]: r["v"] for r in tb.read_as_of(df, ["k"], to=dt.datetime(2024, 2, 15)).collect()}
    assert got == {"a": 2}
    assert tb.retain(df, "tr_job_ts", 1, dt.date(2024, 3, 1)).count() == 2


def test_row_helpers(spark):
    df = spark.createDataFrame([(1.0, "x", None), (float("nan"), None, 2)], "a double, b string, c int")
    assert [tuple(r) for r in enrich.nan_to_null(df).collect()] == [(1.0, "x", None), (None, None, 2)]
    assert enrich.cast_cols(df, ["c", "zz"], "string").dtypes == [("a", "double"), ("b", "string"), ("c", "string")]


KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("p", T.StringType())])


def _rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.mark.parametrize("step", ["_write_data", "_write_manifest", "_swap"])
def test_update_killed_at_each_step(spark, tmp_path, monkeypatch, step):
    """Before and after each step a reader sees a whole state, and the next update works."""
    spec = tb.TableSpec(str(tmp_path / "t"), KV, ("k",), "update", partition_by=("p",))
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], KV)
    tb.write_table(df, spec)
    table = tb.versioned(spark, spec)
    before = _rows(table)
    change = spark.createDataFrame([(2, "B", "y"), (4, "d", "z/ 1%")], KV)
    plain = getattr(tb.VersionedTable, step)
    for late in (False, True) if step != "_swap" else (False,):
        def die(self, *args):
            if late:
                plain(self, *args)
            raise KeyboardInterrupt

        monkeypatch.setattr(tb.VersionedTable, step, die)
        with pytest.raises(KeyboardInterrupt):
            tb.write_table(change, spec)
        monkeypatch.setattr(tb.VersionedTable, step, plain)
        assert _rows(table) == before
    tb.write_table(change, spec)
    want = [(1, "a", "x"), (2, "B", "y"), (3, "c", None), (4, "d", "z/ 1%")]
    assert _rows(table) == sorted(want, key=str)
    # the folders of x and of the missing value are those of the first state
    first, last = table._manifest(1).folders, table.state().folders
    assert len(set(first) & set(last)) == 2 and len(last) == 4
    # a key that moves to another partition leaves its old one
    tb.write_table(spark.createDataFrame([(4, "D", "x"), (3, "C", "x")], KV), spec)
    assert _rows(table) == sorted([(1, "a", "x"), (2, "B", "y"), (3, "C", "x"), (4, "D", "x")], key=str)
    assert table.vacuum(keep=1) > 0 and table.vacuum(keep=1) == 0
    assert len(_rows(table)) == 4


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that comes second starts again from the other's state; no id is published twice."""
    path = str(tmp_path / "nodes")
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    plain, calls = tb.VersionedTable._write_manifest, []

    def other_first(self, folders):
        calls.append(1)
        if len(calls) == 1:
            tb.publish_nodes(spark.createDataFrame([("b", 9), ("c", 3)], nodes.schema), path, "AC")
        return plain(self, folders)

    monkeypatch.setattr(tb.VersionedTable, "_write_manifest", other_first)
    tb.publish_nodes(nodes, path, "AC")
    got = sorted((r["id"], r["x"]) for r in tb.read_published(spark, path, nodes.schema).collect())
    assert got == [("a", 1), ("b", 9), ("c", 3)] and len(calls) == 3


def test_plain_table_becomes_versioned(spark, tmp_path):
    spec = tb.TableSpec(str(tmp_path / "t"), KV, ("k",), "overwrite", partition_by=("p",))
    tb.write_table(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], KV), spec)
    tb.write_table(spark.createDataFrame([(2, "B", "y")], KV), tb.TableSpec(spec.path, KV, ("k",), "update", partition_by=("p",)))
    tb.write_table(spark.createDataFrame([(5, "e", "x")], KV), tb.TableSpec(spec.path, KV, ("k",), "append", partition_by=("p",)))
    assert _rows(tb.versioned(spark, spec)) == [(1, "a", "x"), (2, "B", "y"), (5, "e", "x")]
    tb.write_table(spark.createDataFrame([(7, "g", "x")], KV), spec)
    assert _rows(tb.versioned(spark, spec)) == [(7, "g", "x")]
