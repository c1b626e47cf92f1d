"""Look-ups by key: what they find, and what they do not read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from noticelake.sources.lookup import BUCKET, KEY, KeyedTable


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _files_read(df):
    """Files that the scan is left with after folders are pruned."""
    df.collect()
    scans, found = [df._jdf.queryExecution().executedPlan()], []
    while scans:
        node = scans.pop()
        if node.metrics().contains("numFiles"):
            found.append(node.metrics().get("numFiles").get().value())
        scans += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            scans.append(node.executedPlan())
    return found


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source")
    held = KeyedTable(spark, str(tmp_path_factory.mktemp("keyed")), "doc_id long, lang string, source string", "doc_id", buckets=16)
    held.write(rows)
    return rows, held


def test_one_key_reads_one_folder(pages):
    rows, held = pages
    wanted = rows.agg(F.max("doc_id")).first()[0]
    got = held.get(wanted)
    assert got.collect() == rows.where(F.col("doc_id") == wanted).collect() and got.columns == rows.columns
    told = _plan(got)
    assert f"EqualTo({KEY},{wanted})" in told and BUCKET in next(line for line in told.splitlines() if line.startswith("PartitionFilters")), told
    files, every = _files_read(got), _files_read(held.read())
    assert files and every and files[0] * 8 <= every[0], (files, every)
    assert held.get(-5).collect() == [] and held.get(None).collect() == []


def test_many_keys(pages):
    rows, held = pages
    asked = rows.where("doc_id % 7 = 0").select(F.col("doc_id").alias("k"))
    got = held.get_many(asked.unionByName(asked).unionByName(asked.selectExpr("-k - 1 as k")), "k")
    assert sorted(got.collect()) == sorted(rows.where("doc_id % 7 = 0").collect())
    assert held.get_many(asked.limit(0), "k").collect() == []


def test_files_are_sorted_and_carry_bloom_filters(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path), "k string, n long", "k", buckets=2)
    held.write(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("n")))
    files = str(tmp_path / "data" / "*" / "*" / "*.parquet")
    found = duckdb.sql(f"select bloom_filter_offset, bloom_filter_length from parquet_metadata('{files}') where path_in_schema = '{KEY}'").fetchall()
    assert found and all(offset is not None and length > 0 for offset, length in found)
    rows = duckdb.sql(f"select filename, {KEY} as k, file_row_number as n from read_parquet('{files}', filename=true, file_row_number=true) order by filename, n").fetchall()
    assert all(a[0] != b[0] or a[1] <= b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_folded_keys_repeats_nulls_and_replacement(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path), "email string, n int, `odd.name` string", "email", buckets=4, folded=True)
    assert held.read().collect() == [] and held.get("a@x").collect() == []
    first = held.write(spark.createDataFrame([("A@x ", 1), ("a@X", 2), (None, 3), ("", 4), ("b", 5)], "email string, n int"))
    assert {r.n for r in held.get(" a@x").collect()} == {1, 2} and {r.n for r in held.get("").collect()} == {4}
    assert held.get(None).collect() == [] and {r.n for r in held.read().collect()} == {1, 2, 3, 4, 5}
    asked = spark.createDataFrame([("B",), (None,), ("zz",)], "`who.is` string")
    assert [(r.n, r["odd.name"]) for r in held.get_many(asked, "who.is").collect()] == [(5, None)]
    held.write(spark.createDataFrame([("a@x", 9, "o")], "email string, n int, `odd.name` string"))
    assert [r.n for r in held.get("A@X").collect()] == [9] and {r.n for r in held.get("a@x", first).collect()} == {1, 2}
    held.write(held.read().limit(0))
    assert held.read().collect() == [] and held.get("a@x").collect() == []


def test_a_hot_key_is_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = KeyedTable(spark, str(tmp_path), "k long, n long", "k", buckets=2)
        held.write(spark.range(30_000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = held.get(-1)
    assert got.count() == 20_000
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
