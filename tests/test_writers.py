from hectara.sources.writers import load_table, upsert_table


def table(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("id", "name", "town").collect()))


def test_upsert_keeps_the_null_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    load_table(spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "x")], "id long, name string, town string"), path, "town")
    upsert_table(spark, path, spark.createDataFrame([(1, "new")], "id long, name string"), "id", "town")
    assert table(spark, path) == [(1, "new", None), (2, "b", None), (3, "c", "x")]
    upsert_table(spark, path, spark.createDataFrame([(4, "d")], "id long, name string"), "id", "town")
    upsert_table(spark, path, spark.createDataFrame([(5, "e", None)], "id long, name string, town string"), "id", "town")
    assert table(spark, path) == [(1, "new", None), (2, "b", None), (3, "c", "x"), (4, "d", None), (5, "e", None)]
