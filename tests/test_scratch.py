from tessera.scratch import row_keys


def test_row_keys_beside_a_metadata_column(spark, tmp_path):
    spark.range(50).selectExpr("id % 3 as id", "'x' as _metadata", "id as n").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for some in (df, df.select("id", "_metadata"), df.where("n > 10"), df.repartition(2)):
        keyed, names = row_keys(some)
        rows = keyed.collect()
        assert keyed.columns == [*some.columns, *names] and len(rows) == some.count()
        assert len({tuple(r[n] for n in names) for r in rows}) == len(rows) and {r._metadata for r in rows} == {"x"}
    assert row_keys(df.limit(0))[0].collect() == []
