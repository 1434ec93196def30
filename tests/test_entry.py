import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "n_hits", "n_artifacts"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
