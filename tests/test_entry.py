import __spark_entry__ as entry_module


def test_queries_and_sql_agree_on_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 50 and set(sql) <= set(queries)


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert {"source", "system", "wer"} <= set(df.columns)
    assert all(r["sub"] + r["del"] + r["hits"] == r.words for r in df.collect())
