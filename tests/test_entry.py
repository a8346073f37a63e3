import __spark_entry__


def test_queries_and_oracles_match():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 39


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert len(rows) == 45 and {r.clone_type for r in rows} == {"type_1", "type_3"}
