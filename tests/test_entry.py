import __spark_entry__ as e


def test_contract(spark):
    queries, statements = e.queries(), e.oracle_sql()
    assert set(statements) <= set(queries)
    assert e.entry(spark).count() > 0
    for sql in statements.values():
        assert sql.strip().upper().startswith(("SELECT", "WITH"))
