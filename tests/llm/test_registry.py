from ridelens.llm import registry


def test_statements_are_sql():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert [name for name, sql in registry.SQL.items() if not isinstance(sql, str)] == []
