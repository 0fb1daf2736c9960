import __spark_entry__ as contract


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["term", "term_count", "doc_count"] and df.count() == 20


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_queries_without_the_training_data_package(monkeypatch):
    """If it cannot be imported, whatever the reason, all other queries are there."""
    import sys

    from corpusloom.plans import registry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpusloom.llm", None)
    assert set(contract.queries()) == set(registry.QUERIES) and set(contract.oracle_sql()) == set(registry.ORACLE_SQL)
