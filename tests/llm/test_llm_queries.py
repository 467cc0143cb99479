import pytest

from larkspur.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as e

    numbers = sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in e.queries()
