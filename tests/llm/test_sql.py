"""The pipeline operators that SQL expresses against their SQL, on the smallest tables."""

import pytest

from gazetteer.llm import queries

from ..test_registry import DIR, duck, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    found = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(normal, r)) for r in found.fetchall())
