"""Every registered query of the base library, against its SQL or for rows."""

import pytest

from quarry import queries, queries_upkeep  # noqa: F401

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_gives_rows(spark, name):
    assert queries.queries()[name](spark, SF).limit(1).count() == 1
