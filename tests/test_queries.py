"""Each registered query of the reference's operators against its SQL."""

import pytest

from raterlake.plans.queries import QUERIES, SQL
from tests.compare import SF, duck, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck().execute(SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
