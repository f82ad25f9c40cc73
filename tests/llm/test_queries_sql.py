"""Every query of the subpackage that SQL can express, against that SQL."""

import pytest

from mediaflow.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], f"/root/testdata/{sf}") > 0
