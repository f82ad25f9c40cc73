"""Every query that SQL can express, against that SQL, at two sizes."""

import pytest

from mediaflow.jobs.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    for sf in ("sf0.001", "sf0.01"):
        compare(spark, name, QUERIES[name], ORACLE_SQL[name], f"/root/testdata/{sf}")
