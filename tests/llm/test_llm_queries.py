"""Every training-data query against its oracle SQL, on the smallest tables."""

import pytest

from dashgrid.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*ORACLE])
def test_equals_oracle(spark, tmp_path, name):
    want, got, missing, extra = compare(spark, connect(DATA), DATA, QUERIES[name], ORACLE[name], str(tmp_path / name))
    assert (got, missing, extra) == (want, 0, 0)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
