"""Every core query against its oracle SQL, on the smallest tables."""

import pytest

from dashgrid.plans import evaluation, recognition, series
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
MODULES = (series, evaluation, recognition)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in MODULES for k, f in m.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", [*ORACLE])
def test_equals_oracle(spark, duck, tmp_path, name):
    want, got, missing, extra = compare(spark, duck, DATA, QUERIES[name], ORACLE[name], str(tmp_path / name))
    assert (got, missing, extra) == (want, 0, 0)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
