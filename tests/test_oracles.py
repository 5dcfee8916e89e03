"""Every query of the core against its SQL on the smallest tables."""

import pytest
from compare import differences, tables

from gleanery.plans import problems, reference_queries

CASES = [(n, m) for m in (problems, reference_queries) for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_query(spark, sf, con, name, module):
    if name in module.ORACLES:
        assert differences(spark, con, module.QUERIES[name], module.ORACLES[name], sf) is None
    else:
        assert module.QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    for module in (problems, reference_queries):
        assert set(module.ORACLES) <= set(module.QUERIES)
