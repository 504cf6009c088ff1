import pytest
from compare import same
from ledgerloom.plans import answers, changes, front, gates, index, live, lookup, numbers, outputs, reports, rules, shapes, similar, tabs, wording  # noqa: F401
from ledgerloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert not same(spark, name, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
