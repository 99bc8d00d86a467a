"""Files made of the rows of small tables are made in many tasks."""

import pytest

from cartolyte.plans import binaries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key", [("part", "p_partkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")])
def test_rows_are_spread(spark, name, key):
    rows = binaries._rows(spark, SF, name, key)
    assert rows.rdd.getNumPartitions() >= 16 and rows.count() == binaries._table(spark, SF, name).count()


def test_descriptors_are_made_in_many_tasks(spark):
    assert binaries._prefabs(spark, SF).rdd.getNumPartitions() >= 16
