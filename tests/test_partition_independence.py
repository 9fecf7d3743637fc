"""Results do not depend on the shuffle partition count (SURVEY 5(d))."""

import pytest

import __spark_entry__ as E
from conftest import SF001

NAMES = ["dedup_global", "dedup_windowed", "split_stratified", "auroc_ovr", "leak_counts",
         "cross_split_similar", "renumber"]


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_with_1_and_7_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(q(spark, SF001))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = _rows(q(spark, SF001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == seven
