"""Every registered query under aggregates: pruned columns must not change or break it."""

import pytest
from pyspark.sql import functions as F

from emulsa.llm import queries as registered


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_aggregates(name, spark, sf):
    got = registered.queries()[name](spark, sf)
    n = got.count()
    assert n > 0
    key = "sequence_id" if "sequence_id" in got.columns else got.columns[0]
    assert got.groupBy(key).agg(F.count("*").alias("rows")).agg(F.sum("rows")).first()[0] == n
