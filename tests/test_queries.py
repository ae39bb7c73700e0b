import numpy as np
import pytest
from oracle import database, rows

from sparkloom.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    assert rows(got) == rows(database(data).sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", ["reduce_by_key", "zip_with_index", "cogroup", "group_by_key", "subtract_dups"])
@pytest.mark.parametrize("partitions", ["1", "17"])
def test_result_does_not_depend_on_partitions(spark, data, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(queries.QUERIES[name](spark, data).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == rows(queries.QUERIES[name](spark, data).toPandas())


def test_zip_partitions_takes_rows_in_any_order(spark, data, monkeypatch):
    """Between executors, a shuffle's rows come in another order at each evaluation; here they are mixed anew."""
    deal = queries.O.partition_by

    def mixed(*args):
        dealt = deal(*args)
        return dealt.mapInPandas(lambda it: (b.sample(frac=1, random_state=np.random.default_rng()) for b in it), dealt.schema)

    monkeypatch.setattr(queries.O, "partition_by", mixed)
    got = queries.QUERIES["zip_partitions"](spark, data).toPandas()
    assert rows(got) == rows(database(data).sql(queries.SQL["zip_partitions"]).df())


def test_filter_and_columns_reach_the_scan(spark, data):
    plan = queries.QUERIES["filter_pred"](spark, data)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
