"""Binding by position against a plain zip."""

import pytest
from pyspark.sql import functions as F

from cargoscope.operators.bind import bind_columns, numbered


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_rows_are_bound_in_their_order(spark, n):
    # Different partitionings; the order of each frame is that of its own sort.
    left = spark.range(n).select((F.col("id") * 37 % 1009).alias("a")).repartition(5).orderBy("a")
    right = spark.range(n).select((F.col("id") * 53 % 1013).alias("b")).repartition(3).orderBy("b")
    got = sorted(tuple(r) for r in bind_columns(left, right).collect())
    expected = list(zip(sorted(i * 37 % 1009 for i in range(n)), sorted(i * 53 % 1013 for i in range(n)), strict=True))
    assert got == sorted(expected)


def test_positions_have_no_gaps(spark):
    got = numbered(spark.range(0, 500, 1, 7)).orderBy("position").collect()
    assert [(r["position"], r["row"]["id"]) for r in got] == [(i, i) for i in range(500)]


def test_unequal_lengths_and_equal_names_are_refused(spark):
    with pytest.raises(ValueError, match="3 and 2 rows"):
        bind_columns(spark.range(3), spark.range(2).withColumnRenamed("id", "x"))
    with pytest.raises(ValueError, match="both frames: id"):
        bind_columns(spark.range(3), spark.range(3))


def test_internal_names_as_columns(spark):
    left = spark.createDataFrame([(1, 2, 3)], "seg int, place int, position int")
    right = spark.createDataFrame([(None, "r")], "_left string, row string")
    got = bind_columns(left, right).first().asDict()
    assert got == {"seg": 1, "place": 2, "position": 3, "_left": None, "row": "r"}
