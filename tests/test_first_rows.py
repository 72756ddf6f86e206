"""What goes through first rows alone gives what going through all rows would."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import mix, preferences


@pytest.mark.parametrize("late", [0, 5, 30, 100])
def test_tasks_are_harvested_however_late_they_come(spark, late):
    rows = spark.range(0, 60, numPartitions=3).select(F.col("id").alias("ord"), F.lit("p").alias("prompt"), F.when(F.col("id") < late, "x = (").otherwise("def f(a):\n    return a\nassert f(1)\n").alias("completion"))
    assert [r.ord for r in preferences.harvested(rows, 3).collect()] == [*range(late, 60)][:3]


def test_first_rows_send_no_more_than_they_keep(spark):
    df = spark.createDataFrame([(i // 2, str(i)) for i in range(40)] + [(7, "more")] * 3, "ord int, text string")
    first = mix.first_rows(df, 5, "ord")
    assert sorted(r.ord for r in first.collect()) == [0, 0, 1, 1, 2]
    assert "(ord#" in (plan := first._jdf.queryExecution().optimizedPlan().toString()) and "<= 2" in plan
    assert mix.first_rows(df, 100, "ord").count() == 43
    nulls = spark.createDataFrame([(None,), (2,), (1,)], "ord int")
    assert [r.ord for r in mix.first_rows(nulls, 2, "ord").collect()] == [None, 1]
