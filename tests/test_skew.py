from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import skew


@pytest.mark.parametrize("few, how", [(256, "inner"), (2, "inner"), (2, "left"), (2, "left_semi")])
def test_spread_join_is_a_join(spark, monkeypatch, few, how):
    monkeypatch.setattr(skew, "FEW", few)
    monkeypatch.setattr(skew, "SHARE", 5)
    rows = spark.createDataFrame([("hot", 1, i) for i in range(900)] + [("warm", i % 3, i) for i in range(60)] + [(None, 1, 7), ("none", None, 8), ("alone", 4, 9)], "a string, b int, v long")
    groups = spark.createDataFrame([("hot", 1, "x"), ("hot", 1, "y"), ("warm", 0, "z"), ("warm", 2, "w"), (None, 1, "q")], "a string, b int, g string")
    sizes = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    got = skew.spread_join(rows, groups, ["a", "b"], sizes, F.col("v"), how)
    want = rows.join(groups, ["a", "b"], how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    if few == 2 and how == "inner":
        spread = rows.join(groups, ["a", "b"]).count()
        assert spread == 1800 + 40 and "__way" in got._jdf.queryExecution().optimizedPlan().toString()
