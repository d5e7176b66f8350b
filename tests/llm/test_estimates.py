from __future__ import annotations

from larkspur.llm import common


def digits(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_sizes_do_not_grow_over_rounds(spark):
    """Three times as many digits with each round would be some 8000 here."""
    chain = common.checkpointed(spark.range(600).selectExpr("id AS a", "id + 1 AS b"))
    found = common.components(chain)
    assert found.where("component = 0").count() == 601
    assert digits(found) < 1000
