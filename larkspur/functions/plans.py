"""What Spark's planner is told."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unestimated(checkpoint: DataFrame) -> DataFrame:
    """The rows of a checkpoint without the size that Spark estimated for them.

    A join's estimate is the product of its sides', and a checkpoint keeps it: over rounds that join a state with itself the digits of that number grow
    as a power of the rounds, until the driver spends its time and heap on multiplying them. What is cut here starts from the default again.
    """
    session = checkpoint.sparkSession
    rows = checkpoint._jdf.queryExecution().logical().rdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, checkpoint._jdf.schema(), False), session)
