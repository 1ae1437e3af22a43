"""Size checks that choose between a one-task plan and a spread-out plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# Largest estimated input that may be ordered or counted inside a single task.
ONE_TASK_BYTES = ("spark.prismal.oneTaskBytes", 64 * 1024 * 1024)
# Largest estimated input whose quantiles may be kept as a value map in one task.
QUANTILE_BYTES = ("spark.prismal.quantileBytes", 64 * 1024 * 1024)
# Largest estimated frame that may be broadcast when its row count has no fixed bound.
BROADCAST_BYTES = ("spark.prismal.broadcastBytes", 64 * 1024 * 1024)


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    key, default = entry
    return int(spark.conf.get(key, str(default)))


def estimated_bytes(df: DataFrame) -> float:
    """Catalyst's size estimate of a frame; infinite where the session does not expose it."""
    try:
        return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:  # no JVM plan behind this frame
        return math.inf


def fits_value_map(df: DataFrame) -> bool:
    return estimated_bytes(df) <= setting(df.sparkSession, QUANTILE_BYTES)


def may_broadcast(df: DataFrame) -> bool:
    return estimated_bytes(df) <= setting(df.sparkSession, BROADCAST_BYTES)


def inputs_fit_one_task(df: DataFrame, share: float = 1.0) -> bool:
    """Whether all that the frame is made from fits one task, or a share of what may.

    Adds up what the frame's sources hold (files have a known size, rows made on the driver or by Python mostly don't and
    count as large). Joins and explodes above them are not estimated: Catalyst multiplies sizes there.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(float(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except AttributeError:  # no JVM plan behind this frame
        return False
    return size <= share * setting(df.sparkSession, ONE_TASK_BYTES)
