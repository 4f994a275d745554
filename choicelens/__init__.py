"""choicelens — market-choice analytics as lazy Spark DataFrame operators.

Every public operator takes a DataFrame plus column names and returns a
DataFrame without triggering a job, so Catalyst sees the whole plan from the
Parquet scan to the result.
"""

from choicelens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
