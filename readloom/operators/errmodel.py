"""The default substitution error model from quality scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_Q = 40


def error_rates(max_q: int = MAX_Q) -> np.ndarray:
    """16 rows (true base * 4 + read base), a column a quality from 0 to ``max_q``."""
    wrong = np.minimum(10.0 ** (-np.arange(max_q + 1) / 10.0), 0.75)
    right = np.eye(4, dtype=bool).ravel()
    return np.where(right[:, None], 1 - wrong, wrong / 3)


def error_table(spark: SparkSession, max_q: int = MAX_Q) -> DataFrame:
    """(trans_idx, q, rate), the same model as a table."""
    cells = spark.range(16).select(F.col("id").cast("int").alias("trans_idx")).crossJoin(F.broadcast(spark.range(max_q + 1).select(F.col("id").cast("int").alias("q"))))
    wrong = F.least(F.pow(F.lit(10.0), -F.col("q") / 10.0), F.lit(0.75))
    same = F.floor(F.col("trans_idx") / 4) == F.col("trans_idx") % 4
    return cells.select("trans_idx", "q", F.when(same, 1 - wrong).otherwise(wrong / 3).alias("rate"))
