"""Batch numbers: the size rule of the endpoint sender, as a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.ranking import row_numbers


def assign_batches(entries: DataFrame, lane_cols: list, order_cols: list, batch_size: int = 100,
                   **ranking) -> DataFrame:
    """Number the batches of each lane from 0, `batch_size` entries each."""
    numbered = row_numbers(entries, lane_cols, order_cols, "_n", **ranking)
    return numbered.withColumn(
        "batch_no", F.floor((F.col("_n") - 1) / batch_size)).drop("_n")
