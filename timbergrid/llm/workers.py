"""What Python workers need: this package, and Arrow batches of a size that fits them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from timbergrid.operators.checkpoints import ship


def prepare(spark: SparkSession, rows: int = 1000, mb: int = 32) -> None:
    """Ship the package to the executors once, and keep batches of whole texts small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
    ship(spark)
