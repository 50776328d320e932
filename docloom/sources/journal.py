"""A journal of commands: one appended row each, read back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at timestamp, command string, bundle string, details string"


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, command: str, bundle: str = "", details: str = "") -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(command).alias("command"), F.lit(bundle).alias("bundle"), F.lit(details).alias("details"))
        row.coalesce(1).withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMA}, day date").parquet(self.path).orderBy("at")
