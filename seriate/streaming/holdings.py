"""Reading statements as they arrive. The reading keeps no state, so a stream gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriate.operators.code import arrow_map
from seriate.operators.reading import _reader


def statements(spark: SparkSession, folder: str, schema: str = "record_index bigint, field_index int, text string") -> DataFrame:
    """New Parquet files of statements in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def read(stream: DataFrame, **options) -> DataFrame:
    """text, parsed, converted of each arriving statement."""
    run, ddl = _reader(options)
    return arrow_map(stream.where("text IS NOT NULL").select("text"), run, ddl)


def to_table(stream: DataFrame, out: str, checkpoint: str):
    """Write each statement once, as a query that ends with what is there."""
    return read(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
