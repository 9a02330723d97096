"""Clickstream stream source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bankflow.schemas import APP_EVENTS

KAFKA_PREFIX = "kafka_"
KAFKA_FIELDS = ("key", "value", "topic", "partition", "offset", "timestamp")


def read_events_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    options: dict[str, str] | None = None,
    schema: str | StructType = APP_EVENTS,
    path: str | None = None,
) -> DataFrame:
    """Events as a stream, from Kafka JSON values or from files that arrive in a folder.

    A Kafka value that is no JSON gives NULL columns, which validation sends to quarantine. The message
    itself stays beside them in ``kafka_`` columns, so that it can be replayed.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        return parse_kafka(reader.load(), schema)
    return reader.schema(schema).load(path)


def parse_kafka(messages: DataFrame, schema: str = APP_EVENTS) -> DataFrame:
    parsed = F.from_json(F.col("value").cast("string"), schema)
    kept = [F.col(c).alias(KAFKA_PREFIX + c) for c in KAFKA_FIELDS if c in messages.columns]
    return messages.select(parsed.alias("e"), *kept).select(
        "e.*", *[KAFKA_PREFIX + c for c in KAFKA_FIELDS if c in messages.columns]
    )
