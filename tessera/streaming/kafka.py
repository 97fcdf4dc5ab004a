"""The broker as source and sink: options as data, so that they can be checked where no broker and no connector is.

Offsets are kept by the query's checkpoint, which is written only after a batch has been loaded; nothing is committed on a timer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.streaming import messages

#: Messages of a micro-batch at most, and the longest wait for them.
BATCH_MESSAGES, BATCH_SECONDS = 500, 5


def source_options(servers: str, topic: str, group: str, most: int = BATCH_MESSAGES) -> dict[str, str]:
    """A group without offsets begins with the oldest message; a gap in the offsets ends the query."""
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": "earliest", "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": str(most), "kafka.enable.auto.commit": "false", "kafka.client.id": f"{group}-reader",
    }


def sink_options(servers: str, topic: str, client: str = "order-events") -> dict[str, str]:
    """Repeats of the client's own sends are dropped by the broker, and a send counts when all replicas have it."""
    return {
        "kafka.bootstrap.servers": servers, "topic": topic, "kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.linger.ms": "50", "kafka.client.id": client,
    }


def read(spark: SparkSession, servers: str, topic: str, group: str, most: int = BATCH_MESSAGES) -> DataFrame:
    """The stream with the columns that the loader reads."""
    names = [c.split()[0] for c in messages.SOURCE_SCHEMA.split(", ")]
    return spark.readStream.format("kafka").options(**source_options(servers, topic, group, most)).load().select(*names)


def keyed(events: DataFrame, key: str) -> DataFrame:
    """key, value: messages of one key go to one partition in their order; null fields are left out of the JSON."""
    return events.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*events.columns)).cast("binary").alias("value"))


def write(events: DataFrame, key: str, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return keyed(events, key).writeStream.format("kafka").options(**sink_options(servers, topic)).option("checkpointLocation", checkpoint)
