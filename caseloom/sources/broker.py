"""Logs of messages: envelopes of a broker, offsets, polls and commits, and the Kafka source and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.keyed import ranked

HEADERS = "array<struct<key:string,value:binary>>"


def encoded(events: DataFrame, topic: str, key: str, ident: str, payload: Column, headers: dict[str, Column] | None = None) -> DataFrame:
    """(topic, key, value, headers) as a broker takes them: a JSON value that holds the event id, headers in bytes."""
    value = F.to_json(F.struct(F.col(ident).cast("string").alias("event_id"), payload.alias("payload")))
    cells = [F.struct(F.lit(k).alias("key"), F.encode(v.cast("string"), "UTF-8").alias("value")) for k, v in (headers or {}).items()]
    return events.select(F.col(topic).alias("topic"), F.encode(F.col(key).cast("string"), "UTF-8").alias("key"), F.encode(value, "UTF-8").alias("value"), (F.array(*cells) if cells else F.array()).cast(HEADERS).alias("headers"))


def decoded(raw: DataFrame) -> DataFrame:
    """Envelopes of a source's rows: event_id, topic, partition_key, payload (JSON) and headers (map); further columns stay."""
    body = F.decode("value", "UTF-8")
    rest = [c for c in raw.columns if c not in ("topic", "key", "value", "headers")]
    headers = F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: F.struct(h["key"].alias("key"), F.decode(h["value"], "UTF-8").alias("value"))))
    return raw.select(F.get_json_object(body, "$.event_id").alias("event_id"), "topic", F.decode("key", "UTF-8").alias("partition_key"), F.coalesce(F.get_json_object(body, "$.payload"), body).alias("payload"), headers.alias("headers"), *rest)


def appended(messages: DataFrame, topic: str, order: list[Column], offset: str) -> DataFrame:
    """Messages with their offset in the topic, from 0 without gaps."""
    return ranked(messages, [topic], order, offset)


def polled(log: DataFrame, at: DataFrame, topic: str, offset: str, most: int) -> DataFrame:
    """Up to ``most`` messages of each topic from its committed offset (``at``: topic, committed; from the earliest where there is none)."""
    start = at.select(F.col(topic).alias("_t"), F.col("committed").alias("_at"))
    both = log.join(F.broadcast(start) if start.limit(10_001).count() <= 10_000 else start, F.col(topic) == F.col("_t"), "left").withColumn("_at", F.coalesce("_at", F.lit(0).cast("long")))
    return both.where((F.col(offset) >= F.col("_at")) & (F.col(offset) < F.col("_at") + most)).select(*log.columns)


def committed(at: DataFrame, done: DataFrame, topic: str, offset: str) -> DataFrame:
    """(topic, committed) after ``done``: behind the last message done, never before what is committed."""
    new = done.select(F.col(topic).alias(topic), (F.col(offset) + 1).alias("committed"))
    return at.select(topic, "committed").unionByName(new).groupBy(topic).agg(F.max("committed").alias("committed"))


# Kafka needs Spark's Kafka package on the class path.


def kafka_source(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", **options: str) -> DataFrame:
    """Envelope stream of topics; the checkpoint of the query that reads it holds the offsets, which move once a batch is done."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).option("includeHeaders", "true").options(**options).load()
    return decoded(raw.select("topic", "key", "value", "headers", F.col("timestamp").alias("published_at"), "partition", "offset"))


def kafka_sink(envelopes: DataFrame, servers: str, checkpoint: str | None = None, **options: str) -> StreamingQuery | None:
    """Write ``encoded`` rows, acknowledged by all replicas: a batch table at once, a stream as a query with its checkpoint."""
    settings = {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "includeHeaders": "true", **options}
    if not envelopes.isStreaming:
        envelopes.write.format("kafka").options(**settings).save()
        return None
    return envelopes.writeStream.format("kafka").options(**settings).option("checkpointLocation", checkpoint).start()
