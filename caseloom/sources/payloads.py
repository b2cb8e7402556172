"""Normalisers of incoming payloads: webhooks, connectors, social posts, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import scores
from caseloom.operators.intake import first_text


def _at(payload: Column, *paths: str) -> list[Column]:
    return [F.get_json_object(payload, f"$.{p}") for p in paths]


def webhook(payload: Column, tenant: str) -> Column:
    """struct of a message payload; null for other events and for packets without body, media and location."""
    event = F.lower(F.trim(F.coalesce(*_at(payload, "event"), F.lit("message.received"))))
    inner = F.coalesce(*_at(payload, "data"), payload)
    body = first_text(*_at(inner, "body", "text"))
    media = F.coalesce(first_text(*_at(inner, "hasMedia", "media")), F.lit("false")) != "false"
    place = F.coalesce(*_at(inner, "latitude", "location")).isNotNull()
    made = F.struct(
        F.lit(tenant).alias("tenant_id"),
        F.coalesce(*_at(inner, "source_message_id", "id")).alias("source_message_id"),
        F.coalesce(*_at(inner, "conversation_id", "chatId", "chat_id", "from", "senderPhone")).alias("conversation_id"),
        F.coalesce(body, F.when(place, "[Pin Lokasi]"), F.when(media, "[Lampiran Gambar Tanpa Keterangan]")).alias("text"),
        F.coalesce(*_at(inner, "received_at", "timestamp", "createdAt"), *_at(payload, "timestamp")).alias("received_at"),
    )
    return F.when((event == "message.received") & (body.isNotNull() | media | place), made)


def required(payload: Column, *keys: str) -> Column:
    """The first non-empty text of the keys, or of their `_serialized` / `id` parts."""
    tried = []
    for k in keys:
        value = F.get_json_object(payload, f"$.{k}")
        tried += [F.when(~value.startswith("{"), value), *_at(payload, f"{k}._serialized", f"{k}.id")]
    return first_text(*tried)


def social_post(platform: Column, query: Column, item: Column) -> Column:
    """struct(platform, external_id, query, url, author, text, published_at) of a JSON item."""

    def pick(*keys: str) -> Column:
        tried = []
        for k in keys:
            value = F.get_json_object(item, f"$.{k}")
            tried += [F.when(~value.startswith("{"), value), *_at(item, f"{k}.name", f"{k}.username", f"{k}.screen_name")]
        return first_text(*tried)

    text = F.coalesce(pick("text", "content", "full_text", "description", "title"), F.lit(""))
    author = F.coalesce(pick("author", "username", "user", "screen_name", "account"), F.lit(""))
    url = F.coalesce(pick("url", "link", "permalink", "post_url"), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", platform, author, text), 256))
    ident = F.coalesce(pick("id", "tweet_id", "post_id", "note_id", "video_id"), F.nullif(url, F.lit("")), digest)
    when = pick("published_at", "created_at", "timestamp", "date", "time")
    return F.struct(platform.alias("platform"), F.substring(ident, 1, 256).alias("external_id"), query.alias("query"), url.alias("url"), F.substring(author, 1, 256).alias("author"), F.coalesce(F.nullif(text, F.lit("")), F.lit("(tanpa teks)")).alias("text"), social_time(when).alias("published_at"))


def social_time(value: Column) -> Column:
    """Digits are epoch seconds, else ISO-8601; else null."""
    return F.when(value.rlike(r"^\d+$"), F.timestamp_seconds(value.try_cast("long"))).otherwise(value.try_cast("timestamp"))


message_time = scores.epoch_or_iso


def envelope(stdout: Column) -> Column:
    """The JSON object of a tool's output: the whole, or its last line that is an object; null if there is none."""
    lines = F.filter(F.transform(F.split(F.trim(stdout), "\n"), F.trim), lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    return F.when(F.try_parse_json(F.trim(stdout)).isNotNull(), F.trim(stdout)).otherwise(F.try_element_at(lines, F.lit(-1)))


def replayed(fixtures: DataFrame, base: Column) -> DataFrame:
    """Messages of fixtures (tenant_id, conversation_id, bubbles): absolute times from the bubbles' offsets."""
    b = fixtures.select("tenant_id", "conversation_id", F.explode("bubbles").alias("b"))
    return b.select("tenant_id", "conversation_id", F.col("b.source_message_id").alias("source_message_id"), F.col("b.text").alias("text"), F.timestamp_micros(F.unix_micros(base) + F.col("b.offset_seconds").cast("long") * 1_000_000).alias("received_at"))


def collected(posts: DataFrame, order: str) -> DataFrame:
    """The first post of each (platform, external_id)."""
    from caseloom.operators.datasets import first_seen

    return first_seen(posts, ["platform", "external_id"], order)


def registration(new: DataFrame, known: DataFrame, policy: str = "skip") -> DataFrame:
    """New registry rows (name, version, digest) with ``action``: insert, same, or what the policy says of a change."""
    old = known.select("name", "version", F.col("digest").alias("_old"))
    return new.join(old, ["name", "version"], "left").withColumn("action", F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("digest"), "same").otherwise(policy)).drop("_old")
