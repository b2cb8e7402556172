"""Streaming twins: burst assembly with a quiet gap and a hard cap, inbox dedupe and the outbox relay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, burst int, first_us long, last_us long, n int, ids_hash string"
STATE = "burst int, first_us long, due_us long, last_us long, n int, ids_hash string"


def assembled(messages: DataFrame, key: str, at: str, ident: str, quiet: float = 5, cap: float = 20) -> DataFrame:
    """Closed bursts of each key: a burst closes ``quiet`` s after its last message or ``cap`` s after its first.

    Event time; the caller sets the watermark on ``at``.  A burst is put out once
    the watermark passes its deadline, or when a later message shows it over.  ``burst``
    counts the bursts of a key since its state was made.

    The state of a key is six values, whatever the length of a burst: of its ids a running
    hash is kept (MD5 of the hash before and the id), by which a reader that joins the messages to
    the burst's times can prove what it holds.  A timeout removes the state, so a key that has
    gone quiet leaves nothing behind.
    """
    q, c = int(quiet * 1e6), int(cap * 1e6)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, k = [], str(group[0])
        burst, first, due, last, n, seen = state.get if state.exists else (0, 0, -1, 0, 0, "")
        if state.hasTimedOut:
            if n:
                out.append((k, burst, first, last, n, seen))
            state.remove()
        else:
            # A trigger's rows of a key are sorted together; the size of a trigger bounds them.
            arrived = pd.concat(list(frames)).sort_values(["us", "ident"])
            for us, i in zip(arrived["us"].tolist(), arrived["ident"].tolist(), strict=True):
                if n and us > due:
                    out.append((k, burst, first, last, n, seen))
                    burst, n, seen = burst + 1, 0, ""
                if not n:
                    first = us
                n, seen = n + 1, hashlib.md5(f"{seen}{i}".encode()).hexdigest()
                last, due = us, min(first + c, us + q)
            state.update((burst, first, due, last, n, seen))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "burst", "first_us", "last_us", "n", "ids_hash"])

    rows = messages.select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("us"), F.col(ident).cast("string").alias("ident"), at)
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def inbox(events: DataFrame, consumer: str, ident: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each event once for a consumer, within the watermark's delay."""
    return events.withWatermark(at, delay).withColumn("consumer", F.lit(consumer)).dropDuplicatesWithinWatermark(["consumer", ident])


def relay(events: DataFrame, kind: str, payload: str, key: str) -> DataFrame:
    """Envelopes (key, value, topic) as the Kafka sink takes them."""
    from caseloom.operators.ledger import topic

    return events.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("value"), topic(F.col(kind)).alias("topic"))
