"""Intake: normalising payloads, validation, ordered joins of messages, bursts and association."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keyed import folded
from .ledger import micros


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def truthy(value: Column) -> Column:
    """JSON true, or the texts `true` and `1`."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1"), F.lit(False))


def self_sent(flags: list[Column], sender: Column, account: Column, message_id: Column) -> Column:
    out = F.coalesce(sender == account, F.lit(False)) | F.coalesce(message_id.startswith("true_"), F.lit(False))
    for f in flags:
        out = out | truthy(f)
    return out


def receipt_only(flags: list[Column], event: Column, kind: Column, body: Column, ack: Column, status: Column) -> Column:
    events = ("ack", "onack", "message_ack", "receipt", "delivery", "delivery_receipt", "read", "read_receipt")
    kinds = ("ack", "receipt", "delivery", "delivery_receipt", "read", "read_receipt", "status_receipt")
    states = ("delivered", "read", "viewed", "played", "sent", "ack")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    blank = F.coalesce(body, F.lit("")) == ""
    out = low(event).isin(*events) | low(kind).isin(*kinds) | (blank & (ack.isNotNull() | low(status).isin(*states)))
    for f in flags:
        out = out | truthy(f)
    return out


def group_chat(flags: list[Column], addresses: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | truthy(f)
    for a in addresses:
        out = out | F.coalesce(a.contains("@g.us") | a.endswith("@temp"), F.lit(False))
    return out


def violated(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold (an unknown one does not)."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))


def joined_texts(messages: DataFrame, key: str, order: str, text: str, separator: str) -> DataFrame:
    """(key, joined, n): the texts of a key in order, as one value, so bounded by what a value may hold."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return messages.groupBy(key).agg(parts.alias("p"), F.count(F.lit(1)).alias("n")).select(key, F.array_join(F.transform("p", lambda x: x["t"]), separator).alias("joined"), "n")


def hashed_texts(messages: DataFrame, key: str, order: list[str], text: str, separators: dict[str, str], count: str | None = None) -> DataFrame:
    """(key, names of ``separators``): SHA-256 of the texts of a key in order, joined by each separator; null texts are left out.

    Texts stream through the hashes in order, so a key of any size is never joined in memory;
    ``count`` names a column with the number of rows.
    """
    names = list(separators)

    def step(s, row):
        sums, seen, n = s if s is not None else ([hashlib.sha256() for _ in names], False, 0)
        if row[0] is not None:
            data = row[0].encode()
            for h, name in zip(sums, names, strict=True):
                if seen:
                    h.update(separators[name].encode())
                h.update(data)
            seen = True
        return (sums, seen, n + 1), []

    finish = lambda s: [(*(h.hexdigest() for h in s[0]), s[2])]
    out = folded(messages, [key], [F.col(o) for o in order], [F.col(text)], lambda: None, step, ", ".join(f"{n} string" for n in names) + ", _n long", finish)
    return out.withColumnRenamed("_n", count) if count else out.drop("_n")


def cumulative_texts(messages: DataFrame, key: str, order: str, text: str, name: str, separator: str = " ") -> DataFrame:
    """Add ``name``: all texts of the key up to the row, joined.  Its size is quadratic in the rows of a key by its nature; ``running_hashes`` is not."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn(name, F.array_join(F.collect_list(text).over(w), separator))


def running_hashes(messages: DataFrame, key: str, order: list[str], text: str, ident: str, name: str, separator: str = " ") -> DataFrame:
    """(key, ident, name): SHA-256 of all texts of the key up to each row, joined; null texts are left out."""

    def step(s, row):
        h, seen = s if s is not None else (hashlib.sha256(), False)
        id_, t = row
        if t is not None:
            h.update((separator if seen else "").encode() + t.encode())
            seen = True
        return (h, seen), [(id_, h.copy().hexdigest())]

    kind = messages.schema[ident].dataType.simpleString()
    return folded(messages, [key], [F.col(o) for o in order], [F.col(ident), F.col(text)], lambda: None, step, f"{ident} {kind}, {name} string")


def last_within(rows: DataFrame, key: str, at: str, ident: str, kind: Column, seconds: int) -> DataFrame:
    """Add last_id: the newest earlier row of the key for which ``kind`` holds, at most ``seconds`` older.

    One window pass over (key, time): the newest such row is carried along, then
    dropped where it is too old.
    """
    w = Window.partitionBy(key).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(kind, F.struct(F.col(at).alias("at"), F.col(ident).alias("id"))), ignorenulls=True).over(w)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    out = rows.withColumn("_last", last)
    fresh = us(F.col("_last.at")) >= us(F.col(at)) - seconds * 1_000_000
    return out.withColumn("last_id", F.when(fresh, F.col("_last.id"))).drop("_last")


#: Bytes of needles that go to every task.
CONTAINED_BYTES = 1 << 20


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Pairs where the text contains the needle; nulls on either side match nothing, an empty needle every text.

    A list of up to ``CONTAINED_BYTES`` goes to every task and is tried on each
    text as it streams by.  A longer one is looked up by equality: each text gives
    its substrings of the needles' lengths, and the pairs meet by key.
    """
    needles = needles.where(F.col(needle).isNotNull())
    size = needles.agg(F.sum(F.octet_length(needle) + 16)).first()[0] or 0
    if size <= CONTAINED_BYTES:
        return texts.join(F.broadcast(needles), F.col(text).contains(F.col(needle)))
    sizes = [x[0] for x in needles.select(F.length(needle)).distinct().collect()]

    def of_size(n: int) -> Column:
        if not n:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of_size, sizes)))
    return texts.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(F.array_distinct(grams))).join(needles, F.col("_gram") == F.col(needle)).drop("_gram")


def bursts(messages: DataFrame, key: list[str], at: str, ident: str, quiet: float, cap: float) -> DataFrame:
    """Add burst (from 0) to each message: a burst closes ``quiet`` seconds after its last or ``cap`` after its first message.

    A message that arrives exactly at the deadline still belongs to the burst.
    The deadline depends on the burst's first message, so the arrivals of a key
    are folded in order; the state is three numbers.
    """
    q, c = int(quiet * 1e6), int(cap * 1e6)

    def step(s, row):
        burst, first, due = s
        t, id_ = row
        if due is None or t > due:
            burst, first = burst + 1, t
        return (burst, first, min(first + c, t + q)), [(id_, burst)]

    kind = messages.schema[ident].dataType.simpleString()
    return folded(messages, key, [micros(at), F.col(ident)], [micros(at), F.col(ident)], lambda: (-1, 0, None), step, f"{ident} {kind}, burst int")


def linked(messages: DataFrame, firings: DataFrame, key: str, ident: str, arrived: str, due: str) -> DataFrame:
    """(key, ident, fired): the first firing of the key at or after a message's arrival picks it up, however late it is.

    Messages that no firing has picked up yet stay pending (null); none is dropped.
    """
    both = messages.select(key, F.col(arrived).alias("_t"), F.lit(0).alias("_kind"), F.col(ident).alias(ident), F.lit(None).cast("long").alias("_due"))
    both = both.unionByName(firings.select(key, F.col(due).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(messages.schema[ident].dataType).alias(ident), F.col(due).alias("_due")))
    # From the latest to the earliest, the firing next in time is the last one seen.
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("fired", F.last("_due", ignorenulls=True).over(w)).where("_kind = 0").select(key, ident, "fired")


def deduplicated(rows: DataFrame, key: list[str], content: list[str], order: str) -> DataFrame:
    """The first row of each identity, with ``conflict``: whether another one differs in content."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    rest = [c for c in rows.columns if c not in key]
    by = rows.withColumn("_d", digest).groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_s"), (F.min("_d") != F.max("_d")).alias("conflict"))
    return by.select(*key, "_s.*", "conflict")


def of_tenant(rows: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant; no tenant sees no row, as the row policy of a store has it."""
    return rows.where(F.lit(False)) if not tenant else rows.where(F.col(column) == tenant)
