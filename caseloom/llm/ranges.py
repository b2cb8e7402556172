"""Key ranges of near equal bytes that follow from the data alone, and files in shared folders."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 20
LEAST_BYTES = 4 << 20
MOST_BYTES = 1 << 30
MOST_SHARDS = 50_000
#: Leaves are at most this share of a shard, where keys can be told apart.
FINE = 4
FAN = 4
_TOP = 1 << 63


def share_of(total: int, least: int = LEAST_BYTES) -> int:
    """Bytes of a shard: few shards for small tables, and neither small files nor long tasks for large ones."""
    return max(least, min(MOST_BYTES, math.isqrt(total * UNIT)), math.ceil(total / MOST_SHARDS))


def key_shards(df: DataFrame, key: str, size: Column, tie: Column | None = None, least: int = LEAST_BYTES) -> tuple[Callable[..., DataFrame], int]:
    """(adds ``shard`` to a table with the key, number of shards): ascending ranges of a 64-bit integer key.

    Bytes are summed by the leading bits of the key, taken as an unsigned number;
    parts with more than a quarter of a shard are summed again by ``FAN`` more bits,
    until keys are single ones.  A single key (or the null key) of more than a shard
    is split by the hash ``tie``, which the table that is put must give as well.  Cuts
    depend on nothing but the rows, unlike sampled range partitioning.  Null keys come
    first.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), (size + F.lit(1)).cast("long").alias("n"))
    low, high, total, unkeyed = rows.agg(F.min("k"), F.max("k"), F.sum("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")))).first()
    if total is None:
        return lambda t, tie=None: t.withColumn("shard", F.lit(0)), 1
    share = share_of(total, least)
    can_split = tie is not None
    null_splits = max(1, math.ceil(unkeyed / share)) if unkeyed and can_split else 1
    runs: list[tuple[int, int, int]] = []  # first key, first shard, splits
    now, held, leaves, bits = (null_splits, 0, [], 0) if null_splits > 1 else (0, unkeyed or 0, [], 0)
    if low is not None:
        leaves, bits = _leaves(rows.where("k IS NOT NULL"), low, high, share, math.ceil(total / share))
        runs.append((low, now, 1))
        for first, width, n in leaves:
            splits = math.ceil(n / share) if width == 1 and can_split and n > share * 1.5 else 1
            if splits > 1 or (held and held + n > share * 1.05):
                now += 1 if held else 0
                held = 0
                runs.append((first, now, splits))
            held += n
            if splits > 1:
                now, held = now + splits, 0
                if first < high:
                    runs.append((first + 1, now, 1))
    count = max(1, now + (1 if held else 0))

    def placed(found: Column, starts: Column, firsts: Column, splits: Column, t: Column | None) -> Column:
        at = F.greatest(F.size(F.filter(starts, lambda x: x <= found)) - 1, F.lit(0))
        first, n = F.get(firsts, at), F.get(splits, at)
        return first if t is None or not can_split else first + F.when(n > 1, F.pmod(t, n)).otherwise(0)

    def chosen(shard: Column, t: Column | None) -> Column:
        null = F.lit(0) if null_splits == 1 else F.pmod(t, F.lit(null_splits))
        return F.when(F.col(key).isNull(), null).otherwise(shard).cast("int").alias("shard")

    if len(runs) <= 64:

        def put(t: DataFrame, tie: Column | None = tie) -> DataFrame:
            if not runs:
                return t.select("*", chosen(F.lit(0), tie))
            starts, firsts, splits = (F.array(*map(F.lit, c)) for c in zip(*runs, strict=True))
            return t.select("*", chosen(placed(F.col(key), starts, firsts, splits, tie), tie))

        return put, count
    # One row for each part of the first level (at most 16 for each shard) with the runs that touch it.
    parts: dict[int, list[tuple[int, int, int]]] = {}
    firsts = [r[0] for r in runs]
    for part in sorted({_unsigned(first) >> bits for first, *_ in leaves}):
        begin = max(low, (part << bits) - _TOP)
        end = min(high, begin + (1 << bits) - 1)
        parts[part] = runs[max(0, bisect_right(firsts, begin) - 1) : max(1, bisect_right(firsts, end))]
    table = df.sparkSession.createDataFrame([(_signed(p), *map(list, zip(*r, strict=True))) for p, r in parts.items()], "_part long, _starts array<long>, _firsts array<int>, _splits array<int>")

    def put(t: DataFrame, tie: Column | None = tie) -> DataFrame:
        joined = t.join(F.broadcast(table), _part(F.col(key), bits) == F.col("_part"), "left")
        return joined.select(*(t[c] for c in t.columns), chosen(F.coalesce(placed(F.col(key), F.col("_starts"), F.col("_firsts"), F.col("_splits"), tie), F.lit(0)), tie))

    return put, count


def _unsigned(key: int) -> int:
    return key + _TOP


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= _TOP else bits


def _part(key: Column, bits: int) -> Column:
    """The leading 64 - ``bits`` bits of the key plus 2 ** 63, as a long."""
    return F.shiftrightunsigned(key.cast("long").bitwiseXOR(F.lit(-_TOP)), bits)


def _leaves(rows: DataFrame, low: int, high: int, share: int, shards: int) -> tuple[list[tuple[int, int, int]], int]:
    """Ascending (first key, keys, bytes) of parts, and the bits below a part of the first level."""
    most = 1 << (16 * shards).bit_length()
    bits = max(0, (_unsigned(high) - _unsigned(low)).bit_length() - most.bit_length() + 1)
    top = bits
    out, wanted, above = [], None, bits
    while True:
        part = _part(F.col("k"), bits)
        use = rows
        if wanted is not None:
            ids = [_signed(p) for p in wanted]
            if len(ids) <= 64:
                use = rows.where(_part(F.col("k"), above).isin(ids))
            else:  # at most FINE for each shard
                heavy = rows.sparkSession.createDataFrame([(p,) for p in ids], "_heavy long")
                use = rows.join(F.broadcast(heavy), _part(F.col("k"), above) == F.col("_heavy"), "left_semi")
        sums = [(x["p"] % (1 << 64), x["n"]) for x in use.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect()]
        wanted = [p for p, n in sums if n * FINE > share] if bits else []
        split = set(wanted)
        out += [(max(low, (p << bits) - _TOP), 1 << bits, n) for p, n in sums if p not in split]
        if not wanted:
            return sorted(out), top
        above, bits = bits, max(0, bits - FAN)


def filesystem(folder: str):
    """(pyarrow file system, path) of a folder's URI; works on executors, for any shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
