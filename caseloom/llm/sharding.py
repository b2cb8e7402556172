"""Operator 3: shards by best-fit-decreasing packing of indivisible groups.

Groups (equal texts) are sorted by size, and each enters the bin whose remaining
capacity is the tightest that holds it; a balanced tree over remaining
capacities finds that bin.  With a capacity given, the number of bins is what
the packing needs; with a number of bins given, a group
larger than the mean of what is left has a bin of its own, and the capacity of
the others is the least that a bisection finds to suffice, so that shards are as
near equal in bytes as indivisible groups allow.

Groups of one size are alike, so the driver packs size classes with counts, not
groups: sizes are rounded up to ``DIGITS`` binary digits, which makes less than
2 ** (DIGITS - 1) * 55 classes whatever the input, at most 0.4 % above the true size.
Each group then takes its place in its class from a two-level rank, and slots
within a shard are numbered the same way; no step orders a shard, class or group
in one task.

Null and empty texts have size 1, and are one group each.  Rows that repeat a
key are rows of their own.  Groups of one size take their places by their hash, so ties are
settled by the texts alone; slots go by key.  Very long texts are groups like any other;
an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

DIGITS = 9
UNEVEN = 0.02
SALTS = 256


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.left, self.right, self.level = key, None, None, 1


class BalancedTree:
    """Ordered set of (remaining capacity, bin): an AA tree."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _skew(t: _Node | None) -> _Node | None:
        if t and t.left and t.left.level == t.level:
            a = t.left
            t.left, a.right = a.right, t
            return a
        return t

    @staticmethod
    def _split(t: _Node | None) -> _Node | None:
        if t and t.right and t.right.right and t.right.right.level == t.level:
            a = t.right
            t.right, a.left = a.left, t
            a.level += 1
            return a
        return t

    def add(self, key: tuple[int, int]) -> None:
        def into(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out(t, key):
            if t is None:
                raise KeyError(key)
            if key < t.key:
                t.left = out(t.left, key)
            elif key > t.key:
                t.right = out(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                least = t.right
                while least.left:
                    least = least.left
                t.key = least.key
                t.right = out(t.right, least.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and t.right.level > low:
                    t.right.level = low
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = out(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                t, best = t.left, t.key
            else:
                t = t.right
        return best


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, number) for ``classes`` of (size, number); None if more than ``most`` bins would be needed.

    Items of one class that enter a bin one after another are placed at once:
    the tightest bin that holds one stays the tightest while it holds more.
    """
    tree, bins, out = BalancedTree(), 0, []
    for size, left in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} exceeds the capacity {capacity}")
        while left:
            at = tree.tightest(size)
            if at is None:
                if bins == most:
                    return None
                at, bins = (capacity, bins), bins + 1
            else:
                tree.remove(at)
            put = min(left, at[0] // size)
            out.append((size, at[1], put))
            left -= put
            tree.add((at[0] - put * size, at[1]))
    return out


def least(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The packing into at most ``bins`` bins of the least capacity that a bisection finds."""
    low = max(max(s for s, _ in classes), math.ceil(sum(s * n for s, n in classes) / bins))
    step, best = max(1, low >> 14), None
    high = low
    while (best := pack(classes, high, bins)) is None:
        low, high, step = high + 1, high + step, step * 2
    while high - low > max(1, high >> 14):
        mid = (low + high) // 2
        got = pack(classes, mid, bins)
        if got is None:
            low = mid + 1
        else:
            high, best = mid, got
    return best


def level(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """A packing into at most ``bins`` bins near equal in size.

    A group larger than the mean of what is left has a bin of its own, as no
    packing makes that bin smaller; the others share the other bins.  Where the
    least capacity leaves bins ``UNEVEN`` below the fullest, the fullest is closed
    and the rest is levelled again.
    """
    left, out, at = dict(sorted(classes, reverse=True)), [], 0
    while left:
        total, top = sum(s * n for s, n in left.items()), max(left)
        if top * (bins - at) > total:
            shut = [(top, 1)]
        else:
            got = least(list(left.items()), bins - at)
            fill = [0] * (bins - at)
            for s, b, n in got:
                fill[b] += s * n
            if min(fill) >= (1 - UNEVEN) * max(fill):
                return out + [(s, at + b, n) for s, b, n in got]
            full = fill.index(max(fill))
            shut = [(s, n) for s, b, n in got if b == full]
        for s, n in shut:
            out.append((s, at, n))
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        at += 1
    return out


def rounded(size):
    """``size`` rounded up to DIGITS binary digits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) - F.lit(DIGITS - 1)))
    return (F.ceil(size / unit) * unit).cast("long")


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add gapless ranks from 0 within ``by``; salted, so a large group is ranked by many tasks."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    count = df.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = count.select(*by, "_salt", before.alias("_base"))
    place = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    return df.withColumn("_place", place).join(base, [*by, "_salt"]).withColumn(name, (F.col("_base") + F.col("_place") - 1).cast("long")).drop("_salt", "_place", "_base")


def shards(df: DataFrame, bins: int | None = 16, capacity: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): law `bytes`."""
    data = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(F.col(text), 256))).alias("grp"),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("bytes", rounded(F.col("bytes")))
    groups = written(groups, "groups")
    classes = [(x["bytes"], x["n"]) for x in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]
    packed = level(classes, bins) if capacity is None else pack(classes, capacity)
    plan: dict[int, list[tuple[int, int]]] = {}
    for size, shard, n in packed:
        plan.setdefault(size, []).append((shard, n))
    spark = df.sparkSession
    places = []
    for size, runs in plan.items():
        upto, total = [], 0
        for _, n in runs:
            total += n
            upto.append(total)
        places.append((size, upto, [b for b, _ in runs]))
    places = spark.createDataFrame(places, "bytes long, upto array<long>, bins array<int>")
    placed = ranked(groups, ["bytes"], ["grp"], "rank").join(places, "bytes").select("grp", F.expr("bins[size(filter(upto, x -> x <= rank))]").alias("shard"))
    out = ranked(rows.join(placed, "grp"), ["shard"], ["key", "grp"], "slot")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
