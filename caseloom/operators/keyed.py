"""Steps by key that stay bounded: ordered folds, ranks of large groups, components, percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .shared import forget, written

SALTS = 256
ROUNDS = 60
BATCH = 10_000


def folded(rows: DataFrame, key: list[str], order: list[Column], values: list[Column], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, list[tuple]]], out: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """(key, columns of ``out``): a fold over the rows of each key in order.

    ``step`` takes the state and a row's values and gives the state and the rows to put
    out; ``finish`` puts out rows at the end of a key.  Rows of a key stream by in order
    (sorted by Spark, which spills), so a task holds one state, whatever the
    size of a key; what a row leads to may depend on all rows before it, so the rows
    of one key cannot be dealt to several tasks.
    """
    nk = len(key)
    schema = T.StructType([*(rows.schema[k] for k in key), *T._parse_datatype_string(out).fields])
    arrow = to_arrow_schema(schema)
    named = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), *(o.alias(f"o{i}") for i, o in enumerate(order)), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    keys = [f"k{i}" for i in range(nk)]
    arranged = named.repartition(*keys).sortWithinPartitions(*keys, *(f"o{i}" for i in range(len(order)))).select(*keys, *(f"v{i}" for i in range(len(values))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, made = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * len(arrow)
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            made.clear()
            return got

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[:nk] != now:
                    if now is not None and finish:
                        made.extend((*now, *r) for r in finish(state))
                    now, state = row[:nk], start()
                state, rows_out = step(state, row[nk:])
                made.extend((*now, *r) for r in rows_out)
                if len(made) >= BATCH:
                    yield batch()
        if now is not None and finish:
            made.extend((*now, *r) for r in finish(state))
        if made:
            yield batch()

    return arranged.mapInArrow(run, schema)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str, salts: int = SALTS) -> DataFrame:
    """Add gapless ranks from 0 within ``by``, in order; a large group is ranked by many tasks.

    Rows are dealt to ``salts`` ascending ranges of the first order column, whose cuts
    come from a mergeable quantile sketch of each group; ranks within a range are then
    shifted by the rows of the ranges before it.  The first order column is a number or a date.
    """
    first = order[0].cast("double")
    cuts = df.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(F.count(F.lit(1)).alias("_all"), F.percentile_approx(first, [k / salts for k in range(1, salts)], 1000).alias("_cuts"))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    # Small groups are one range.
    part = F.when(F.col("_all") <= 10_000, 0).otherwise(F.size(F.filter("_cuts", lambda c: c < first)))
    dealt = df.join(cuts, cond).withColumn("_part", F.coalesce(part, F.lit(-1)).cast("int")).drop(*(f"_b{i}" for i in range(len(by))), "_all", "_cuts")
    count = dealt.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(f"_b{i}" for i in range(len(by)))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = count.select(*(f"_b{i}" for i in range(len(by))), "_p", before.alias("_base"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    placed = dealt.withColumn("_place", place).join(base, cond & (F.col("_part") == F.col("_p")))
    return placed.select(*df.columns, (F.col("_base") + F.col("_place")).cast("long").alias(name))


def batched(rows: DataFrame, by: list[str], order: list[Column], name: str, size: int) -> DataFrame:
    """Add the number, from 0, of the batch of at most ``size`` rows that a row falls into, in order within ``by``."""
    return ranked(rows, by, order, name).withColumn(name, F.floor(F.col(name) / size).cast("long"))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables by their places in their orders; the longer one's rest is left out.

    Places come from two-level ranks, so no table is ordered in one task.
    """
    place = lambda t, order: ranked(t.withColumn("_one", F.lit(0)), ["_one"], [F.col(o) for o in order], "_place").drop("_one")
    return place(left, left_order).join(place(right, right_order), "_place").drop("_place")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) that is not its component's least node: large-star and small-star steps.

    Every round needs only minima and equality joins, so a node with very many
    links is pre-aggregated, and its link rows can be split over tasks.  The
    number of rounds grows with the logarithm of the size of a component; ``ROUNDS``
    would do for more nodes than 64-bit numbers can name.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low.select("u", F.col("m").alias("v")).union(tied).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        old, edges = edges, written(small, "edges")
        forget(old)
        after = _digest(edges)
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, names of ``shares``): exact percentiles, linearly interpolated, of groups of any size; nulls do not count.

    Equal values are counted first.  A sketch of each group gives a bracket around
    the two order statistics wanted (small groups are bracketed whole); what lies below the bracket is only counted, and
    the few distinct values inside are placed by a running sum of their counts.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    names = list(shares)
    slack = 0.002
    grid = [min(1.0, max(0.0, shares[n] + d)) for n in names for d in (-slack, slack)]
    sketch = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True))).agg(F.count(F.lit(1)).alias("_all"), F.min(F.col(value).cast("double")).alias("_low"), F.max(F.col(value).cast("double")).alias("_high"), F.percentile_approx(F.col(value).cast("double"), grid, 2000).alias("_grid"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"s{k}"))
        same = one if same is None else same & one
    brackets = []
    for i, n in enumerate(names):
        low = F.when(F.lit(shares[n] - slack <= 0) | (F.col("_all") <= 2000), F.col("_low")).otherwise(F.col("_grid")[2 * i])
        high = F.when(F.lit(shares[n] + slack >= 1) | (F.col("_all") <= 2000), F.col("_high")).otherwise(F.col("_grid")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), (F.lit(float(shares[n])) * (F.col("_all") - 1)).alias("at"), low.alias("low"), high.alias("high")))
    side = sketch.select(*(F.col(k).alias(f"s{k}") for k in keys), F.array(*brackets).alias("_want"))
    both = counted.join(side, same) if same is not None else counted.crossJoin(F.broadcast(side))
    placed = both.select(*keys, "_v", "_n", F.explode("_want").alias("_w")).where(F.col("_v") <= F.col("_w.high"))
    # Values below the bracket collapse to one row.
    fine = placed.select(*keys, "_w.i", "_w.at", "_n", "_v", F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_in"))
    fine = fine.groupBy(*keys, "i", "_in").agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"), F.first("at").alias("at"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    run = fine.select(*keys, "i", "_v", "at", upto.alias("_upto"))
    first = F.min(F.when(F.col("_upto") > F.floor("at"), F.col("_v")))
    second = F.min(F.when(F.col("_upto") > F.ceil("at"), F.col("_v")))
    part = F.first("at") - F.floor(F.first("at"))
    got = run.groupBy(*keys, "i").agg((first + (F.coalesce(second, first) - first) * part).alias("p"))
    out = got.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias(n) for i, n in enumerate(names)))
    return out.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), *names)
