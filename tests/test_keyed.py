"""Folds, ranks, components and percentiles by key, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import keyed


def test_fold_streams_rows_in_order(spark):
    rows = [(k, i, i * 3 % 7) for i in range(50) for k in ("a", None, "b")]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    out = keyed.folded(df, ["k"], [F.col("i")], [F.col("i"), F.col("v")], lambda: 0, lambda s, r: (s * 31 % 1000 + r[1], [(r[0], s)]), "i int, s int", finish=lambda s: [(-1, s)])
    want = set()
    for k in ("a", None, "b"):
        s = 0
        for i in range(50):
            want.add((k, i, s))
            s = s * 31 % 1000 + i * 3 % 7
        want.add((k, -1, s))
    assert set(map(tuple, out.collect())) == want
    assert keyed.folded(df.limit(0), ["k"], [F.col("i")], [F.col("v")], lambda: 0, lambda s, r: (s, []), "s int", finish=lambda s: [(s,)]).count() == 0


@pytest.mark.parametrize("large", [10_000, 0])
def test_ranks_of_large_groups(spark, monkeypatch, large):
    r = random.Random(1)
    rows = [("hot", r.randint(0, 9), i) for i in range(3000)] + [(None, 1, i) for i in range(5)] + [("one", None, 1)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    if not large:  # all groups in ranges
        real = F.when
        monkeypatch.setattr(keyed.F, "when", lambda c, v: real(F.lit(False), v) if v == 0 else real(c, v))
    got = keyed.ranked(df, ["g"], [F.col("x"), F.col("i")], "rank").collect()
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1], x[2]))):
            want[x] = k
    assert {(x.g, x.x, x.i): x["rank"] for x in got} == want and len(got) == len(rows)


def test_zipped_by_place(spark):
    a, b = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "a int"), spark.createDataFrame([(i,) for i in range(40)], "b int")
    assert {tuple(r) for r in keyed.zipped(a, b, ["a"], ["b"]).collect()} == {(i, i) for i in range(40)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200), (200, 250), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in keyed.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 300: 200, 250: 200}
    assert keyed.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5000])
def test_percentiles_are_exact(spark, n):
    import numpy as np

    r = random.Random(n)
    rows = [(g, r.choice([r.random(), 0.5, -1.0])) for g in ("a", None) for _ in range(n)] + [("b", None)]
    shares = {"p0": 0.0, "p3": 0.025, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x.g: x for x in keyed.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(got) == {"a", None}
    for g in ("a", None):
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile([v for k, v in rows if k == g], q), abs=1e-12)
