from pyspark.sql import functions as F

from caseloom.operators.inference import embedder, predictions
from caseloom.operators.spans import placed, resolved_spans, union_text

SPANS = "array<struct<start:int,end:int,label:string>>"


def resolved(spark, cases):
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(cases)], f"i int, text string, s {SPANS}")
    got = df.select("i", resolved_spans(F.col("s"), F.col("text")).alias("r")).orderBy("i").collect()
    return [None if r.r is None else [tuple(x) for x in r.r] for r in got]


def test_spans_are_cut_around_higher_labels(spark):
    text = "Lapor: ada sampah dua minggu menumpuk di jalan"
    cases = [
        ([(0, 20, "OBJ"), (5, 9, "TIME")], None), ([(0, 20, "LOC"), (5, 9, "OBJ")], None), ([(0, 6, "OBJ"), (4, 9, "LOC"), (2, 2, "LOC"), (-1, 3, "TIME")], None), ([], None), (None, "x"),
        ([(0, 60, "OBJ"), (10, 25, "LOC"), (40, 50, "TIME")], None), ([(10, 50, "OBJ"), (10, 25, "LOC")], None), ([(11, 37, "OBJ"), (18, 28, "TIME")], text), ([(3, 3, "OBJ"), (5, 6, "LOC")], "abcd !"), ([(0, 4, "X"), (0, 4, "OBJ")], None),
    ]
    assert resolved(spark, cases) == [
        [(0, 5, "OBJ"), (5, 9, "TIME"), (9, 20, "OBJ")], [(0, 20, "LOC")], [(4, 9, "LOC")], [], None,
        [(0, 10, "OBJ"), (10, 25, "LOC"), (25, 40, "OBJ"), (40, 50, "TIME"), (50, 60, "OBJ")], [(10, 25, "LOC"), (25, 50, "OBJ")], [(11, 17, "OBJ"), (18, 28, "TIME"), (29, 37, "OBJ")], [], [(0, 4, "OBJ")],
    ]


def test_bridging_spans_go(spark):
    compound = "Lapor: pipa induk air bersih pecah dan semburan air membanjiri"
    cases = [([(0, 27, "OBJ"), (0, 10, "OBJ"), (16, 27, "OBJ")], "pipa bocor lalu kabel putus"), ([(0, 9, "OBJ"), (0, 4, "OBJ"), (5, 9, "OBJ")], "pipa air."), ([(10, 60, "OBJ"), (10, 25, "OBJ"), (40, 55, "OBJ")], None), ([(7, 28, "OBJ"), (7, 17, "OBJ"), (18, 28, "OBJ"), (39, 51, "OBJ")], compound)]
    assert resolved(spark, cases) == [[(0, 10, "OBJ"), (16, 27, "OBJ")], [(0, 8, "OBJ")], [(10, 25, "OBJ"), (40, 55, "OBJ")], [(7, 28, "OBJ"), (39, 51, "OBJ")]]


def test_no_two_resolved_spans_overlap(spark):
    import random

    r = random.Random(5)
    cases = [([(a, a + r.randint(1, 12), r.choice(["TIME", "LOC", "OBJ"])) for a in (r.randint(0, 30) for _ in range(6))], None) for _ in range(60)]
    for (given, _), got in zip(cases, resolved(spark, cases), strict=True):
        assert got and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        best = max(given, key=lambda s: ({"TIME": 3, "LOC": 2, "OBJ": 1}[s[2]], s[1] - s[0], -s[0]))
        held = [g for g in got if best[0] <= g[0] and g[1] <= best[1]]
        assert held and {g[2] for g in held} == {best[2]}


def test_values_take_their_first_free_place(spark):
    df = spark.createDataFrame([("ab ab cab abc", [("ab", "X"), ("abc", "Y"), ("zz", "Z"), ("ab", "W"), ("", "E")]), (None, [("a", "X")]), ("a.b (a.b)", [("a.b", "X"), ("(a.b)", "Y")])], "text string, v array<struct<text:string,label:string>>")
    got = [None if r.p is None else [tuple(x) for x in r.p] for r in df.select(placed(F.col("text"), F.col("v")).alias("p")).collect()]
    assert got[0] == [(0, 2, "X"), (3, 5, "W"), (10, 13, "Y")] and not got[1] and got[2] == [(0, 3, "X"), (4, 9, "Y")]


def test_union_of_span_texts(spark):
    df = spark.createDataFrame([([(3, 6, "def"), (0, 4, "abcd")],), ([(8, 10, "ij"), (0, 2, "ab")],), ([(0, 5, "abcde"), (1, 3, "bc")],)], "s array<struct<start:int,end:int,text:string>>")
    assert [r.u for r in df.select(union_text(F.col("s")).alias("u")).collect()] == ["abcdef", "ab      ij", "abcde"]


def test_hooks(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("bad",)], "text string").coalesce(1)
    fields = df.select(F.struct(F.lit("x").alias("label"), F.lit(1.0).alias("p")).alias("f")).schema["f"].dataType

    def fails(texts):
        if "bad" in texts:
            raise RuntimeError("no weights")
        return [{"label": t[:1], "p": 0.5} for t in texts]

    got = {r.text: (r.prediction, r.failure) for r in predictions(df, fails, fields).collect()}
    assert got["a b c"][0].label == "a" and got[None][0].label == "" and got["bad"] == (None, "RuntimeError: no weights")
    assert [r.e for r in df.select(embedder(lambda t: [[float(len(x))] for x in t])("text").alias("e")).collect()] == [[5.0], [0.0], [3.0]]
