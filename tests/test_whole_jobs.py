"""Registered queries over inputs that an earlier form of them left out in part."""

import hashlib
import os
import random
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry


def run(spark, path, query, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return entry.queries()[query](spark, str(path)).collect()


def test_f10_has_quotas_of_every_size(spark, tmp_path):
    sizes = {"one": 1, "two": 2, "three": 3, "at the end of the table": 60, "beyond it": 61, "hot": 500}
    rows = [(n * 1000 + i, s) for s, n in sizes.items() for i in range(n)]
    got = {r.category: (r.train, r.dev) for r in run(spark, tmp_path, "F10_quota_allocation", "documents", rows, "doc_id long, source string")}
    want = {"one": (1, 0), "two": (1, 0)}
    for s, k in list(sizes.items())[2:]:
        q = [1, 1, 1]
        while sum(q) < k:
            lack = [round(k * share - n, 9) for share, n in zip((0.7, 0.15, 0.15), q, strict=True)]
            q[lack.index(max(lack))] += 1
        want[s] = tuple(q[:2])
    assert got == want


def test_i12_ids_tell_long_openings_apart(spark, tmp_path):
    texts = ["same opening " * 20 + end for end in ("one", "two")]
    got = run(spark, tmp_path, "I12_message_id", "documents", [(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    assert {r.doc_id: r.message_id for r in got} == {i: "s:conn:acct:" + hashlib.sha256(f"s:conn:acct:{t}".encode()).hexdigest() for i, t in enumerate(texts)}


def test_i15_masks_short_texts(spark, tmp_path):
    texts = ["", "short", "0123456789abcdefghij", "0123456789abcdefghijABCDE", None]
    want = ["", "short", "01234abcdefghij", "01234abcdefghij", None]
    got = run(spark, tmp_path, "I15_landmark_masking", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.masked_hash for r in got} == {i: None if w is None else hashlib.sha256(w.encode()).hexdigest() for i, w in enumerate(want)}


def test_f1_ranks_every_hit(spark, tmp_path):
    rows = [(i, " ".join(["aa"] * (i % 7 + 1) + ["bb"] * (i % 3))) for i in range(300)]
    spark.createDataFrame([(1, "aa bb"), (2, "zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = run(spark, tmp_path, "F1_score_ranks", "documents", rows, "doc_id long, text string")
    assert sorted(r["rank"] for r in got) == list(range(1, 301)) and {r.item_id for r in got} == {1}


def test_c12_matches_texts_as_they_are(spark, tmp_path):
    texts = {
        "at 5 the oak": "SUFFICIENT", "at 5\nthe oak": "INCOMPLETE", "the oak 5": "INCOMPLETE", "at 5\tthe oak": "INCOMPLETE",
        "5 the the oak": "INCOMPLETE", "5 the is-land": "INCOMPLETE", "5 the isle": "SUFFICIENT", "5 the the_oak": "INCOMPLETE", "5 the is the oak": "SUFFICIENT",
        "one of a\nby b with c": "INCOMPLETE", "one of a by b with c": "SUFFICIENT", None: "INCOMPLETE",
    }
    got = run(spark, tmp_path, "C12_completeness", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.completeness for r in got} == dict(enumerate(texts.values()))


def test_i8_keeps_the_digits_at_the_ends_of_hints(spark, tmp_path):
    texts = {"x of 0abc": 1, "x of abc0": 1, "x of abcd de abc1": 1, "x of abcd . de abc1": 2, "x of 0000 . de 1111": 2, "x of abc": 0, None: None}
    got = run(spark, tmp_path, "I8_location_hints", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_hints for r in got} == dict(enumerate(texts.values()))


@pytest.mark.parametrize("kept", [0, 1])
def test_f1_ranks_as_its_sql(spark, tmp_path, kept):
    """Scores on a half of the fourth place; then with a null and an empty text, of which the first has no length."""
    r = random.Random(93)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 30)))) for i in range(1000)]
    rows += kept * [(1000, None), (1001, "")]
    spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "f"), (4, "g h a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = run(spark, tmp_path, "F1_score_ranks", "documents", rows, "doc_id long, text string")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duck.sql(entry.oracle_sql()["F1_score_ranks"]).fetchall())


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from caseloom.sources import files

folder = sys.argv[1]
conf = {"spark.master": "local-cluster[1,1,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.local.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
rows = [(i, f"N{i}", i % 5) for i in range(25)]
spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
got = entry.queries()["A15_relational_store"](spark, folder)
assert sorted(map(tuple, got.collect())) == [r for r in rows if r[2] != 3]

files.HELD_ROWS = 300
url = "jdbc:derby:memory:odd;create=true"
files.transaction(spark, url, ['CREATE TABLE odd ("select" INT PRIMARY KEY, t VARCHAR(64), d DATE, n DECIMAL(9, 2))'])
made = spark.sql("SELECT CAST(id AS INT) AS `select`, IF(id % 2 = 0, 'a\\n' || id, NULL) AS t, date_add(DATE'2024-02-28', CAST(id AS INT)) AS d, CAST(id / 8 AS DECIMAL(9, 2)) AS n FROM range(0, 1001, 1, 3)")
files.write_jdbc(made, url, "odd")
read = lambda: files.jdbc(spark, url, "SELECT * FROM odd", '"select"', 0, 9, 2)
assert sorted(map(tuple, read().collect())) == sorted(map(tuple, made.collect()))
try:
    files.write_jdbc(spark.sql("SELECT CAST(id AS INT) AS `select`, '' AS t, DATE'2024-01-01' AS d, CAST(0 AS DECIMAL(9, 2)) AS n FROM range(1000, 2000) ORDER BY id DESC"), url, "odd")
    raise SystemExit("a repeated key was taken")
except Exception:
    pass
assert read().count() == 1001
assert files.jdbc(spark, url, 'SELECT * FROM odd WHERE "select" < 0', '"select"', 0, 9, 2).count() == 0
"""


def test_a15_runs_where_tasks_have_their_own_processes(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": home, "PYTHONDONTWRITEBYTECODE": "1"}
    ran = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert ran.returncode == 0, ran.stderr[-3000:]
