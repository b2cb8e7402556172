"""Queries over metrics, calibration, bootstrap and the simulated systems (families C19, E, J9, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import vectors
from caseloom.operators import metrics
from caseloom.operators.cases import CATEGORIES
from caseloom.operators.datasets import split_hash
from caseloom.operators.keyed import percentiles, ranked

from .registry import query, table

GOLD_SQL = "SELECT l.doc_id, quality AS gold, CASE WHEN n_chars % 7 = 0 THEN 1 - quality ELSE quality END AS predicted, source, ((n_chars % 100) / 100.0)::DOUBLE AS confidence FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    return rows.select("doc_id", F.col("quality").alias("gold"), F.when(F.col("n_chars") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"), "source", ((F.col("n_chars") % 100) / 100.0).alias("confidence"))


CLASS_SQL = f"""
WITH r AS ({GOLD_SQL}), c AS (SELECT unnest([0, 1, 2]) AS class),
n AS (SELECT class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (gold <> class AND predicted = class) AS fp, count(*) FILTER (gold = class AND predicted <> class) AS fn FROM c, r GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM n)"""


@query("E8_class_metrics", CLASS_SQL + "SELECT class, tp, fp, fn, round(p, 6)::DOUBLE AS precision, round(rc, 6)::DOUBLE AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6)::DOUBLE AS f1 FROM m")
def e8(spark, d):
    m = metrics.per_class(_gold(spark, d), "gold", "predicted", [0, 1, 2])
    return m.select("class", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("E9_macro_f1", CLASS_SQL + "SELECT round(avg(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END), 6)::DOUBLE AS macro_f1 FROM m")
def e9(spark, d):
    return metrics.macro_f1(_gold(spark, d), "gold", "predicted", [0, 1, 2]).select(F.round("macro_f1", 6).alias("macro_f1"))


SYSTEM_SQL = "r AS (SELECT o_orderpriority AS system, CASE o_orderstatus WHEN 'F' THEN 'EXECUTE' WHEN 'O' THEN 'REQUEST_CLARIFICATION' ELSE 'RE_EVALUATE' END AS mode, CASE o_custkey % 4 WHEN 0 THEN 'EXECUTE' WHEN 1 THEN 'REQUEST_CLARIFICATION' WHEN 2 THEN 'RE_EVALUATE' ELSE 'REJECT_IGNORE' END AS action, o_custkey % 3 = 0 AS is_conflict, o_custkey % 5 = 0 AS is_prohibited, o_custkey % 5 = 0 AND o_orderkey % 7 = 0 AS passed, o_totalprice / 1000 AS cost, o_totalprice AS latency FROM orders)"


@query("E10_system_metrics", f"""
WITH {SYSTEM_SQL}, m AS (SELECT unnest({metrics.MODES}) AS m), f AS (SELECT system, m, count(*) FILTER (mode = m AND action = m) AS tp, count(*) FILTER (mode = m) + count(*) FILTER (action = m) AS both_ FROM r, m GROUP BY 1, 2), g AS (SELECT system, avg(CASE WHEN both_ > 0 THEN 2 * tp / both_ ELSE 0 END) AS f1 FROM f GROUP BY 1)
SELECT system, round(any_value(f1), 6)::DOUBLE AS macro_f1, round(avg((mode = action)::INT), 6)::DOUBLE AS accuracy, round(coalesce(avg((mode = 'EXECUTE')::INT) FILTER (is_conflict), 0), 6)::DOUBLE AS conflict_executed, round(coalesce(avg(passed::INT) FILTER (is_prohibited), 0), 6)::DOUBLE AS prohibited_passed, round(avg(cost), 4) AS mean_cost, round(avg(latency), 2) AS mean_latency, round(quantile_cont(latency, 0.95), 2) AS p95_latency FROM r JOIN g USING (system) GROUP BY 1""")
def e10(spark, d):
    """Orders as results of five systems."""
    status, k = F.col("o_orderstatus"), F.col("o_custkey")
    mode = F.when(status == "F", "EXECUTE").when(status == "O", "REQUEST_CLARIFICATION").otherwise("RE_EVALUATE")
    action = F.when(k % 4 == 0, "EXECUTE").when(k % 4 == 1, "REQUEST_CLARIFICATION").when(k % 4 == 2, "RE_EVALUATE").otherwise("REJECT_IGNORE")
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("system"), mode.alias("mode"), action.alias("action"), (k % 3 == 0).alias("is_conflict"), (k % 5 == 0).alias("is_prohibited"), ((k % 5 == 0) & (F.col("o_orderkey") % 7 == 0)).alias("passed"), (F.col("o_totalprice") / 1000).alias("cost"), F.col("o_totalprice").alias("latency"))
    t = metrics.system_table(r.withColumn("correct", F.col("mode") == F.col("action")))
    places = {"macro_f1": 6, "accuracy": 6, "conflict_executed": 6, "prohibited_passed": 6, "mean_cost": 4, "mean_latency": 2, "p95_latency": 2}
    return t.select("system", *(F.round(c, n).alias(c) for c, n in places.items()))


@query("E11_calibration_error", f"WITH r AS ({GOLD_SQL}), b AS (SELECT least(greatest(ceil(confidence * 10) - 1, 0), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg((gold = predicted)::INT) AS a FROM r GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6)::DOUBLE AS ece FROM b")
def e11(spark, d):
    return metrics.ece(_gold(spark, d), "confidence", F.col("gold") == F.col("predicted")).select(F.round("ece", 6).alias("ece"))


NLL = "ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label % 4 + 1]"


@query("E12_mean_nll", f"WITH t AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / 0.1) AS z FROM embeddings) SELECT round(avg({NLL.replace('label % 4 + 1', 'label + 1')}), 6) AS nll FROM t")
def e12(spark, d):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").agg(F.round(F.avg(vectors.nll(logits, F.col("label").cast("int"), 0.1)), 6).alias("nll"))


@query("E13_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def e13(spark, d):
    p = percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("E14_stress_summary", "SELECT event_type AS mode, count(*) AS n, count(DISTINCT user_id) AS tickets, count(*) - count(DISTINCT user_id) AS duplicates, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000 * 3600, 6)::DOUBLE AS per_hour FROM events GROUP BY 1")
def e14(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    n, u = F.count(F.lit(1)), F.count_distinct("user_id")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(n.alias("n"), u.alias("tickets"), (n - u).alias("duplicates"), F.round(n / (us(F.max("ts")) - us(F.min("ts"))) * 1000000 * 3600, 6).alias("per_hour"))


@query("E15_entity_metrics", """
WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT count(*) FILTER (g.l_orderkey IS NOT NULL AND p.l_orderkey IS NOT NULL) AS tp, count(*) FILTER (g.l_orderkey IS NULL) AS fp, count(*) FILTER (p.l_orderkey IS NULL) AS fn FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.l_linenumber = p.l_linenumber)
SELECT tp, fp, fn, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM n""")
def e15(spark, d):
    li = table(spark, d, "lineitem")
    m = metrics.entity_metrics(li.where("l_returnflag = 'A'"), li.where("l_linestatus = 'F'"), ["l_orderkey", "l_linenumber"])
    return m.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


LABELS = ["O", "B-LOC", "I-LOC", "B-OBJ", "I-OBJ", "B-TIME", "I-TIME"]


@query("E16_token_metrics", f"""
WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, ({LABELS})[l_partkey % 7 + 1] AS gold, ({LABELS})[CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 7 ELSE l_partkey % 7 END + 1] AS pred, l_linenumber = 7 AS skip FROM lineitem),
u AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, gold, pred FROM t WHERE NOT skip), s AS (SELECT 'g' AS side, k, i, gold AS tag FROM u UNION ALL SELECT 'p', k, i, pred FROM u), l AS (SELECT *, CASE WHEN tag = 'O' THEN '' ELSE substr(tag, 3) END AS label FROM s), p AS (SELECT *, lag(label) OVER (PARTITION BY side, k ORDER BY i) AS before FROM l),
r AS (SELECT *, sum((tag LIKE 'B-%' OR (tag LIKE 'I-%' AND label IS DISTINCT FROM before))::INT) OVER (PARTITION BY side, k ORDER BY i) AS run FROM p), e AS (SELECT side, k, label, min(i) AS a, max(i) AS z FROM r WHERE label <> '' GROUP BY side, k, run, label),
b AS (SELECT coalesce(g.label, q.label) AS label, g.k IS NOT NULL AS ing, q.k IS NOT NULL AS inp FROM (SELECT * FROM e WHERE side = 'g') g FULL JOIN (SELECT * FROM e WHERE side = 'p') q ON g.k = q.k AND g.label = q.label AND g.a = q.a AND g.z = q.z),
c AS (SELECT label, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM b GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FILTER (ing AND inp), count(*) FILTER (NOT ing), count(*) FILTER (NOT inp) FROM b)
SELECT label, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 4)::DOUBLE AS f1, (SELECT round(avg((gold = pred)::INT), 4) FROM u)::DOUBLE AS accuracy FROM c""")
def e16(spark, d):
    """Lines of an order as tokens with label ids; the seventh is ignored."""
    order = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    ids = lambda c: F.when(F.col("l_linenumber") == 7, -100).otherwise(c.cast("int"))
    pred = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 7).otherwise(F.col("l_partkey") % 7)
    t = table(spark, d, "lineitem").select("l_orderkey", *order, ids(F.col("l_partkey") % 7).alias("gold"), pred.cast("int").alias("pred"))
    m = metrics.token_metrics(t, ["l_orderkey"], order, "gold", "pred", dict(enumerate(LABELS)))
    return m.select("label", "tp", "fp", "fn", F.round("f1", 4).alias("f1"), F.round("accuracy", 4).alias("accuracy"))


@query("E17_head_averages", f"""
WITH r AS ({GOLD_SQL}), c AS (SELECT source, class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) + count(*) FILTER (gold = class) AS both_ FROM r, (SELECT unnest([0, 1]) AS class) GROUP BY 1, 2), f AS (SELECT source, avg(CASE WHEN both_ > 0 THEN 2 * tp / both_ ELSE 0 END) AS macro_f1 FROM c GROUP BY 1),
a AS (SELECT source, avg((gold = predicted)::INT) AS accuracy FROM r GROUP BY 1), b AS (SELECT source, least(greatest(ceil(confidence * 10) - 1, 0), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg((gold = predicted)::INT) AS a FROM r GROUP BY 1, 2), e AS (SELECT source, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY 1), h AS (SELECT * FROM f JOIN a USING (source) JOIN e USING (source))
SELECT source AS head, round(macro_f1, 6)::DOUBLE AS macro_f1, round(accuracy, 6)::DOUBLE AS accuracy, round(ece, 6)::DOUBLE AS ece FROM h UNION ALL SELECT 'overall', round(avg(macro_f1), 6)::DOUBLE, round(avg(accuracy), 6)::DOUBLE, round(avg(ece), 6)::DOUBLE FROM h""")
def e17(spark, d):
    """Sources as heads, and the averages over them."""
    h = metrics.head_table(_gold(spark, d), "source", "gold", "predicted", "confidence", [0, 1])
    return h.select("head", *(F.round(c, 6).alias(c) for c in ("macro_f1", "accuracy", "ece")))


@query("E18_split_hash", "SELECT lang, count(*) AS n, sha256('salt' || chr(10) || string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS split_hash FROM documents GROUP BY 1")
def e18(spark, d):
    return split_hash(table(spark, d, "documents"), "lang", "doc_id", "salt")


@query("C19_metric_gates", """
WITH m AS (SELECT event_type || CASE WHEN event_type IN ('error', 'view') THEN '_latency' ELSE '_f1' END AS name, round(avg(value), 6) AS value FROM events GROUP BY 1)
SELECT name, value, CASE WHEN name LIKE '%latency%' OR name LIKE '%error%' THEN value <= 25 ELSE value >= 25 END AS passed FROM m""")
def c19(spark, d):
    kind = F.col("event_type")
    name = F.concat(kind, F.when(kind.isin("error", "view"), "_latency").otherwise("_f1"))
    m = table(spark, d, "events").groupBy(name.alias("name")).agg(F.round(F.avg("value"), 6).alias("value")).withColumn("threshold", F.lit(25.0))
    return metrics.gates(m, "name", "value", "threshold").select("name", "value", "passed")


@query("J9_temperature", f"""
WITH t AS (SELECT list_transform(embedding::DOUBLE[], lambda x: x * 10) AS l, CASE WHEN vec_id % 4 = 0 THEN label ELSE list_position(embedding, list_max(embedding)) - 1 END AS y FROM embeddings), c AS (SELECT unnest(range(3, 501)) / 50.0::DOUBLE AS temp), z AS (SELECT temp, list_transform(l, lambda x: x / temp) AS z, y FROM t, c),
a AS (SELECT temp, avg({NLL.replace('label % 4 + 1', 'y + 1')}) AS nll FROM z GROUP BY 1) SELECT round(arg_min(temp, nll), 1) AS temperature FROM a""")
def j9(spark, d):
    """The temperature that fits the embeddings as logits, three labels of four being the largest; the SQL tries a fine grid."""
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    label = F.when(F.col("vec_id") % 4 == 0, F.col("label").cast("int")).otherwise(vectors.argmax(F.col("embedding")))
    rows = table(spark, d, "embeddings").select(logits.alias("l"), label.alias("y"))
    return spark.createDataFrame([(round(metrics.temperature(rows, "l", "y"), 1),)], "temperature double")


BOOT_SQL = """
WITH f AS (SELECT (row_number() OVER (ORDER BY source) - 1)::INT AS fam, sum(n_chars) AS total, count(*) AS n, sum((n_chars > 1000)::INT) AS hits FROM documents GROUP BY source), k AS (SELECT count(*) AS k FROM f),
r AS (SELECT replicate, floor((('0x' || substr(sha256('42:' || replicate || ':' || place), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) * k)::INT AS fam FROM (SELECT unnest(range(200)) AS replicate), (SELECT unnest(range(k)) AS place, k FROM k))"""


def _families(spark, d):
    f = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("hits"))
    numbered = ranked(f.withColumn("_one", F.lit(0)).withColumn("_h", F.conv(F.rpad(F.hex("source"), 12, "0"), 16, 10).cast("double")), ["_one"], [F.col("_h"), F.col("source")], "at")
    return numbered.withColumn("at", F.col("at").cast("int")).drop("_one", "_h")


@query("L11_cluster_bootstrap", BOOT_SQL + ", m AS (SELECT replicate, sum(total) / sum(n) AS mean FROM r JOIN f USING (fam) GROUP BY 1) SELECT round(quantile_cont(mean, 0.025), 4)::DOUBLE AS ci_lower, round(avg(mean), 4)::DOUBLE AS mean, round(quantile_cont(mean, 0.975), 4)::DOUBLE AS ci_upper FROM m")
def l11(spark, d):
    out = metrics.interval(metrics.bootstrap(_families(spark, d), "total", "n", 200))
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("L12_paired_bootstrap", BOOT_SQL + ", m AS (SELECT replicate, (sum(hits) - sum(n - hits)) / sum(n) AS diff FROM r JOIN f USING (fam) GROUP BY 1) SELECT round(quantile_cont(diff, 0.025), 6)::DOUBLE AS ci_lower, round(quantile_cont(diff, 0.975), 6)::DOUBLE AS ci_upper, round(greatest(least(1.0, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))), 0.0001), 6)::DOUBLE AS p_value FROM m")
def l12(spark, d):
    f = _families(spark, d).withColumn("delta", 2 * F.col("hits") - F.col("n"))
    m = metrics.bootstrap(f, "delta", "n", 200)
    side = lambda c: F.avg(c.cast("double"))
    p = F.greatest(F.least(F.lit(1.0), 2 * F.least(side(F.col("mean") <= 0), side(F.col("mean") >= 0))), F.lit(0.0001))
    return m.agg(F.round(F.percentile("mean", 0.025), 6).alias("ci_lower"), F.round(F.percentile("mean", 0.975), 6).alias("ci_upper"), F.round(p, 6).alias("p_value"))


SAMPLES_SQL = "SELECT 'eval-' || lpad((i + 1)::VARCHAR, 4, '0') AS case_id, (i // 8)::INT AS family, (i % 8)::INT AS profile FROM (SELECT unnest(range(192)) AS i)"
ACTION_SQL = "CASE WHEN profile IN (4, 5, 6) THEN 'RE_EVALUATE' WHEN profile IN (0, 7) THEN 'EXECUTE' WHEN profile IN (1, 2) THEN 'REQUEST_CLARIFICATION' ELSE 'REJECT_IGNORE' END"


@query("L14_evaluation_samples", f"SELECT case_id, family, profile, {ACTION_SQL} AS action, profile IN (4, 5) AS is_conflict, profile = 6 AS is_prohibited FROM ({SAMPLES_SQL})")
def l14(spark, d):
    return metrics.evaluation_samples(spark, CATEGORIES).select("case_id", "family", "profile", "action", "is_conflict", "is_prohibited")


#: Macro-F1, accuracy, conflicts executed, prohibited passed, mean cost, mean latency.
TABLE = {
    "P": (1.0, 1.0, 0.0, 0.0, 0.0010, 56.25), "B0": (0.4539, 0.4583, 0.0, 0.0, 0.0, 5.0), "B1": (0.7917, 0.75, 0.0, 0.0, 0.015, 1200.0), "B2": (0.7917, 0.75, 0.0, 0.0, 0.006, 350.0),
    "B3": (0.4917, 0.625, 1.0, 0.0, 0.001, 50.0), "B4": (1.0, 1.0, 0.0, 0.0, 0.025, 1550.0), "A1": (0.4917, 0.625, 1.0, 0.0, 0.0012, 45.0), "A2": (0.7917, 0.75, 1.0, 0.0, 0.0008, 38.0),
    "A3": (0.7917, 0.75, 0.0, 0.0, 0.0004, 30.0), "A4": (0.9, 0.875, 0.0, 1.0, 0.001, 40.0), "A5": (1.0, 1.0, 0.0, 0.0, 0.032, 1800.0),
}
TABLE_SQL = ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in TABLE.items())


@query("L13_simulated_systems", f"SELECT * FROM (VALUES {TABLE_SQL}) v(system, macro_f1, accuracy, conflict_executed, prohibited_passed, mean_cost, mean_latency)")
def l13(spark, d):
    t = metrics.system_table(metrics.run_systems(metrics.evaluation_samples(spark, CATEGORIES)))
    return t.select("system", *(F.round(c, 4).alias(c) for c in ("macro_f1", "accuracy", "conflict_executed", "prohibited_passed", "mean_cost", "mean_latency")))


@query("L15_verdicts", f"WITH t AS (SELECT * FROM (VALUES {TABLE_SQL}) v(system, f1, acc, ce, pp, cost, lat)) SELECT o.system, p.f1 > o.f1 AS better_f1, p.cost < o.cost AS cheaper, p.pp <= o.pp AS as_safe FROM t p, t o WHERE p.system = 'P' AND o.system <> 'P'")
def l15(spark, d):
    t = metrics.system_table(metrics.run_systems(metrics.evaluation_samples(spark, CATEGORIES))).select("system", *(F.round(c, 4).alias(c) for c in ("macro_f1", "mean_cost", "prohibited_passed")))
    # One row: a broadcast of fixed size.
    p = F.broadcast(t.where("system = 'P'").select(F.col("macro_f1").alias("f"), F.col("mean_cost").alias("c"), F.col("prohibited_passed").alias("s")))
    return t.where("system <> 'P'").join(p).select("system", (F.col("f") > F.col("macro_f1")).alias("better_f1"), (F.col("c") < F.col("mean_cost")).alias("cheaper"), (F.col("s") <= F.col("prohibited_passed")).alias("as_safe"))
