"""Evaluation: classification and entity metrics, calibration, percentiles, bootstrap, simulated systems."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import vectors
from caseloom.functions.scores import first_match

from .keyed import percentiles
from .spans import bio_spans

MODES = ["EXECUTE", "REQUEST_CLARIFICATION", "RE_EVALUATE", "REJECT_IGNORE"]


def per_class(rows: DataFrame, gold: str, predicted: str, classes: list) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) of every declared class; 0 where undefined.

    One pass: each row counts for its gold and its predicted class.
    """
    g, p = F.col(gold), F.col(predicted)
    sides = F.array(F.struct(g.alias("class"), (g.eqNullSafe(p)).alias("tp"), F.lit(False).alias("fp"), (~g.eqNullSafe(p)).alias("fn"), F.lit(True).alias("own")), F.struct(p.alias("class"), F.lit(False).alias("tp"), (~g.eqNullSafe(p)).alias("fp"), F.lit(False).alias("fn"), F.lit(False).alias("own")))
    total = rows.select(F.explode(sides).alias("s")).groupBy("s.class").agg(*(F.count_if(F.col(f"s.{c}")).alias(c) for c in ("tp", "fp", "fn")), F.count_if("s.own").alias("support"))
    declared = rows.sparkSession.createDataFrame([(c,) for c in classes], rows.select(g.alias("class")).schema)
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = declared.join(total, "class", "left").select("class", *(zero(F.col(c)).alias(c) for c in ("tp", "fp", "fn", "support")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    full = full.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return full.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(rows: DataFrame, gold: str, predicted: str, classes: list) -> DataFrame:
    return per_class(rows, gold, predicted, classes).agg(F.avg("f1").alias("macro_f1"))


def calibration_bin(confidence: Column, bins: int) -> Column:
    """Equal-width bin of a confidence: (lower, upper], the first one holds 0 too."""
    return F.least(F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def ece(rows: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """One row: expected calibration error."""
    by = rows.groupBy(calibration_bin(F.col(confidence), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(correct.cast("double")).alias("acc"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def temperature(rows: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 10.0, tolerance: float = 1e-5, grid: int = 12) -> float:
    """The temperature of least mean negative log likelihood; 1 without rows.

    The likelihood is unimodal in log T.  Each pass scores a whole grid of
    temperatures in one aggregate and keeps the cells beside the best, so a few
    scans replace a search of one scan per step.
    """
    while math.log(high / low) > tolerance:
        points = [low * (high / low) ** (i / grid) for i in range(grid + 1)]
        each = F.transform(F.array(*map(F.lit, points)), lambda t: vectors.nll(F.col(logits), F.col(label), t))
        got = {x["i"]: x["nll"] for x in rows.select(F.posexplode(each).alias("i", "nll")).groupBy("i").agg(F.avg("nll").alias("nll")).collect()}
        if not got or got[0] is None:
            return 1.0
        best = min(range(grid + 1), key=lambda i: got[i])
        low, high = points[max(best - 1, 0)], points[min(best + 1, grid)]
    return round(math.sqrt(low * high), 4)


def entity_metrics(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over sets of entities; two empty sets are perfect."""
    g, p = gold.select(*key).distinct().withColumn("g", F.lit(1)), predicted.select(*key).distinct().withColumn("p", F.lit(1))
    n = g.join(p, key, "full").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fp + fn) == 0
    ratio = lambda a, b: F.when(none, 1.0).when(b > 0, a / b).otherwise(0.0)
    return n.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def token_metrics(rows: DataFrame, key: list[str], order: list[str], gold: str, predicted: str, names: dict[int, str], ignored: int = -100) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, accuracy): entities of label ids by type, and of all (ALL).

    Tokens whose gold id is ``ignored`` are left out before places are counted; runs of
    B-/I- tags are entities, which count as found if label, first and last token agree.
    """
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    tag = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.lit("O"))
    used = rows.where(F.col(gold) != ignored)
    placed = used.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).alias("i"), tag(gold).alias("gold"), tag(predicted).alias("predicted"))
    entities = lambda c: bio_spans(placed.select(*key, "i", F.col("i").alias("a"), F.col("i").alias("z"), F.col(c).alias("tag")), key, "i", "tag", "a", "z").drop("n_tokens")
    match = [*key, "label", "span_start", "span_end"]
    both = entities("gold").withColumn("g", F.lit(1)).join(entities("predicted").withColumn("p", F.lit(1)), match, "full")
    n = both.select(F.explode(F.array(F.col("label"), F.lit("ALL"))).alias("label"), "g", "p").groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    # One row: a broadcast of fixed size.
    accuracy = F.broadcast(placed.agg(F.coalesce(F.avg((F.col("gold") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy")))
    return n.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")).crossJoin(accuracy)


def head_table(rows: DataFrame, head: str, gold: str, predicted: str, confidence: str, classes: list, bins: int = 10) -> DataFrame:
    """(head, macro_f1, accuracy, ece) of each head, and their averages as the head `overall`; one pass and a merge of bins."""
    right = (F.col(gold) == F.col(predicted)).cast("double")
    hits = [F.count_if((F.col(gold) == c) & (F.col(predicted) == c)).alias(f"t{i}") for i, c in enumerate(classes)]
    sides = [(F.count_if(F.col(gold) == c) + F.count_if(F.col(predicted) == c)).alias(f"b{i}") for i, c in enumerate(classes)]
    by = rows.groupBy(F.col(head).alias("head"), calibration_bin(F.col(confidence), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(right).alias("a"), *hits, *sides)
    f1 = F.lit(0.0)
    for i in range(len(classes)):
        f1 = f1 + F.when(F.sum(f"b{i}") > 0, 2 * F.sum(f"t{i}") / F.sum(f"b{i}")).otherwise(0.0)
    each = by.groupBy("head").agg((f1 / len(classes)).alias("macro_f1"), (F.sum("a") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))
    return each.unionByName(each.agg(*(F.avg(c).alias(c) for c in ("macro_f1", "accuracy", "ece"))).withColumn("head", F.lit("overall")))


def draw(seed: int, replicate: Column, place: Column, n: Column) -> Column:
    """A family number in [0, n) for one draw of one replicate: hashed, so any engine repeats it."""
    return F.floor(vectors.unit_hash(F.concat_ws(":", F.lit(str(seed)), replicate, place)) * n).cast("int")


def bootstrap(families: DataFrame, total: str, count: str, resamples: int, seed: int = 42) -> DataFrame:
    """(replicate, mean): means of resampled families from their sums and counts.

    ``families`` has one row for each family with ``at`` (0..n-1); rows are never
    resampled, only these sufficient statistics.
    """
    n = families.count()
    spark = families.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("place"))
    draws = draws.withColumn("at", draw(seed, F.col("replicate"), F.col("place"), F.lit(n)))
    return draws.join(families, "at").groupBy("replicate").agg((F.sum(total) / F.sum(count)).alias("mean"))


def interval(means: DataFrame) -> DataFrame:
    # One row for each replicate, whatever the input.
    return means.agg(F.percentile("mean", 0.025).alias("ci_lower"), F.avg("mean").alias("mean"), F.percentile("mean", 0.975).alias("ci_upper"))


def evaluation_samples(spark, categories: list[str], families: int = 24, per_family: int = 8) -> DataFrame:
    """The deterministic evaluation set: families by profiles 0..7."""
    s = spark.range(families * per_family).select(F.format_string("eval-%04d", F.col("id") + 1).alias("case_id"), F.floor(F.col("id") / per_family).cast("int").alias("family"), (F.col("id") % per_family % 8).cast("int").alias("profile"))
    p = F.col("profile")
    action = F.when(p.isin(4, 5, 6), "RE_EVALUATE").when(p.isin(0, 7), "EXECUTE").when(p.isin(1, 2), "REQUEST_CLARIFICATION").otherwise("REJECT_IGNORE")
    complete = F.when(p.isin(0, 6, 7), "SUFFICIENT").when(p == 2, "AMBIGUOUS").otherwise("INCOMPLETE")
    risk = F.when(p.isin(4, 5), "HIGH").when(p.isin(1, 3), "LOW").otherwise("MEDIUM")
    # Profiles whose texts name a street, and (after its category) the category's plain words.
    named = F.array(*map(F.lit, categories))[F.col("family") % len(categories)]
    return s.select("case_id", F.format_string("fam-%03d", "family").alias("family_id"), "family", "profile", named.alias("category"), risk.alias("risk"), complete.alias("completeness"), action.alias("action"), p.isin(4, 5).alias("is_conflict"), (p == 6).alias("is_prohibited"), p.isin(0, 4, 5, 6, 7).alias("has_address"), (~F.contains(named, F.lit("_"))).alias("has_keyword"))


# Cost in USD and latency in ms of the simulated systems.
SYSTEMS = {"P": (0.0005, 35.0), "B0": (0.0, 5.0), "B1": (0.015, 1200.0), "B2": (0.006, 350.0), "B3": (0.001, 50.0), "B4": (0.025, 1550.0), "A1": (0.0012, 45.0), "A2": (0.0008, 38.0), "A3": (0.0004, 30.0), "A4": (0.001, 40.0), "A5": (0.032, 1800.0)}


def run_systems(samples: DataFrame) -> DataFrame:
    """(samples.*, system, mode, correct, passed, cost, latency): eleven decision rules on every sample."""
    conflict, banned, spam = F.col("is_conflict"), F.col("is_prohibited"), F.col("action") == "REJECT_IGNORE"
    full = F.col("completeness") == "SUFFICIENT"
    ask, run, again, no = "REQUEST_CLARIFICATION", "EXECUTE", "RE_EVALUATE", "REJECT_IGNORE"
    confident = first_match([(banned, again), (conflict, run), (spam, ask), (full, run)], ask)
    careful = first_match([(banned, again), (spam, no), (conflict, again), (full, run)], ask)
    modes = {
        "P": first_match([(spam, no), (banned, again), (conflict, again), (full, run)], ask),
        "B0": first_match([(banned | spam, no), (F.col("has_address") & F.col("has_keyword") & ~conflict & full, run), (~F.col("has_address"), ask)], no),
        "B1": first_match([(banned, again), (spam, no), (full & ~conflict, run), (~full, ask)], run),
        "B2": first_match([(banned, again), (spam, no), (full & ~conflict, run), (~full, ask)], again),
        "B3": confident,
        "B4": careful,
        "A1": confident,
        "A2": first_match([(banned, again), (conflict, run), (spam, no), (full, run)], ask),
        "A3": first_match([(banned, again), (spam, no), (conflict, ask), (full, run)], ask),
        "A4": first_match([(banned, run), (spam, no), (conflict, again), (full, run)], ask),
        "A5": careful,
    }
    cells = F.array(*(F.struct(F.lit(k).alias("system"), m.alias("mode"), F.lit(SYSTEMS[k][0]).alias("cost"), F.lit(SYSTEMS[k][1]).alias("latency")) for k, m in modes.items()))
    out = samples.withColumn("s", F.explode(cells)).select(*samples.columns, "s.*")
    extra = (F.col("system") == "P") & F.col("is_conflict")
    out = out.withColumn("cost", F.col("cost") + F.when(extra, 0.002).otherwise(0.0)).withColumn("latency", F.col("latency") + F.when(extra, 85.0).otherwise(0.0))
    advisory = (F.col("system") == "A4") & F.col("is_prohibited")
    return out.withColumn("correct", (F.col("mode") == F.col("action")) & ~advisory).withColumn("passed", advisory)


def system_table(results: DataFrame) -> DataFrame:
    """One row for each system: macro-F1 over the four modes, accuracy, conditional rates, costs and latencies."""
    f1 = None
    tp = lambda m: F.count_if((F.col("mode") == m) & (F.col("action") == m))
    either = lambda m: F.count_if(F.col("mode") == m) + F.count_if(F.col("action") == m)
    for m in MODES:
        one = F.when(either(m) > 0, 2 * tp(m) / either(m)).otherwise(0.0)
        f1 = one if f1 is None else f1 + one
    share = lambda hit, of: F.when(F.count_if(of) > 0, F.count_if(of & hit) / F.count_if(of)).otherwise(0.0)
    table = results.groupBy("system").agg(
        (f1 / len(MODES)).alias("macro_f1"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        share(F.col("mode") == "EXECUTE", F.col("is_conflict")).alias("conflict_executed"),
        share(F.col("passed"), F.col("is_prohibited")).alias("prohibited_passed"),
        F.avg("cost").alias("mean_cost"),
        F.avg("latency").alias("mean_latency"),
    )
    return table.join(percentiles(results, ["system"], "latency", {"p95_latency": 0.95}), "system", "left")


def gates(metrics: DataFrame, name: str, value: str, threshold: str) -> DataFrame:
    """Add passed: names of losses, latencies, errors, costs and calibration errors are better when lower."""
    lower = F.lower(name).rlike("loss|latency|error|cost|ece|time_ms")
    return metrics.withColumn("passed", F.when(F.col(threshold).isNull(), F.lit(True)).when(lower, F.col(value) <= F.col(threshold)).otherwise(F.col(value) >= F.col(threshold)))
