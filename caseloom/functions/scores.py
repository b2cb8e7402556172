"""Decision arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 10 % quantile of the normal distribution.
LOWER_10 = -1.2815515655446004


def rounded(x: Column, places: int) -> Column:
    """A double at ``places`` decimals as C and DuckDB round it: a half of the scaled double goes away from zero.

    ``F.round`` goes by the shortest decimals of ``x`` itself, so halves that scaling moves fall otherwise.
    """
    return F.round(x * 10.0**places) / 10.0**places


def trust(successes: Column, total: Column, ece: Column, drift: Column, parent_successes: Column, parent_total: Column, quality: Column, strength: float = 20.0, least: int = 30) -> Column:
    """Beta shrinkage towards the parent's rate: struct(posterior_mean, lower_bound, reliability, used_parent)."""
    prior = (parent_successes + 1.0) / (parent_total + 2.0)
    n, k = F.coalesce(total, F.lit(0)), F.coalesce(successes, F.lit(0))
    a, b = k + strength * prior, n - k + strength * (1.0 - prior)
    mean = a / (a + b)
    var = a * b / ((a + b) * (a + b) * (a + b + 1.0))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    low = clip(mean + LOWER_10 * F.sqrt(var))
    weight = clip(low * (1.0 - F.coalesce(ece, F.lit(0.0))) * quality * (1.0 - F.coalesce(drift, F.lit(0.0))))
    return F.struct(mean.alias("posterior_mean"), low.alias("lower_bound"), weight.alias("reliability"), (total.isNull() | (n < least)).alias("used_parent"))


def conflict(kind: Column, left: Column, right: Column, left_trust: Column, right_trust: Column, weight: Column, route_changes: Column, visual_required: Column) -> Column:
    """struct(severity, score, resolver) of two differing values; null where they agree."""
    score = F.when(kind == "AUTHORITY", 1.0).otherwise(F.least(F.lit(1.0), F.least(left_trust, right_trust) * weight))
    # Ordered: the first rule that holds decides.
    rule = (
        F.when(kind == "AUTHORITY", F.lit("HARD/POLICY_CORRECTION"))
        .when((kind == "RISK") & (weight >= 0.8), "CRITICAL/LOCAL_VERIFICATION")
        .when((kind == "TEXT_IMAGE") & visual_required, "CRITICAL/CLARIFICATION")
        .when(kind.isin("LOCATION", "ENTITY", "EVIDENCE") | route_changes, "MATERIAL/CLARIFICATION")
        .otherwise("MINOR/LOCAL_VERIFICATION")
    )
    found = F.struct(F.split_part(rule, F.lit("/"), F.lit(1)).alias("severity"), score.alias("score"), F.split_part(rule, F.lit("/"), F.lit(2)).alias("resolver"))
    return F.when(F.lower(F.trim(left)) != F.lower(F.trim(right)), found)


def information_value(gain: Column, usd: Column, latency_ms: Column, egress_bytes: Column, queue_ms: Column) -> Column:
    return gain - (usd + latency_ms / 1000.0 + egress_bytes / 1_000_000.0 + queue_ms / 1000.0)


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds; an unknown (null) condition does not hold."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def priority(risk: Column) -> Column:
    return F.when(risk == "URGENT", 0).when(risk == "HIGH", 1).when(risk == "MEDIUM", 2).when(risk == "LOW", 3).otherwise(2)


def epoch_or_iso(value: Column, now: Column | None = None) -> Column:
    """Timestamp of epoch seconds, epoch milliseconds (above 1e11), or ISO-8601 text; else ``now``."""
    number = value.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    parsed = F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), value.try_cast("timestamp"))
    return parsed if now is None else F.coalesce(parsed, now)
