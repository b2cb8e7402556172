"""Operator 6 (native): quality rules by robust multivariate outliers.

Statistics of each whole text come from string and higher-order functions.
Documents that pass the base rules get a vector of five transformed statistics;
for each group (language and source, language, all) a minimum-covariance-
determinant estimate of location and scatter is fitted, and a document goes if
its Mahalanobis distance by the most specific group with ``least_rows`` rows is
beyond the cut.

The estimate is the usual one by concentration steps: distances by the present
estimate, then mean and covariance of the ``share`` of rows that are nearest.  A step
never raises the determinant of the covariance.  Each group has two starts, medians with
median deviations and the plain mean with the plain covariance; both take steps until no
logarithm of a determinant moves by more than ``TOLERANCE`` (``steps`` at most), and the start with the
lesser determinant stays.  Then the estimate is reweighted: mean and covariance of all
rows whose scaled distance is within the 0.975 quantile of the chi-square.  Distances are
scaled so that their median in the group is that of the chi-square (the consistency factor).

Which rows are nearest follows from a histogram of distances (256 bins for each factor
e), so that no group is sorted; bins that tie at the edge are taken whole.  Every step is
partial sums by group and an equality join with two rows for each group.  Covariances
get a floor on the diagonal (``FLOORS``): symbols, repeated lines and repeated words are zero
for most texts, which would make them singular, and the floor is about what one event does
in a text of the usual length; each statistic can pass the cut alone within the base rules.

Windows of five words are compared by a 64-bit hash; two different windows of a
text share one with a chance below 1e-10 for a text of 20,000 words.

Null and empty texts have all counts 0, fail the base rules and are not kept.
Null language or source is a group like any other.  Repeated rows are rows of
their own, and equal texts of a group get equal verdicts.  Very long texts are read
whole.  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import forget, written

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
P = 5
FLOORS = (0.3, 0.15, 0.15, 0.3, 0.5)
BINS = 256
FEW_GROUPS = 10_000
SALTS = 64
TOLERANCE = 1e-2
MEANS = [f"m{i}" for i in range(P)]
WEIGHTS = [f"w{i}{j}" for i in range(P) for j in range(i + 1)]
VALUES = [f"x{i}" for i in range(P)]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.select("*", t.alias("_t"))
    trimmed = F.expr(r"btrim(_t, ' \t\n\u000B\u000C\r')")
    df = df.select("*", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP + "+")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    window = "transform(sequence(1, size(_w) - 4), i -> xxhash64(element_at(_w, i), element_at(_w, i + 1), element_at(_w, i + 2), element_at(_w, i + 3), element_at(_w, i + 4)))"
    df = df.select("*", F.expr(f"CASE WHEN size(_w) > 5 THEN {window} ELSE cast(array() AS array<bigint>) END").alias("_h"))
    df = df.select("*", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h, i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END").alias("_s"))
    twice = "transform(_s, (x, j) -> CASE WHEN (j > 0 AND _s[j - 1].h = x.h) OR (j < size(_s) - 1 AND _s[j + 1].h = x.h) THEN x.i END)"
    covered = f"aggregate(array_sort(filter({twice}, x -> x IS NOT NULL)), named_struct('n', 0L, 'last', -5), (a, x) -> named_struct('n', a.n + least(5, x - a.last), 'last', x), a -> a.n)"
    return df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        (F.char_length("_t") - F.regexp_count("_t", F.lit(GAP))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_s) = 0 THEN 0L ELSE {covered} END").alias("n_repeat_words"),
    ).drop("_t", "_w", "_l", "_h", "_s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: length, word length, symbols, repeated lines, repeated words."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    share = lambda c, of: F.log1p(100 * F.col(c) / of)
    return [F.log(n), F.log(chars / n), share("n_symbols", chars), share("n_dup_lines", n), share("n_repeat_words", n)]


def chi_square(x: float, p: int) -> float:
    """The distribution function: a series for the incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_at(q: float, p: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, p) < q else (low, mid)
    return high


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _at_share(hist: DataFrame, by: list[str], share: float) -> DataFrame:
    """For a histogram (by, bin, n): the least bin that holds ``share`` of the rows with all bins below."""
    part = Window.partitionBy(*by)
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select(*by, "bin", upto.alias("upto"), F.sum("n").over(part).alias("total")).where(F.col("upto") >= F.col("total") * share).groupBy(*by).agg(F.min("bin").alias("bin"), F.first("total").alias("rows"))


def _medians(rows: DataFrame, value, name: str) -> DataFrame:
    """group -> name0..: medians of the values on a grid of 1/256."""
    long = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.round(value(i) * 256).cast("long").alias("bin")) for i in range(P)))).alias("v")).select("grp", "v.*")
    hist = long.groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    at = _at_share(hist, ["grp", "i"], 0.5)
    return at.groupBy("grp").agg(*(F.max(F.when(F.col("i") == i, F.col("bin") / 256.0)).alias(f"{name}{i}") for i in range(P)), F.max("rows").alias("rows"))


def _whitened(moments: DataFrame, by: list[str]) -> DataFrame:
    """From n, s_i, q_ij: mean m_i, the inverse Cholesky factor w_ij of the floored covariance, and logdet of the latter."""
    out = moments.select("*", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)))
    for i in range(P):
        for j in range(i + 1):
            cov = F.col(f"q{j}{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2
            done = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov - done, F.lit(1e-6))) if i == j else (cov - done) / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i + 1):
            if i == j:
                w = 1 / F.col(f"l{i}{i}")
            else:
                w = -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", w)
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log(F.col("l00"))) * 2
    return out.select(*by, *MEANS, *WEIGHTS, logdet.alias("logdet"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(P):
        y = sum((F.col(f"w{i}{j}") * (_x(j) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log1p(distance) * BINS).cast("int")


def _meet(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows with the rows of their group: up to ``FEW_GROUPS`` groups go to every task; more are joined by
    group and salt, so that the rows of a large group are dealt over ``SALTS`` parts."""
    if few:
        return rows.join(F.broadcast(groups), "grp")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["grp", "salt"])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, sums and sums of products of the values of rows about the group's medians c_i, where cancellation is small."""
    off = rows.select(*by, *((_x(i) - F.col(f"c{i}")).alias(f"x{i}") for i in range(P)))
    return off.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(_x(i)).alias(f"s{i}") for i in range(P)), *(F.sum(_x(j) * _x(i)).alias(f"q{j}{i}") for i in range(P) for j in range(i + 1)))


def _fitted(rows: DataFrame, centre: DataFrame, by: list[str]) -> DataFrame:
    """The estimate from the rows (with c_i): by, m_i, w_ij, logdet."""
    fit = _whitened(_moments(rows, by), by).join(centre, "grp")
    return fit.select(*by, *((F.col(f"m{i}") + F.col(f"c{i}")).alias(f"m{i}") for i in range(P)), *WEIGHTS, "logdet")


def _scaled(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """``now`` (one row a group) with scale, by which the median distance is that of a chi-square, and the group's rows."""
    hist = _meet(rows, now, few).select("grp", _bin(_distance()).alias("bin")).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    half = _at_share(hist, ["grp"], 0.5)
    scale = F.greatest(F.expm1((F.col("bin") + 0.5) / BINS) / chi_square_at(0.5, P), F.lit(1.0))
    return now.join(half.select("grp", scale.alias("scale"), "rows"), "grp")


def estimates(rows: DataFrame, share: float, steps: int, inner: float = 0.975) -> DataFrame:
    """grp -> m_i, w_ij, scale, rows for rows (grp, salt, x0..x4)."""
    mid = written(_medians(rows, _x, "c"), "medians")
    few = mid.count() <= FEW_GROUPS
    centre = mid.drop("rows")
    off = _medians(_meet(rows, centre, few), lambda i: F.abs(_x(i) - F.col(f"c{i}")), "d")
    none = F.lit(0.0)
    medians = centre.join(off.drop("rows"), "grp").select("grp", F.lit(0).alias("start"), *(F.col(f"c{i}").alias(f"m{i}") for i in range(P)), *((1 / (1.4826 * F.col(f"d{i}") + FLOORS[i]) if i == j else none).alias(f"w{i}{j}") for i in range(P) for j in range(i + 1)), F.lit(math.inf).alias("logdet"))
    means = _fitted(_meet(rows, centre, few), centre, ["grp"]).withColumn("start", F.lit(1)).withColumn("logdet", F.lit(math.inf))
    now = written(medians.unionByName(means), "estimates")
    for _ in range(steps):
        near = _meet(rows, now, few).select("grp", "salt", "start", *VALUES, _bin(_distance()).alias("bin"))
        edge = _at_share(near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp", "start"], share).select("grp", "start", F.col("bin").alias("edge"))
        kept = _meet(near, edge.groupBy("grp").agg(*(F.max(F.when(F.col("start") == k, F.col("edge"))).alias(f"edge{k}") for k in (0, 1))), few).where(F.col("bin") <= F.when(F.col("start") == 0, F.col("edge0")).otherwise(F.col("edge1")))
        step = _fitted(_meet(kept, centre, few), centre, ["grp", "start"]).join(now.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"])
        old, now = now, written(step, "estimates")
        moved = now.agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        forget(old)
        if moved is None or moved <= TOLERANCE:
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct(*MEANS, *WEIGHTS), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    best = written(_scaled(rows, written(best, "estimates"), few), "estimates")
    # Reweighting: all rows that the estimate finds usual.
    usual = _meet(rows, best.drop("rows"), few).where(_distance() / F.col("scale") <= chi_square_at(inner, P)).select("grp", "salt", *VALUES)
    final = written(_fitted(_meet(usual, centre, few), centre, ["grp"]).drop("logdet"), "estimates")
    return written(_scaled(rows, final, few), "estimates")


def quality(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", share: float = 0.75, steps: int = 6, cut: float = 1 - 1e-6, least_rows: int = 100) -> DataFrame:
    """(key, statistics, base_failed, distance, kept)."""
    named = df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = written(statistics(named).drop("text").withColumn("base_failed", base_failed()), "text-statistics")
    groups = [F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")), F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")), F.struct(F.lit(2).alias("level"), "lang", "source")]
    groups = [F.to_json(g, {"ignoreNullFields": "false"}) for g in groups]
    # The salt deals rows only; it follows no key, so rows that repeat one are dealt as well.
    fine = stats.where(~F.col("base_failed")).select(*(x.alias(f"x{i}") for i, x in enumerate(vector())), *(g.alias(f"g{k}") for k, g in enumerate(groups)), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    rows = written(fine.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), "salt", *(f"x{i}" for i in range(P))), "vectors")
    # Groups too small to decide need no estimate; the whole is the last resort.
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = written(size.where((F.col("n") >= least_rows) | (F.get_json_object("grp", "$.level") == "0")).select("grp"), "large-groups")
    rows = written(rows.join(F.broadcast(large) if large.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else large, "grp", "left_semi"), "vectors")
    fitted = estimates(rows, share, steps)
    # Each group takes the estimate of the most specific level with enough rows.
    large = fitted.where(F.col("rows") >= least_rows)
    names = stats.where(~F.col("base_failed")).select(*(g.alias(f"g{k}") for k, g in enumerate(groups))).distinct()
    pick = names
    for k in range(3):
        pick = pick.join(large.select(F.col("grp").alias(f"g{k}"), F.lit(1).alias(f"has{k}")), f"g{k}", "left")
    pick = pick.select(F.col("g2").alias("own"), F.coalesce(F.when(F.col("has2") == 1, F.col("g2")), F.when(F.col("has1") == 1, F.col("g1")), F.col("g0")).alias("grp"))
    chosen = written(pick.join(fitted, "grp").drop("grp", "rows"), "chosen-estimates")
    scored = stats.select("*", groups[2].alias("own"), *(F.when(~F.col("base_failed"), x).alias(f"x{i}") for i, x in enumerate(vector()))).join(chosen, "own", "left")
    scored = scored.withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square_at(cut, P))
    return scored.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
