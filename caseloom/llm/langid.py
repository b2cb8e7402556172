"""Operator 7: language identification by Bayesian fusion of evidence.

    log P(lang | row) = log P(lang | host)                  smoothed priors
                      + weight * sum log P(trigram | lang)   the text
                      + log P(declared | lang)               markup language
                      + log P(suffix | lang)                 address suffix

* Text: byte trigrams of the lower-cased letters, hashed to ``BUCKETS``; their
  counts come from at most about ``SAMPLE`` labelled rows, taken by a hash of the key.
* Host priors: soft language counts of all other rows of the host, shrunk towards
  those of the domain above, shrunk towards those of the whole table.  A row's own
  vote is taken out of the host and the domain, as its text counts by itself.
* P(declared | lang), P(suffix | lang): soft counts over all rows.

Everything but the trigram table is grouped aggregation over all rows; per host
there is one row of sums, so a hot host is only a sum with more partial sums.
Sources (documents, pages) are scanned one after another, and each scan leaves
fixed-size rows; markup is stripped in the worker, a chunk at a time.  The model has
every language of the sample, so its size is bounded by the sample's.

A row is rejected (language ``und``) if it holds no letter trigram, if its
trigrams are less likely in the best language than by an even spread over all
buckets, or if no language has a probability of ``least``.  Null and empty texts
are rejected; null hosts, declarations and suffixes add no evidence.  Very long
texts are read whole.  Equally likely languages: the first by name.  Repeated rows
vote and are judged each; an empty table gives no rows.  The caller's columns
travel as one struct, so none clashes with those used here.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, flat, lean
from .store import free_name, written

BUCKETS = 1 << 15
CHUNK = 1 << 19
SAMPLE = 20_000
SHRINK = 20.0
WEIGHT = 1 / 3

#: Letters (ASCII, lower-cased, and bytes of other scripts) keep their value; all else is a gap.
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(column) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, row offsets); runs without a letter have none."""
    buf, offs = flat(pc.utf8_lower(column.cast(pa.large_string())))
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    b = _LETTER[buf]
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    use = (b[:-2] > 0).astype(np.int8) + (b[1:-1] > 0) + (b[2:] > 0) >= 2
    edge = offs[1:-1]
    for k in (1, 2):  # none across rows
        cut = edge - k
        use[cut[(cut >= 0) & (cut < len(use))]] = False
    at = np.flatnonzero(use)
    return code[at].astype(np.int64), np.searchsorted(at, offs)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) from a bounded sample of labelled rows."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.select(lang).count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def run(batches):
        names, sums = [], {}
        for part in chunks(batches, text):
            bucket, first = _trigrams(part.column(text))
            for i, name in enumerate(part.column(lang).to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                    names.append(name)
                sums[name] += np.bincount(bucket[first[i] : first[i + 1]], minlength=BUCKETS)
        for name in names:
            some = np.flatnonzero(sums[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(sums[name][some])], names=["lang", "bucket", "n"])

    counts = rows.select(F.col(lang).alias(lang), text).mapInArrow(lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("seen")).collect()
    names = sorted(x["lang"] for x in got)
    table = np.full((len(names), BUCKETS), 0.05)
    for x in got:
        for bucket, times in x["seen"]:
            table[names.index(x["lang"]), bucket] += times
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(rb"<[^>]*>|&#?\w{1,8};")


def stripped(column) -> pa.Array:
    """The text of pages: without scripts, styles, comments, tags and character references."""
    pages = (None if x is None else _TAG.sub(b" ", _HIDDEN.sub(b" ", x)) for x in column.cast(pa.large_binary()).to_pylist())
    return pa.array(pages, pa.large_binary()).cast(pa.large_string())


def likelihoods(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", drop: bool = True, markup: bool = False) -> DataFrame:
    """Add n_grams and ll (array of the summed log likelihood of each language); the text itself is dropped.

    With ``markup`` the text is HTML, which is stripped first.
    """
    names, table = model
    rest = [f for f in df.schema.fields if f.name != text or not drop]
    schema = T.StructType([*rest, T.StructField("n_grams", T.LongType()), T.StructField("ll", T.ArrayType(T.FloatType()))])
    table = np.ascontiguousarray(table.astype(np.float32))
    k = len(names)

    def run(batches):
        for part in chunks(batches, text, CHUNK):
            bucket, first = _trigrams(stripped(part.column(text)) if markup else part.column(text))
            n = np.diff(first)
            ll = np.zeros((len(n), k), np.float32)
            some = np.flatnonzero(n)
            for i in range(k if len(some) else 0):  # a language at a time, so that no table of all of them is made
                ll[some, i] = np.add.reduceat(table[i][bucket], first[some], dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(n), lists], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _soft(score: Column) -> Column:
    """Probabilities of an array of log scores."""

    def shares(s: Column) -> Column:
        powers = _once(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
        return _once(powers, lambda e: _once(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))

    return _once(score, shares)


def _sums(k: int) -> list[Column]:
    return [F.sum(F.col("soft")[i]).alias(f"p{i}") for i in range(k)]


def identify(df: DataFrame | list[tuple[DataFrame, bool]], model: tuple[list[str], np.ndarray], text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, domain: str | None = None, least: float = 0.5, weight: float = WEIGHT) -> DataFrame:
    """(all columns but the text, n_grams, language, confidence, kept); names that are taken get a trailing underscore.

    ``df`` is a table, or several of the same columns, each with whether its text is markup.
    """
    sources = df if isinstance(df, list) else [(df, False)]
    df = sources[0][0]
    names, _ = model
    k = len(names)
    out = [c for c in df.columns if c != text]
    n_grams, language_name, confidence, kept_name = (free_name(df, c) for c in ("n_grams", "language", "confidence", "kept"))
    null = F.lit(None).cast("string")
    pick = lambda c: F.col(c).cast("string") if c else null
    # The columns of the caller travel as one, so none of them clashes with those used here.
    row = F.struct(*out) if out else F.struct(F.lit(0).alias("_none"))
    plain = lambda d: d.select(F.col(text).alias("text"), row.alias("_row"), F.lower(pick(declared)).alias("_declared"), pick(suffix).alias("_suffix"), pick(host).alias("_host"), pick(domain).alias("_domain"))
    rows = reduce(DataFrame.union, [written(likelihoods(plain(d), model, markup=markup), "likelihoods") for d, markup in sources])
    callers = [F.col("_row").getField(c).alias(c) for c in out]
    if not k:
        return rows.select(*callers, F.col("n_grams").alias(n_grams), F.lit("und").alias(language_name), F.lit(0.0).alias(confidence), F.lit(False).alias(kept_name))
    vote = _soft(F.transform("ll", lambda x: x.cast("double") * weight))
    told = rows.where("n_grams > 0").select("_declared", "_suffix", "_host", "_domain", vote.alias("soft"))
    whole = told.agg(F.count(F.lit(1)).alias("n"), *_sums(k)).first()
    total = [((whole[f"p{i}"] or 0.0) + 1.0) / (whole["n"] + k) for i in range(k)]
    counted = [F.count(F.lit(1)).alias("n"), *_sums(k)]
    shares = F.array(*(f"p{i}" for i in range(k)))

    def given(by: str, name: str) -> DataFrame:
        """by -> log P(value | language) up to a constant: log of P(language | value) / P(language), shrunk."""
        sums = told.where(F.col(by).isNotNull()).groupBy(by).agg(*counted)
        return written(sums.select(by, F.array(*(F.log((F.col(f"p{i}") + SHRINK * total[i]) / (F.col("n") + SHRINK) / total[i]) for i in range(k))).alias(name)), name)

    if host:
        of_domain = told.where("_domain IS NOT NULL").groupBy("_domain").agg(*counted).select(F.col("_domain").alias("_d"), F.col("n").alias("_n_domain"), shares.alias("_p_domain"))
        of_host = told.where("_host IS NOT NULL").groupBy("_host", "_domain").agg(*counted).select(F.col("_host").alias("_h"), "_domain", F.col("n").alias("_n_host"), shares.alias("_p_host"))
        of_host = of_host.join(of_domain, F.col("_domain") == F.col("_d"), "left").drop("_d").withColumnRenamed("_domain", "_d")
        of_host = written(of_host, "host-sums")
        rows = rows.join(of_host, (F.col("_host") == F.col("_h")) & F.col("_domain").eqNullSafe(F.col("_d")), "left").drop("_h", "_d")
        voted = F.when(F.col("n_grams") > 0, 1).otherwise(0)
        rows = rows.withColumn("_own", F.when(F.col("n_grams") > 0, vote).otherwise(F.array(*[F.lit(0.0)] * k)))
        others = lambda level, i: F.greatest(F.coalesce(F.col(f"_p_{level}")[i] - F.col("_own")[i], F.lit(0.0)), F.lit(0.0))
        count = lambda level: F.greatest(F.coalesce(F.col(f"_n_{level}") - voted, F.lit(0)), F.lit(0))
        above = lambda i: (others("domain", i) + SHRINK * total[i]) / (count("domain") + SHRINK)
        prior = lambda i: F.log((others("host", i) + SHRINK * above(i)) / (count("host") + SHRINK))
    else:
        prior = lambda i: F.lit(float(np.log(total[i])))
    rows = rows.join(given("_declared", "declared_given"), "_declared", "left") if declared else rows.withColumn("declared_given", F.lit(None).cast("array<double>"))
    rows = rows.join(given("_suffix", "suffix_given"), "_suffix", "left") if suffix else rows.withColumn("suffix_given", F.lit(None).cast("array<double>"))
    score = F.array(*(F.col("ll")[i].cast("double") * weight + prior(i) + F.coalesce(F.col("declared_given")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_given")[i], F.lit(0.0)) for i in range(k)))
    rows = rows.withColumn("_soft", _soft(score)).withColumn("confidence", F.array_max("_soft"))
    at = F.array_position("_soft", F.col("confidence")).cast("int")
    known = (F.col("n_grams") > 0) & (F.element_at("ll", at) / F.col("n_grams") >= -float(np.log(BUCKETS))) & (F.col("confidence") >= least)
    kept = F.coalesce(known, F.lit(False))
    language = F.when(kept, F.element_at(F.array(*map(F.lit, names)), at)).otherwise(F.lit("und"))
    return rows.select(*callers, F.col("n_grams").alias(n_grams), language.alias(language_name), F.col("confidence").alias(confidence), kept.alias(kept_name))


def declared_language(html: Column) -> Column:
    """The primary subtag of the markup's lang attribute, null if absent."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
