"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it as the next stage's
input.  All but the last stage return the columns of their input; the last
returns token digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

Rows that a stage rejects are named by doc_id and the SHA-256 of the text, so rows that
share a doc_id are judged on their own; the near-duplicate stage judges by doc_id, and
keeps one of rows that repeat both.

Every stage takes nulls in any column, empty and very long texts, repeated rows and
extra columns whatever their names.  Null and empty texts have no language and go in the
first stage; a null doc_id is an id like any other, but never the least of a group.  Of
equally good documents of a group the one with the least doc_id stays.  An empty table
gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, decontaminate, fm, langid, simhash
from caseloom.llm.store import free_name, table, written


#: Rows of ids and marks (40 bytes each) that go to every task; more meet the documents by key.
FEW = 300_000


def _mark():
    """What names a text: its SHA-256; null for null."""
    return F.unhex(F.sha2("text", 256))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (written), with a broadcast hint if there are at most ``FEW``."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _without(docs: DataFrame, rejected: DataFrame, mark: str) -> DataFrame:
    """``docs`` without the rows named in ``rejected`` (doc_id, mark)."""
    ident, text_mark = free_name(docs, "ident"), free_name(docs, "text_mark")
    gone = written(rejected.select(F.col("doc_id").alias(ident), F.col(mark).alias(text_mark)).distinct(), "rejected")
    return docs.join(_few(gone), F.col("doc_id").eqNullSafe(F.col(ident)) & _mark().eqNullSafe(F.col(text_mark)), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language (operator 7; host: the source)."""
    rows = docs.select("doc_id", _mark().alias("mark"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))
    judged = langid.identify(rows, langid.fit(docs), host="host", domain="domain")
    return _without(docs, judged.where(~F.col("kept")), "mark")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below 0.3 (operator 8)."""
    labels = table(spark, sf_dir, "labels")
    return fm.keep(docs, fm.fit(docs, labels.where(~fm.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near-duplicates (operator 10).

    Rows of one doc_id are one document, which stays if one of its rows names a group: the
    ids that name none go, and of rows that repeat an id and a text one stays.
    """
    ident, rows, mark = (free_name(docs, n) for n in ("ident", "rows", "mark"))
    judged = simhash.near_duplicates(docs)
    names = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = judged.groupBy(F.col("doc_id").alias(ident)).agg(F.count(F.lit(1)).alias(rows), names.alias("stays")).where(f"NOT stays OR {rows} > 1")
    ids = written(ids, "odd-ids")
    gone, repeated = _few(ids.select(ident)), _few(ids.where("stays").select(ident))
    same = F.col("doc_id").eqNullSafe(F.col(ident))
    several = docs.join(repeated, same, "left_semi").withColumn(mark, _mark()).dropDuplicates(["doc_id", mark]).drop(mark)
    return docs.join(gone, same, "left_anti").unionByName(several)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a benchmark item leaks into (operator 5)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, decode the ids, and return digests of both (operator 2)."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: Fingerprints, learned weights and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
