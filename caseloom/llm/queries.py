"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, ...) for each license notice in a document."""
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"), bins=16)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .records import token_records

    out = token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, ...) for each benchmark item that leaks into a document."""
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import quality

    return quality(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document (host: its source) and each page (host, suffix and markup of its own)."""
    from .langid import declared_language, fit, host_of, identify

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    null = F.lit(None)
    host = host_of(F.col("url"))
    pages = pages.select(null.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), declared_language(F.coalesce("html", F.lit(""))).alias("declared"), host.alias("host"))
    pages = pages.select("*", F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))
    rows = docs.select("doc_id", null.cast("long").alias("page_id"), "text", null.cast("string").alias("declared"), F.concat(F.lit("source:"), "source").alias("host"), null.cast("string").alias("suffix"), null.cast("string").alias("domain"))
    out = identify([(rows, False), (pages, True)], fit(docs), declared="declared", suffix="suffix", host="host", domain="domain")
    return out.select("doc_id", "page_id", "declared", "host", "language", F.round("confidence", 6).alias("confidence"), "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm import fit, held_out, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs, labels.where(~held_out()))
    scored = score(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    out = archived(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_sharding": op3_sharding,
    "op4_token_records": op4_token_records,
    "op5_decontamination": op5_decontamination,
    "op6_outliers": op6_outliers,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
}

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1, 1)), '')"

#: Fingerprints, merges, learned weights, alignments and packings are beyond SQL; tests compare those queries with brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), b AS (SELECT h, n, max(page_id) AS best FROM p GROUP BY 1, 2)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM p JOIN b USING (h, n)""",
}
