"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "I1_normalized_hash", "J3_hashed_embedding", "C5_ticket_gate", "C8_decision", "D4_last_within_horizon", "D14_nearest_place", "E8_class_metrics", "F6_bio_runs", "F7_merged_spans", "G4_bm25_top_k", "K1_burst_windows", "K20_cache_lookup", "L11_cluster_bootstrap", "L13_simulated_systems", "M2_stratified_split", "M3_family_audit", "A6_webhook",
    "A1_trajectory_shape", "A13_broker_envelopes", "A14_poll_and_commit", "A15_relational_store", "A17_export", "A18_lineage_stats", "A21_conditional_migration", "C7_identity_gate", "C16_payload_checks", "D8_similarity_join", "D11_word_span_labels", "D13_positional_zip",
    "D15_membership", "E10_system_metrics", "E13_percentiles", "E16_token_metrics", "E17_head_averages", "F1_score_ranks", "F8_continuation_repair", "F10_quota_allocation", "G5_priority_order", "G9_round_questions", "I14_question_lookup", "J5_masked_mean", "K2_late_messages",
    "K3_generations", "K4_case_association", "K7_inbox_dedupe", "K8_poison_branch", "K9_outbox_relay", "K9_outbox_after_relay", "K12_category_anchor", "K13_state_machine", "K14_send_ledger", "K15_ticket_store", "K16_circuit_breaker", "K17_dead_letters", "K18_session_rounds",
    "K19_append_only", "K21_bank_upsert", "K22_gateway_audit", "K23_result_scatter", "L4_model_backend", "L9_resolved_spans", "L10_span_union", "M5_contamination", "M7_greedy_dedup", "M9_templated_scenarios", "M10_manifest_validation", "M14_strict_records", "M16_object_candidates",
    "M17_span_labelling", "M19_subtoken_labels", "M20_first_occurrence", "M21_synonyms", "M22_modular_records", "M23_threshold_precedence",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(table):
    columns = sorted(table.column_names)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_tables
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, SF).toArrow()) == rows_of(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120).returncode == 0
