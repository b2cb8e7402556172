"""Queries over dataset engineering (families D12, D15, H2, L7, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text
from caseloom.operators import datasets as ds
from caseloom.operators.keyed import batched
from caseloom.operators.spans import placed

from .registry import query, table

WORD = r"([\p{L}\p{M}\p{N}_]+)"
SPLIT_SQL = "CASE WHEN ('0x' || substr(sha256('42:' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.7 THEN 'train' WHEN ('0x' || substr(sha256('42:' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.85 THEN 'dev' ELSE 'test' END"


@query("M1_hash_split", f"SELECT doc_id, {SPLIT_SQL.format('source')} AS split FROM documents")
def m1(spark, d):
    return table(spark, d, "documents").select("doc_id", ds.hash_split(F.col("source")).alias("split"))


def _quotas(counts: str) -> str:
    """CTEs up to ``q(category, train, dev)`` for ``counts`` (category, k): quotas grow by the largest deficit, from two below each share."""
    lack = [f"round(k * {x}::DOUBLE - {q}, 9)" for x, q in ((0.7, "a"), (0.15, "b"), (1 - 0.7 - 0.15, "c"))]
    return f"""k_ AS ({counts}), g_(category, k, a, b, c) AS (SELECT category, k, greatest(1, floor(k * 0.7::DOUBLE) - 2)::BIGINT, greatest(1, floor(k * 0.15::DOUBLE) - 2)::BIGINT, greatest(1, floor(k * {1 - 0.7 - 0.15}::DOUBLE) - 2)::BIGINT FROM k_ WHERE k > 2 UNION ALL
SELECT category, k, a + (CASE WHEN {lack[0]} >= {lack[1]} AND {lack[0]} >= {lack[2]} THEN 1 ELSE 0 END), b + (CASE WHEN NOT ({lack[0]} >= {lack[1]} AND {lack[0]} >= {lack[2]}) AND {lack[1]} >= {lack[2]} THEN 1 ELSE 0 END), c + (CASE WHEN NOT ({lack[0]} >= {lack[1]} AND {lack[0]} >= {lack[2]}) AND NOT ({lack[1]} >= {lack[2]}) THEN 1 ELSE 0 END) FROM g_ WHERE a + b + c < k),
q AS (SELECT category, a AS train, b AS dev FROM g_ WHERE a + b + c = k UNION ALL SELECT category, 1, 0 FROM k_ WHERE k <= 2)"""


@query("M2_stratified_split", f"""
WITH RECURSIVE f AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || source), source) AS rn FROM f), {_quotas('SELECT lang AS category, count(*) AS k FROM f GROUP BY 1')}
SELECT lang, source, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + dev THEN 'dev' ELSE 'test' END AS split FROM r JOIN q ON category = lang""")
def m2(spark, d):
    return ds.stratified_split(table(spark, d, "documents").select("lang", "source").distinct(), "lang", "source").select("lang", "source", "split")


@query("F10_quota_allocation", f"WITH RECURSIVE {_quotas('SELECT source AS category, count(*) AS k FROM documents GROUP BY 1')} SELECT category, train::BIGINT AS train, dev::BIGINT AS dev FROM q")
def f10(spark, d):
    """Quotas of every category, whatever its size."""
    q = ds.split_quotas(table(spark, d, "documents").select(F.col("source").alias("category")), "category")
    return q.select("category", F.col("_q")[0].alias("train"), F.col("_q")[1].alias("dev"))


COMMON = ["the", "and", "that", "in", "of", "to", "for", "la", "de", "que", "und", "der", "die", "el", "et"]
SCENARIOS = f"""s0 AS (SELECT conv_id, turn, 'sc-' || conv_id AS scenario, 'fam-' || lpad((conv_id % 7)::VARCHAR, 3, '0') AS family, {SPLIT_SQL.format("conv_id::VARCHAR")} AS split,
text || CASE WHEN turn <> 1 THEN '' WHEN conv_id % 9 = 0 THEN ' lihat fam-' || lpad((conv_id % 5)::VARCHAR, 3, '0') WHEN conv_id % 9 = 1 THEN ' Category: road' WHEN conv_id % 9 = 2 THEN ' flood_depth_cm=12' WHEN conv_id % 9 = 3 THEN ' sc-' || conv_id || ',' WHEN conv_id % 9 = 4 THEN ' kelurahan sukajadi' WHEN conv_id % 9 = 5 THEN ' dekat SUKAJADI!' WHEN conv_id % 9 = 6 THEN ' a sentence that stands in many of the texts of both' ELSE '' END AS text,
turn % 2 = 0 AS executes, conv_id % 4 = 0 AS lacks FROM conversations)"""
GRAMS6 = "CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) ELSE [] END"


@query("M3_family_audit", f"""
WITH {SCENARIOS}, w AS (SELECT *, regexp_extract_all(lower(text), '([a-z0-9_\\-]+)', 1) AS w FROM s0),
g AS (SELECT split, unnest({GRAMS6.format(n=6)}) AS g FROM w UNION ALL SELECT split, unnest({GRAMS6.format(n=7)}) FROM w), f AS (SELECT DISTINCT family FROM s0)
SELECT 'family' AS violation, count(*) AS n FROM (SELECT family FROM s0 GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'action', count(*) FILTER ((executes AND lacks) OR (NOT executes AND NOT lacks)) FROM s0
UNION ALL SELECT 'duplicate_text', count(*) FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM s0 GROUP BY 1 HAVING length(h) > 20 AND count(DISTINCT split) > 1)
UNION ALL SELECT 'identifier', count(DISTINCT (scenario, text)) FROM w WHERE list_contains(w, scenario) OR list_contains(w, family) OR regexp_matches(text, '(?i)(category|kategori)\\s*[:=]\\s*[a-zA-Z_]+') OR list_contains(w, 'flood_depth_cm') OR list_has_any(w, (SELECT list(family) FROM f))
UNION ALL SELECT 'ngram', count(*) FROM (SELECT g FROM g WHERE len(list_filter(string_split(g, ' '), lambda x: NOT list_contains({COMMON}, x))) > 0 GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'hidden_fact', count(*) FROM w WHERE contains(lower(text), 'kelurahan sukajadi') OR list_contains(w, 'sukajadi') OR list_contains(w, 'kelurahan')""")
def m3(spark, d):
    """Conversations as scenarios, with leaks of each kind written into the second turns."""
    k = F.col("conv_id") % 9
    family = lambda n: F.concat(F.lit("fam-"), F.lpad((F.col("conv_id") % n).cast("string"), 3, "0"))
    tail = F.when(F.col("turn") != 1, "").when(k == 0, F.concat(F.lit(" lihat "), family(5))).when(k == 1, " Category: road").when(k == 2, " flood_depth_cm=12").when(k == 3, F.concat(F.lit(" sc-"), "conv_id", F.lit(","))).when(k == 4, " kelurahan sukajadi").when(k == 5, " dekat SUKAJADI!").when(k == 6, " a sentence that stands in many of the texts of both").otherwise("")
    rows = table(spark, d, "conversations").select("turn", "conv_id", F.concat(F.lit("sc-"), "conv_id").alias("scenario"), family(7).alias("family"), ds.hash_split(F.col("conv_id").cast("string")).alias("split"), F.concat("text", tail).alias("text"))
    none = F.array().cast("array<string>")
    actions = F.array(F.when(F.col("turn") % 2 == 0, "EXECUTE").otherwise("REQUEST_CLARIFICATION"))
    missing = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("location"))).otherwise(none)
    truth = F.create_map(F.lit("flood_depth_cm"), F.lit("12"))
    return ds.audit_families(rows, "scenario", "family", "split", "text", actions, missing, F.array(F.lit("Kelurahan Sukajadi")), truth, common=COMMON, labels=ds.CATEGORY_LABELS[:1])


AUDIT_SQL = f"""WITH h AS (SELECT item_id AS id, text FROM benchmark), t AS (SELECT doc_id AS id, text FROM documents)
SELECT 'id' AS audit, count(*) AS n FROM h WHERE id IN (SELECT id FROM t) UNION ALL SELECT 'text', count(*) FROM h WHERE sha256(text) IN (SELECT sha256(text) FROM t)
UNION ALL SELECT 'normalised', count(*) FROM h WHERE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM t)"""


@query("D12_held_out_semi_join", AUDIT_SQL)
def d12(spark, d):
    h, t = table(spark, d, "benchmark"), table(spark, d, "documents")
    return ds.held_out_audit(h, t, {"id": (F.col("item_id"), F.col("doc_id")), "text": (F.sha2("text", 256), F.sha2("text", 256)), "normalised": (text.text_hash(F.col("text")), text.text_hash(F.col("text")))})


def _contamination_sql(n: int) -> str:
    grams = f"CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) ELSE [] END"
    return f"""WITH a AS (SELECT doc_id, unnest({grams}) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}', 1) AS w FROM documents)),
b AS (SELECT item_id, unnest({grams}) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD}', 1) AS w FROM benchmark))
SELECT doc_id, item_id, count(*) AS n_shared FROM a JOIN b USING (g) GROUP BY 1, 2"""


@query("M4_held_out_ngrams", _contamination_sql(5))
def m4(spark, d):
    return ds.shared_ngrams(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 5)


@query("M5_contamination", _contamination_sql(4))
def m5(spark, d):
    return ds.shared_ngrams(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 4)


@query("H2_ngram_intersection", f"SELECT count(DISTINCT item_id) AS items, count(DISTINCT doc_id) AS docs FROM ({_contamination_sql(3)})")
def h2(spark, d):
    s = ds.shared_ngrams(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 3)
    return s.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("docs"))


@query("M6_pii_assertion", r"SELECT count(*) FILTER (regexp_matches(text, '\d{16}') OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') OR regexp_matches(text, '(?:\+62|62|0)8\d{8,11}')) AS hits, count(*) AS total FROM documents")
def m6(spark, d):
    return table(spark, d, "documents").agg(F.count_if(text.has_pii(F.col("text"))).alias("hits"), F.count(F.lit(1)).alias("total"))


NEAR_SQL = rf"""
WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}', 1) AS w FROM documents) WHERE len(w) >= 3),
k AS (SELECT min(doc_id) AS id, any_value(g) AS g FROM s GROUP BY md5(array_to_string(list_sort(g), '|'))),
i AS (SELECT id, len(g) AS n, unnest(g) AS x FROM k), p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS c, a.n + b.n AS t FROM i a JOIN i b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2, 4)"""


@query("D15_near_duplicates", NEAR_SQL + " SELECT left_id, right_id, round(c / (t - c), 6)::DOUBLE AS jaccard FROM p WHERE c / (t - c) >= 0.85")
def d15(spark, d):
    """Pairs of classes of equal sets; ``D15_membership`` has the texts of each."""
    p = ds.near_duplicates(table(spark, d, "documents"), "doc_id", "text")
    return p.select("left_id", "right_id", F.round("jaccard", 6).alias("jaccard"))


@query("D15_membership", NEAR_SQL + """, l AS (SELECT left_id AS id FROM p WHERE c / (t - c) >= 0.85 UNION ALL SELECT right_id FROM p WHERE c / (t - c) >= 0.85), n AS (SELECT id, count(*) AS n FROM l GROUP BY 1), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(g), '|'))) AS class_id FROM s)
SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(n, 0) AS links FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id LEFT JOIN n ON n.id = class_id""")
def d15b(spark, d):
    """Every document with its class and the number of other classes that this links to."""
    docs = table(spark, d, "documents")
    p = ds.near_duplicates(docs, "doc_id", "text")
    n = p.select(F.explode(F.array("left_id", "right_id")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return ds.ngram_sets(docs, "doc_id", "text").join(n, "rep", "left").select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@query("M7_greedy_dedup", NEAR_SQL.replace("WITH s AS", "WITH RECURSIVE s AS") + """, e AS (SELECT left_id AS a, right_id AS b FROM p WHERE c / (t - c) >= 0.85), bs AS (SELECT b, list(a) AS less, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY 1),
r(i, lost) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT bs.i, CASE WHEN len(list_filter(less, lambda x: NOT list_contains(lost, x))) > 0 THEN list_append(lost, bs.b) ELSE lost END FROM r JOIN bs ON bs.i = r.i + 1),
z AS (SELECT lost FROM r ORDER BY i DESC LIMIT 1), m AS (SELECT min(id) AS doc_id FROM k GROUP BY id UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id FROM m WHERE NOT list_contains((SELECT lost FROM z), doc_id)""")
def m7(spark, d):
    """Ids that the ordered greedy pass keeps: first copies, without near-duplicates of kept ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = ds.ngram_sets(docs, "doc_id", "text").groupBy("rep").agg(F.min("id").alias("doc_id")).select("doc_id")
    return ds.greedy_kept(ds.near_duplicates(docs, "doc_id", "text"), ids, "doc_id")


@query("M8_sample_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def m8(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    return ds.first_seen(t, ["h", "lang"], "doc_id").select("doc_id")


@query("F9_first_seen", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def f9(spark, d):
    return ds.first_seen(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


SLANG_SQL = "CASE regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SLANG.items()) + " END"
BARE = "regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')"


def _noisy(value: str, shift: int) -> str:
    """SQL of the noise over a text: short words, then swapped letters, but for the words in ``places``."""
    short = f"array_to_string(list_transform(string_split({value}, ' '), lambda w: CASE WHEN list_contains(places, {BARE}) THEN w ELSE coalesce({SLANG_SQL} || regexp_extract(w, '([.,!?])$', 1), w) END), ' ')"
    half = f"(length({BARE}) // 2)"
    swapped = f"substr(w, 1, {half}::BIGINT) || substr(w, ({half} + 2)::BIGINT, 1) || substr(w, ({half} + 1)::BIGINT, 1) || substr(w, ({half} + 3)::BIGINT)"
    typo = f"array_to_string(list_transform(string_split({short}, ' '), lambda w, j: CASE WHEN NOT list_contains(places, {BARE}) AND length({BARE}) >= 5 AND (j - 1) % 7 = (id + 42 + {shift}) % 7 AND regexp_matches(substr(w, ({half} + 1)::BIGINT, 2), '^\\p{{L}}\\p{{L}}$') THEN {swapped} ELSE w END), ' ')"
    return f"CASE noise WHEN 'LOW' THEN {value} WHEN 'MEDIUM' THEN {short} ELSE {typo} END"


SAID = {i: "CASE persona " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in ds.PERSONAS.items()) + " END" for i in range(6)}
TEMPLATES_SQL = "t AS (SELECT 'fam-' || lpad(n_nationkey::VARCHAR, 3, '0') AS family_id, r_name AS category, 'Tugu ' || n_name AS landmark, 'jalan rusak berlubang sudah lama dekat pasar ' || lower(n_name) AS issue, 'Kelurahan ' || n_name AS jurisdiction, 'Kota ' || r_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _templates(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select(F.concat(F.lit("fam-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("family_id"), F.col("r_name").alias("category"), F.concat(F.lit("Tugu "), "n_name").alias("landmark"), F.concat(F.lit("jalan rusak berlubang sudah lama dekat pasar "), F.lower("n_name")).alias("issue"), F.concat(F.lit("Kelurahan "), "n_name").alias("jurisdiction"), F.concat(F.lit("Kota "), "r_name").alias("city"))


@query("M9_templated_scenarios", f"""
WITH RECURSIVE {TEMPLATES_SQL}, r AS (SELECT category, family_id, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || category || ':' || family_id), family_id) AS rn FROM t), {_quotas('SELECT category, count(*) AS k FROM t GROUP BY 1')},
n AS (SELECT t.*, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + dev THEN 'dev' ELSE 'test' END AS split, row_number() OVER (ORDER BY sha256(t.family_id), t.family_id) - 1 AS at FROM t JOIN r USING (category, family_id) JOIN q USING (category)),
s AS (SELECT id, (['STANDARD', 'FORMAL', 'FRUSTRATED_RAMBLING', 'PANICKED'])[(id + 42) % 4 + 1] AS persona, (['LOW', 'MEDIUM', 'HIGH'])[(id + 42) % 3 + 1] AS noise, (id + 42) % 100 < 50 AS multi, n.*, 'sc-' || family_id || '-' || lpad((id + 1)::VARCHAR, 4, '0') AS scenario_id,
list_transform(string_split(landmark || ' ' || jurisdiction || ' ' || city, ' '), lambda w: lower(w)) AS places FROM (SELECT unnest(range(500)) AS id), (SELECT count(*) AS m FROM t), n WHERE n.at = (id + 42) % m),
x AS (SELECT *, CASE WHEN multi THEN {SAID[0]} ELSE {SAID[3]} END || issue AS one, CASE WHEN multi THEN {SAID[1]} ELSE {SAID[4]} END || landmark || CASE WHEN multi THEN '' ELSE ', wilayah ' || jurisdiction || ', ' || city END || CASE WHEN multi THEN {SAID[2]} ELSE {SAID[5]} END AS two FROM s)
SELECT scenario_id, family_id, split, persona, noise, 1 AS turn, scenario_id || '-t1-b1' AS message_id, {_noisy('one', 0)} AS text, 0 AS offset_seconds, CASE WHEN multi THEN 'REQUEST_CLARIFICATION' ELSE 'EXECUTE' END AS action, CASE WHEN multi THEN 'jurisdiction' ELSE '' END AS missing FROM x
UNION ALL SELECT scenario_id, family_id, split, persona, noise, 1, scenario_id || '-t1-b2', {_noisy('two', 1)}, CASE WHEN multi THEN 2 ELSE 3 END, CASE WHEN multi THEN 'REQUEST_CLARIFICATION' ELSE 'EXECUTE' END, CASE WHEN multi THEN 'jurisdiction' ELSE '' END FROM x
UNION ALL SELECT scenario_id, family_id, split, persona, noise, 2, scenario_id || '-t2-b1', 'Untuk wilayah administrasinya berada di ' || jurisdiction || ', ' || city, 0, 'EXECUTE', '' FROM x WHERE multi""")
def m9(spark, d):
    """500 scenarios of 25 templates: personas, noise and one or two turns."""
    return ds.trajectories(_templates(spark, d), 500).drop("category")


@query("M10_manifest_validation", "SELECT split AS name, ok AS file_exists, CASE WHEN ok THEN split <> 'dev' END AS sha256_matches, CASE WHEN ok THEN n END AS actual_count, CASE WHEN ok THEN split <> 'test' END AS count_matches, CASE WHEN ok THEN true END AS split_hash_matches, CASE WHEN ok THEN leaked = 0 END AS zero_leakage, coalesce(ok AND split = 'train' AND leaked = 0, false) AS is_valid FROM (SELECT split, true AS ok, count(*) AS n, count(*) FILTER (item_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 3)) AS leaked FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM benchmark) GROUP BY 1 UNION ALL SELECT 'gone', false, NULL, NULL)")
def m10(spark, d):
    """Three held-out files as a manifest lists them: one of another digest, one of another count, and one file that is not there."""
    from caseloom.operators.shared import new_folder
    from caseloom.sources import files

    split = F.when(F.col("item_id") % 3 == 0, "train").when(F.col("item_id") % 3 == 1, "dev").otherwise("test")
    rows = table(spark, d, "benchmark").select("item_id", F.col("text"), split.alias("split"))
    folder = new_folder(spark, "held-out")
    made = files.exported(rows, folder, "split")
    hashes = ds.split_hash(rows, "split", "item_id").select("split", "split_hash")
    listed = made.join(hashes, "split").select(F.col("split").alias("name"), "path", F.when(F.col("split") == "dev", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"), (F.col("records") + F.when(F.col("split") == "test", 1).otherwise(0)).alias("expected_count"), "split_hash")
    gone = spark.createDataFrame([("gone", "no/such/file", "0" * 64, 1, None)], listed.schema)
    train = table(spark, d, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("id"))
    out = files.validated(spark, folder, listed.unionByName(gone), ["id", "item_id"], train)
    return out.select("name", "file_exists", "sha256_matches", "actual_count", "count_matches", "split_hash_matches", "zero_leakage", "is_valid")


@query("M11_priority_batches", "SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderpriority, o_orderkey) - 1) // 5 AS batch FROM orders")
def m11(spark, d):
    level = F.substring("o_orderpriority", 1, 1).try_cast("int")
    o = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")
    return batched(o, ["o_orderstatus", "o_custkey"], [level, F.col("o_orderpriority"), F.col("o_orderkey")], "batch", 5).select("o_orderstatus", "o_orderkey", "batch")


@query("M12_lexicon_check", "SELECT p_partkey, NOT contains(upper(p_name), 'SMALL') AND NOT contains(p_name, 'ring') AND (contains(p_name, 'widget') OR contains(p_name, 'bolt')) AS valid FROM part")
def m12(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", (~F.upper(name).contains("SMALL") & ~text.any_word(name, ["ring"]) & text.any_word(name, ["widget", "bolt"])).alias("valid"))


@query("M13_corpus_synthesis")
def m13(spark, d):
    """Part types by templates, without near-duplicates, topped up to 500 lines; tests compare with the plain pass."""
    kinds = table(spark, d, "part").select("p_type").distinct()
    made = ds.synthesized(kinds, {str(i): s for i, s in enumerate(CORPUS)}, "p_type", 500, F.format_string("Laporan pemeliharaan nomor %04d: petugas menjadwalkan tindakan menggunakan kelengkapan %d.", F.col("i") + 1, F.col("i") % 7))
    return made.select("text")


CORPUS = ["warga melaporkan {x} di dekat pasar sejak kemarin", "warga melaporkan {x} di dekat pasar sejak kemarin sore", "mohon info {x}", "petugas mencatat kendala {x} pada pemeriksaan rutin di wilayah kota bagian utara"]
HEADS = {"intent": (["COMPLAINT", "INQUIRY"], "COMPLAINT"), "risk": (["LOW", "HIGH"], "MEDIUM")}


@query("M14_strict_records", """
WITH t AS (SELECT event_id, user_id, event_type, (json_extract(props, '$.k'))::INT AS k FROM events), c AS (SELECT *, k % 12 AS c FROM t), h AS (SELECT user_id, event_id FROM c WHERE c = 0),
r AS (SELECT c.*, (SELECT max(h.event_id) FROM h WHERE h.user_id = c.user_id AND h.event_id < c.event_id) IS NOT NULL AS headed FROM c WHERE c NOT IN (0, 11))
SELECT user_id, event_id, CASE c WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'human_claim' WHEN 3 THEN 'internal_provenance' WHEN 4 THEN 'human_claim' WHEN 5 THEN 'invalid_provenance' WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN 'unrecognized' ELSE CASE WHEN headed THEN NULL ELSE 'missing_provenance' END END AS reject,
CASE c WHEN 1 THEN NULL WHEN 7 THEN event_type || chr(10) || 'b' WHEN 8 THEN NULL ELSE event_type END AS text, CASE c WHEN 1 THEN NULL WHEN 6 THEN 'INQUIRY' ELSE 'COMPLAINT' END AS intent, CASE c WHEN 1 THEN NULL WHEN 6 THEN 'MEDIUM' WHEN 9 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM r""")
def m14(spark, d):
    """A file of lines for each user: headers, records of every kind that is refused, and sound ones."""
    c = F.get_json_object("props", "$.k").cast("int") % 12
    t = F.to_json(F.struct(F.col("event_type").alias("text")))
    put = lambda *fields: F.concat(F.lit("{" + "".join(f'"{k}": {v}, ' for k, v in fields)), F.expr("substring(_t, 2)"))
    turns = F.concat(F.lit('{"world_truth": {"provenance": "synthetic_independent"}, "turns": [{"bubbles": [{"text": " '), "event_type", F.lit(' "}, {"text": " "}]}, {"bubbles": [{"text": "b"}]}]}'))
    line = (
        F.when(c == 0, '{"_type": "metadata", "provenance": "synthetic_independent"}').when(c == 1, "not json").when(c == 2, put(("provenance", '"synthetic_independent"'), ("is_human_written", "true")))
        .when(c == 3, put(("metadata", '{"provenance": "hifi_synthetic"}'))).when(c == 4, put(("provenance", '"real_user"'))).when(c == 5, put(("provenance", '"elsewhere"')))
        .when(c == 6, put(("provenance", '"synthetic_independent"'), ("world_truth", '{"intent": "INQUIRY"}'), ("risk", '"SEVERE"'))).when(c == 7, turns)
        .when(c == 8, F.lit('{"provenance": "synthetic_independent"}')).when(c == 9, put(("risk", '"HIGH"'))).when(c == 11, "  ").otherwise(F.col("_t"))
    )
    rows = table(spark, d, "events").withColumn("_t", t).select("user_id", "event_id", line.alias("line"))
    return ds.strict_records(rows, "user_id", "event_id", "line", HEADS).select("user_id", "event_id", "reject", "text", "intent", "risk")


@query("M15_longest_alias", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])with the([^\p{L}\p{N}_]|$)') THEN 'with the' WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])from([^\p{L}\p{N}_]|$)') THEN 'from' WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])que([^\p{L}\p{N}_]|$)') THEN 'que' END AS alias FROM documents""")
def m15(spark, d):
    return table(spark, d, "documents").select("doc_id", ds.longest_alias(F.col("text"), ["que", "from", "with the"]).alias("alias"))


@query("M16_object_candidates", r"""
WITH c AS (SELECT conv_id, turn, lower(text) AS t, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])thtion the([^\p{L}\p{N}_]|$)') AND turn % 2 = 0 THEN 'thtion the' WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])and([^\p{L}\p{N}_]|$)') AND turn % 2 = 0 THEN 'and' END AS rule,
 list_filter(list_transform(string_split_regex(text, ' (?:the|and|la|de) |[,;.:]'), lambda x: regexp_replace(x, '^[ \t\r\n.,!?:;"''()\[\]{}]+|[ \t\r\n.,!?:;"''()\[\]{}]+$', '', 'g')), lambda x: length(x) >= 3 AND len(string_split_regex(x, '\s+')) <= 4 AND NOT list_has_any(string_split_regex(lower(x), '\s+'), ['in', 'que', 'nicht'])) AS parts FROM conversations),
a AS (SELECT conv_id, turn, t, list_filter(list_concat([rule], parts), lambda x: x IS NOT NULL AND x <> '') AS f FROM c),
b AS (SELECT conv_id, turn, t, list_filter(f, lambda x, i: NOT list_contains(list_transform(f[1:i - 1], lambda y: lower(y)), lower(x))) AS f FROM a)
SELECT conv_id, turn, array_to_string(f, '|') AS candidates FROM b""")
def m16(spark, d):
    """The longest alias of a rule in every second turn, then the short clauses of the text."""
    fact = F.when(F.col("turn") % 2 == 0, "DOC")
    found = ds.object_candidates(F.col("text"), F.col("text"), fact, {"DOC": ["and", "thtion the"], "OTHER": ["zz"]}, ["in", "que"], " (?:the|and|la|de) |[,;.:]", negations=["nicht"])
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("candidates"))


@query("M18_span_normalisation", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity < l_partkey AND l_returnflag <> 'N' GROUP BY 1")
def m18(spark, d):
    s = F.struct(F.col("l_quantity").cast("long").alias("start"), F.col("l_partkey").alias("end"), F.when(F.col("l_returnflag") == "N", "B-").otherwise(F.concat(F.lit("I-"), "l_returnflag")).alias("label"))
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(s).alias("s")).select("l_orderkey", F.size(ds.valid_spans(F.col("s"))).cast("long").alias("n"))
    return t.where("n > 0")


VALUES = [("tion", "OBJ"), ("the", "LOC"), ("ation", "TIME"), ("the ", "OBJ"), ("tion", "LOC"), ("", "OBJ")]


def _placed_sql(source: str, values: str) -> str:
    """Recursive CTEs up to ``b(doc_id, used)``: values (v, label, in order of trial j from 1) placed in the texts of ``source`` (doc_id, text)."""
    starts = "list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT + (i - 1) * length(v))"
    free = f"list_filter({starts}, lambda a: len(list_filter(used, lambda u: a < u.e AND a + length(v) > u.s)) = 0)"
    return f"""v_ AS ({values}), d_ AS ({source}), b(doc_id, j, used) AS (SELECT doc_id, 0, []::STRUCT(s BIGINT, e BIGINT, l VARCHAR)[] FROM d_ UNION ALL
SELECT doc_id, j, CASE WHEN len({free}) > 0 THEN list_append(used, {{'s': ({free})[1], 'e': ({free})[1] + length(v), 'l': label}}) ELSE used END FROM (SELECT b.doc_id, v_.j, b.used, v_.v, v_.label, string_split(d_.text, v_.v) AS parts FROM b JOIN v_ ON v_.j = b.j + 1 JOIN d_ ON d_.doc_id = b.doc_id))"""


SHOWN = "array_to_string(list_transform(list_sort(used), lambda u: u.s || '-' || u.e || u.l), ' ')"


@query("M20_first_occurrence", f"""WITH RECURSIVE {_placed_sql('SELECT doc_id, text FROM documents', "SELECT * FROM (VALUES (1, 'ation', 'TIME'), (2, 'tion', 'OBJ'), (3, 'the ', 'OBJ'), (4, 'tion', 'LOC'), (5, 'the', 'LOC')) t(j, v, label)")} SELECT doc_id, {SHOWN} AS spans FROM b WHERE j = 5""")
def m20(spark, d):
    """Values placed longest-first, each at its first place that no earlier one uses."""
    values = F.array(*(F.struct(F.lit(v).alias("text"), F.lit(x).alias("label")) for v, x in VALUES))
    shown = F.transform(placed(F.col("text"), values), lambda u: F.concat(u["start"].cast("string"), F.lit("-"), u["end"].cast("string"), u["label"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(shown, " ").alias("spans"))


BREAKS = ["the", "and", "la"]
SYNONYMS = {"the": "this", "and": "plus", "la": "una"}


@query("M21_synonyms", rf"""
WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(regexp_replace(replace(regexp_replace(text, '(\w+)/(\w+)', '\1 atau \2', 'g'), '-', ' '), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations),
b(conv_id, turn, i, done, cur) AS (SELECT conv_id, turn, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM w UNION ALL
SELECT conv_id, turn, i, CASE WHEN brk AND len(cur) > 0 THEN list_append(done, array_to_string(cur, ' ')) WHEN NOT brk AND len(cur) >= 2 THEN list_append(done, array_to_string(list_append(cur, x), ' ')) ELSE done END, CASE WHEN brk AND len(cur) > 0 THEN [x] WHEN NOT brk AND len(cur) >= 2 THEN [] ELSE list_append(cur, x) END
FROM (SELECT b.conv_id, b.turn, b.i + 1 AS i, b.done, b.cur, w.w[b.i + 1] AS x, list_contains({BREAKS}, lower(w.w[b.i + 1])) AS brk FROM b JOIN w ON w.conv_id = b.conv_id AND w.turn = b.turn WHERE b.i < len(w.w))),
e AS (SELECT b.conv_id, b.turn, CASE WHEN len(cur) = 0 THEN done WHEN len(done) > 0 AND len(cur) = 1 AND NOT list_contains({BREAKS}, lower(cur[1])) THEN list_append(done[1:len(done) - 1], done[-1] || ' ' || cur[1]) ELSE list_append(done, array_to_string(cur, ' ')) END AS c FROM b JOIN w ON w.conv_id = b.conv_id AND w.turn = b.turn WHERE b.i = len(w.w)),
s AS (SELECT conv_id, turn, list_transform(c, lambda x: array_to_string(list_transform(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda y: CASE lower(y) WHEN 'the' THEN 'this' WHEN 'and' THEN 'plus' WHEN 'la' THEN 'una' ELSE y END), '')) AS c FROM e), d AS (SELECT conv_id, turn, c, list_concat(c[2:], c[1:1]) AS dv, list_concat(c[3:], c[1:2]) AS ts, list_reverse(c) AS od FROM s)
SELECT conv_id, turn, len(c) AS n_chunks, md5(CASE turn % 4 WHEN 0 THEN 'masalah ' || CASE WHEN len(c) >= 3 THEN c[1] || ' dan ' || c[2] || ' serta ' || array_to_string(c[3:], ' dan ') WHEN len(c) = 2 THEN c[1] || ' dan ' || c[2] ELSE c[1] END || ' di kawasan lingkungan'
WHEN 1 THEN 'kendala ' || CASE WHEN len(c) >= 3 THEN dv[1] || ' terkait ' || dv[2] || ' sehubungan ' || array_to_string(dv[3:], ' terkait ') WHEN len(c) = 2 THEN c[2] || ' terkait ' || c[1] ELSE c[1] END || ' di lokasi sekitar'
WHEN 2 THEN 'persoalan ' || CASE WHEN len(c) >= 3 THEN ts[1] || ' perihal ' || ts[2] || ' mengenai ' || array_to_string(ts[3:], ' perihal ') WHEN len(c) = 2 THEN c[1] || ' perihal ' || c[2] ELSE c[1] END || ' di area kawasan'
ELSE 'gangguan ' || CASE WHEN len(c) >= 3 THEN od[1] || ' dalam hal ' || od[2] || ' pada ' || array_to_string(od[3:], ' dan ') WHEN len(c) = 2 THEN od[1] || ' dalam hal ' || od[2] ELSE 'mengenai ' || c[1] END || ' di wilayah setempat' END) AS text_md5 FROM d""")
def m21(spark, d):
    """Turns cut into constituents, with other words, and put together as a split has it."""
    chunks = F.transform(ds.constituents(F.col("text"), BREAKS), lambda c: ds.synonyms(c, SYNONYMS))
    t = table(spark, d, "conversations").select("conv_id", "turn", chunks.alias("c"))
    by = F.when(F.col("turn") % 4 == 0, ds.paraphrased(F.col("c"), "train")).when(F.col("turn") % 4 == 1, ds.paraphrased(F.col("c"), "dev")).when(F.col("turn") % 4 == 2, ds.paraphrased(F.col("c"), "test")).otherwise(ds.paraphrased(F.col("c"), "ood"))
    return t.select("conv_id", "turn", F.size("c").cast("long").alias("n_chunks"), F.md5(by).alias("text_md5"))


PLACES = ["Jalan Merdeka", "Jalan Asia Afrika", "Jalan Riau"]
OPENINGS = ["Selamat pagi admin", "Halo petugas"]
INTENTS = ["kami laporkan keluhan ini", "mohon info penanganan lokasi ini", "saran dari warga untuk perbaikan", "tolong ditangani"]
RISK_WORDS = ["warga tidak terganggu", "membahayakan pengendara"]
TIMES = ["sejak kemarin", "dua hari ini", "minggu lalu", "pagi ini", "tadi malam"]
COMPLETE = ["SUFFICIENT", "INCOMPLETE", "AMBIGUOUS"]


@query("M22_modular_records", f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS f, ({PLACES})[(o_custkey * 7 + o_orderkey) % 3 + 1] AS street, 'Kelurahan ' || (o_orderkey % 9) AS area, ({OPENINGS})[(o_custkey + o_orderkey) % 2 + 1] AS opening, ({INTENTS})[(o_custkey + o_orderkey) % 4 + 1] AS intent, ({RISK_WORDS})[o_orderkey % 2 + 1] AS risk, ({TIMES})[(o_custkey + o_orderkey * 2) % 5 + 1] AS time_, ({COMPLETE})[o_orderkey % 3 + 1] AS full_, 'tumpukan ' || lower(o_orderstatus) AS issue FROM orders),
p AS (SELECT *, CASE full_ WHEN 'SUFFICIENT' THEN street || ', ' || area WHEN 'INCOMPLETE' THEN area ELSE street || ' (patokannya belum jelas)' END AS place FROM o)
SELECT k AS o_orderkey, opening || ', ' || intent || '. Ada ' || issue || ' di ' || place || '. Terlihat ' || time_ || '. Kondisinya ' || risk || '.' AS text, CASE full_ WHEN 'SUFFICIENT' THEN 'EXECUTE' WHEN 'INCOMPLETE' THEN 'REQUEST_CLARIFICATION' ELSE 'RE_EVALUATE' END AS action, CASE full_ WHEN 'SUFFICIENT' THEN '' WHEN 'INCOMPLETE' THEN 'location_detail' ELSE 'ambiguous_context' END AS missing,
'OBJ:' || issue || CASE full_ WHEN 'SUFFICIENT' THEN '|LOC:' || street || '|LOC:' || area WHEN 'INCOMPLETE' THEN '|LOC:' || area ELSE '|LOC:' || street END || '|TIME:' || time_ AS spans FROM p""")
def m22(spark, d):
    """Records from pools taken by the index modulo their size, with the spans of their parts."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("f"), F.concat(F.lit("tumpukan "), F.lower("o_orderstatus")).alias("issue"))
    r = ds.modular_records(o, F.col("f"), F.col("k"), F.col("issue"), PLACES, F.concat(F.lit("Kelurahan "), F.col("k") % 9), OPENINGS, INTENTS, RISK_WORDS, TIMES, COMPLETE)
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return r.select(F.col("k").alias("o_orderkey"), "text", "action", "missing", F.array_join(shown, "|").alias("spans"))


@query("M23_threshold_precedence", """
WITH t AS (SELECT event_id, (['intent_f1', 'ece', 'macro_f1', 'other'])[event_id % 4 + 1] AS name, event_type, value, user_id FROM events)
SELECT event_id, name, CASE WHEN event_type = 'error' THEN value WHEN event_type = 'click' AND name IN ('ece', 'other') THEN 0.5::DOUBLE WHEN user_id % 2 = 0 AND name IN ('ece', 'macro_f1') THEN 0.25::DOUBLE ELSE CASE name WHEN 'intent_f1' THEN 0.9::DOUBLE WHEN 'ece' THEN 0.08::DOUBLE WHEN 'macro_f1' THEN 0.85::DOUBLE END END AS threshold FROM t""")
def m23(spark, d):
    """Explicit for errors, a map of overrides for clicks, a JSON config for every second user, else the defaults."""
    name = F.get(F.array(*map(F.lit, ["intent_f1", "ece", "macro_f1", "other"])), (F.col("event_id") % 4).cast("int"))
    overrides = F.when(F.col("event_type") == "click", F.create_map(F.lit("ece"), F.lit(0.5), F.lit("other"), F.lit(0.5)))
    config = F.when(F.col("user_id") % 2 == 0, '{"target_metric_thresholds": {"ece": 0.25, "macro_f1": 0.25}}').otherwise("{}")
    t = ds.threshold(name, F.when(F.col("event_type") == "error", F.col("value")), overrides, config, {"intent_f1": 0.9, "ece": 0.08, "macro_f1": 0.85})
    return table(spark, d, "events").select("event_id", name.alias("name"), t.alias("threshold"))


@query("M24_audit_wrapper", f"SELECT bool_and(n = 0) AS passed FROM ({AUDIT_SQL}) WHERE audit = 'text'")
def m24(spark, d):
    return d12(spark, d).where("audit = 'text'").agg(F.bool_and(F.col("n") == 0).alias("passed"))


@query("L7_turn_samples", "SELECT conv_id, turn, unnest(range(turn + 1))::BIGINT AS bubble FROM conversations")
def l7(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turn"))).alias("bubble"))
