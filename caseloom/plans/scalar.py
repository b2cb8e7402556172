"""Queries over the scalar functions (string, hash, math, vector, time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import scores, text, vectors

from .registry import query, table

WORD = r"([\p{L}\p{M}\p{N}_]+)"


@query("I1_normalized_hash", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text_hash FROM documents")
def i1(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query("I2_word_tokens", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}', 1) AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct, w[1] AS first_token FROM t""")
def i2(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.get("w", F.lit(0)).alias("first_token"))


@query("I3_token_offsets", r"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+)', 1)) AS token, generate_subscripts(regexp_extract_all(text, '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+)', 1), 1) AS i FROM conversations),
o AS (SELECT *, (sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(token))::BIGINT AS token_start FROM t)
SELECT conv_id, turn, token, token_start, token_start + length(token) AS token_end FROM o WHERE NOT regexp_matches(token, '^\s')""")
def i3(spark, d):
    from caseloom.operators.spans import tokens_with_offsets

    return tokens_with_offsets(table(spark, d, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "token", "token_start", "token_end")


@query("I4_ascii_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '([a-z0-9_\-]+)', 1))::INT AS n_tokens FROM documents")
def i4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.ascii_tokens(F.col("text"))).alias("n_tokens"))


@query("I5_stripped_words", r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,!?:;"''()\[\]{}]+|[.,!?:;"''()\[\]{}]+$', '', 'g')), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_words, w[-1] AS last_word FROM t""")
def i5(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.stripped_words(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_words"), F.try_element_at("w", F.lit(-1)).alias("last_word"))


@query("I6_stop_worded_sets", r"""
WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_\-]+)', 1)), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'que', 'der', 'les', 'die', 'con')) AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_terms, list_sort(w)[1] AS least_term FROM t""")
def i6(spark, d):
    w = text.stop_worded(F.col("text"), ["the", "and", "que", "der", "les", "die", "con"])
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_terms"), F.array_min("w").alias("least_term"))


@query("I7_connector_split", r"""
WITH t AS (SELECT doc_id, text, regexp_extract(text, '^(?s:(.*?)) (?:for|pour|para|für) (?s:(.*))$', ['left', 'right']) AS a, regexp_extract(text, '^(?s:(.*?)) (?:with|avec|con|mit) (?s:(.*))$', ['left', 'right']) AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN length(trim(a['left'])) >= 8 AND length(trim(a['right'])) >= 8 THEN {'cause': trim(a['right']), 'effect': trim(a['left'])} WHEN length(trim(b['left'])) >= 8 AND length(trim(b['right'])) >= 8 THEN {'cause': trim(b['left']), 'effect': trim(b['right'])} END AS s FROM t)
SELECT doc_id, sha256(s.cause) AS cause_hash, length(s.effect)::INT AS effect_chars FROM s""")
def i7(spark, d):
    s = text.connector_split(F.col("text"), [(" (?:for|pour|para|für) ", True), (" (?:with|avec|con|mit) ", False)])
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.sha2("s.cause", 256).alias("cause_hash"), F.length("s.effect").alias("effect_chars"))


@query("I8_location_hints", r"""
SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, ' (?:of|de|von|der) ([a-zA-Z0-9\-]+(?: [a-zA-Z0-9\-]+){0,3})', 1), lambda h: trim(h)), lambda h: length(h) >= 4))::INT AS n_hints FROM documents""")
def i8(spark, d):
    hints = text.location_hints(F.col("text"), r" (?:of|de|von|der) ([a-zA-Z0-9\-]+(?: [a-zA-Z0-9\-]+){0,3})")
    return table(spark, d, "documents").select("doc_id", F.size(hints).alias("n_hints"))


@query("I10_slang", r"""
SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split(text, ' '), lambda w: coalesce(CASE regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g') WHEN 'the' THEN 'th' WHEN 'que' THEN 'q' WHEN 'und' THEN 'n' WHEN 'para' THEN 'pa' END || regexp_extract(w, '([.,!?])$', 1), w)), ' ')) AS shortened_hash FROM conversations""")
def i10(spark, d):
    short = text.slang(F.col("text"), {"the": "th", "que": "q", "und": "n", "para": "pa"})
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(short, 256).alias("shortened_hash"))


@query("I10_typos", r"""
SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) >= 5 AND (i - 1) % 7 = 3
 AND regexp_matches(substr(w, (length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) // 2 + 1)::BIGINT, 2), '^\p{L}\p{L}$')
 THEN substr(w, 1, (length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) // 2)::BIGINT) || substr(w, (length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) // 2 + 2)::BIGINT, 1) || substr(w, (length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) // 2 + 1)::BIGINT, 1) || substr(w, (length(regexp_replace(lower(w), '^[.,!?:;]+|[.,!?:;]+$', '', 'g')) // 2 + 3)::BIGINT)
 ELSE w END), ' ')) AS typo_hash FROM conversations""")
def i10_typos(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.typos(F.col("text"), 3), 256).alias("typo_hash"))


@query("I12_message_id", r"""
WITH t AS (SELECT doc_id, source || ':conn:acct:' || text AS whole FROM documents)
SELECT doc_id, CASE WHEN length(whole) <= 128 THEN whole ELSE substr(regexp_extract(whole, '^([^:]*:conn:acct)', 1) || ':' || sha256(whole), 1, 128) END AS message_id FROM t""")
def i12(spark, d):
    """Ids of whole texts."""
    return table(spark, d, "documents").select("doc_id", text.message_id(F.col("source"), F.lit("conn"), F.lit("acct"), F.col("text")).alias("message_id"))


@query("I13_reply_template", "SELECT o_orderkey, 'Case ' || o_orderkey || ' (' || o_orderpriority || ') is now ' || CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END || '.' AS reply FROM orders")
def i13(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
    return table(spark, d, "orders").select("o_orderkey", F.format_string("Case %d (%s) is now %s.", "o_orderkey", "o_orderpriority", state).alias("reply"))


@query("I15_landmark_masking", r"""
WITH t AS (SELECT doc_id, text, substr(text, 1, 5) || substr(text, 11, 10) || substr(text, 31) AS cut FROM documents)
SELECT doc_id, sha256(CASE WHEN length(trim(regexp_replace(cut, '\s+', ' ', 'g'))) >= 10 THEN trim(regexp_replace(cut, '\s+', ' ', 'g')) ELSE text END) AS masked_hash FROM t""")
def i15(spark, d):
    """Every document, spans ending with the text."""
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(20).alias("start"), F.lit(30).alias("end")))
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.sha2(text.masked_spans(F.col("text"), spans), 256).alias("masked_hash"))


@query("I16_json_salvage", r"SELECT event_id, (json_extract(regexp_extract('note ```json ' || props || ' ``` end', '(?s)(\{.*\})', 1), '$.k'))::INT AS k FROM events")
def i16(spark, d):
    stray = F.concat(F.lit("note ```json "), F.col("props"), F.lit(" ``` end"))
    return table(spark, d, "events").select("event_id", F.from_json(text.salvaged_json(stray, array=False), "k int")["k"].alias("k"))


@query("I17_idempotency_key", "SELECT o_orderkey, 'tenant:' || o_custkey || ':' || o_orderkey || ':ticket:create:v1' AS idempotency_key FROM orders")
def i17(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", F.lit("tenant"), "o_custkey", "o_orderkey", F.lit("ticket:create:v1")).alias("idempotency_key"))


@query("I18_path_check", r"SELECT page_id, length(p) > 0 AND NOT regexp_matches(p, '(^|/)\.\.?(/|$)') AND NOT starts_with(p, '/') AS ok FROM (SELECT page_id, regexp_replace(url, '^https?://', CASE page_id % 4 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE '' END) AS p FROM pages)")
def i18(spark, d):
    lead = F.when(F.col("page_id") % 4 == 0, "../").when(F.col("page_id") % 4 == 1, "/").otherwise("")
    path = F.concat(lead, F.regexp_replace("url", "^https?://", ""))
    return table(spark, d, "pages").select("page_id", text.valid_path(path).alias("ok"))


@query("I19_secret_scrub", r"SELECT event_id, regexp_replace('token=' || user_id || ' ' || event_type, '(?i)(password|token|secret|api[_-]?key)\s*[=:]\s*\S+', '\1=***', 'g') AS message FROM events")
def i19(spark, d):
    return table(spark, d, "events").select("event_id", text.scrubbed(F.concat(F.lit("token="), "user_id", F.lit(" "), "event_type")).alias("message"))


@query("I20_identifier_leak", r"SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])[0-9]{3,}([^A-Za-z0-9_]|$)') AS has_identifier, contains(lower(text), lower(source)) AS leaks_source FROM documents")
def i20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"(?<![A-Za-z0-9_])[0-9]{3,}(?![A-Za-z0-9_])").alias("has_identifier"), F.lower("text").contains(F.lower("source")).alias("leaks_source"))


@query("J1_dot_product", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def j1(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("J2_cosine_variants", """
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, list_transform(b.embedding::DOUBLE[], lambda v: v * 2) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-9), 6) AS smooth, round(list_cosine_similarity(x, y), 6) AS strict, round(greatest(0.0, least(1.0, list_cosine_similarity(x, y))), 6) AS clamped FROM p""")
def j2(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda v: v.cast("double") * 2).alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return e.join(other, "vec_id").select("vec_id", *(F.round(vectors.cosine(x, y, k), 6).alias(k) for k in ("smooth", "strict", "clamped")))


@query("J3_hashed_embedding", rf"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{WORD}', 1)) AS w FROM conversations),
s AS (SELECT conv_id, turn, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 768)::INT AS slot, count(*) AS n FROM t GROUP BY ALL)
SELECT conv_id, turn, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM s""")
def j3(spark, d):
    from caseloom.operators.retrieval import hashed_embedding

    return hashed_embedding(table(spark, d, "conversations"), ["conv_id", "turn"], dimension=768).select("conv_id", "turn", "slot", F.round("weight", 6).alias("weight"))


@query("J4_signed_embedding", rf"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{WORD}', 1)) AS w FROM conversations),
s AS (SELECT conv_id, turn, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 256)::INT AS slot, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS n FROM t GROUP BY ALL),
u AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS total FROM s)
SELECT conv_id, turn, slot, round(CASE WHEN total > 0 THEN n / total ELSE 0.0 END, 6) AS weight FROM u WHERE n <> 0""")
def j4(spark, d):
    from caseloom.operators.retrieval import hashed_embedding

    return hashed_embedding(table(spark, d, "conversations"), ["conv_id", "turn"], dimension=256, signed=True).select("conv_id", "turn", "slot", F.round("weight", 6).alias("weight"))


@query("J8_softmax", """
WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / 0.5) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM t)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[4] / list_sum(e), 6) AS p3 FROM e""")
def j8(spark, d):
    p = vectors.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.5)
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[3], 6).alias("p3"))


@query("J10_trust", """
WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS k FROM events GROUP BY 1),
t AS (SELECT user_id, n, k + 20.0 * (96.0 / 102.0) AS a, n - k + 20.0 * (1.0 - 96.0 / 102.0) AS b FROM s),
m AS (SELECT user_id, n, (a / (a + b))::DOUBLE AS mean, (a * b / ((a + b) * (a + b) * (a + b + 1.0)))::DOUBLE AS var FROM t)
SELECT user_id, round(mean, 6) AS posterior_mean, round(greatest(0.0, least(1.0, mean - 1.2815515655446004 * sqrt(var))), 6) AS lower_bound, n < 30 AS used_parent FROM m""")
def j10(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("k"))
    t = scores.trust(F.col("k"), F.col("n"), F.lit(0.0), F.lit(0.0), F.lit(95), F.lit(100), F.lit(0.95))
    return s.select("user_id", t.alias("t")).select("user_id", F.round("t.posterior_mean", 6).alias("posterior_mean"), F.round("t.lower_bound", 6).alias("lower_bound"), "t.used_parent")


@query("J11_conflict", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'AUTHORITY' WHEN 1 THEN 'RISK' WHEN 2 THEN 'TEXT_IMAGE' WHEN 3 THEN 'LOCATION' WHEN 4 THEN 'EVIDENCE' ELSE 'INTENT' END AS kind, l_returnflag AS a, l_linestatus AS b, l_discount * 10 AS x, l_tax * 10 AS y, l_quantity / 50 AS w, l_partkey % 5 = 0 AS v FROM lineitem)
SELECT kind, severity, count(*) AS n, round(sum(score), 3) AS total FROM (SELECT kind, CASE WHEN kind = 'AUTHORITY' THEN 'HARD' WHEN kind = 'RISK' AND w >= 0.8 THEN 'CRITICAL' WHEN kind = 'TEXT_IMAGE' AND v THEN 'CRITICAL' WHEN kind IN ('LOCATION', 'EVIDENCE') THEN 'MATERIAL' ELSE 'MINOR' END AS severity, CASE WHEN kind = 'AUTHORITY' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, least(x, y) * w) END AS score FROM t WHERE lower(a) <> lower(b)) GROUP BY ALL""")
def j11(spark, d):
    k = F.col("l_partkey") % 6
    kind = F.when(k == 0, "AUTHORITY").when(k == 1, "RISK").when(k == 2, "TEXT_IMAGE").when(k == 3, "LOCATION").when(k == 4, "EVIDENCE").otherwise("INTENT")
    c = scores.conflict(F.col("kind"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(False), F.col("l_partkey") % 5 == 0)
    found = table(spark, d, "lineitem").withColumn("kind", kind).select("kind", c.alias("c")).where("c IS NOT NULL")
    return found.groupBy("kind", F.col("c.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c.score"), 3).alias("total"))


@query("J12_haversine", "SELECT event_id, round(2 * asin(sqrt(power(sin(radians((user_id % 90) - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians((user_id % 90)::DOUBLE)) * power(sin(radians(value - 20.0) / 2), 2))) * 6371, 3) AS km FROM events")
def j12(spark, d):
    return table(spark, d, "events").select("event_id", F.round(vectors.haversine(F.lit(10.0), F.lit(20.0), (F.col("user_id") % 90).cast("double"), F.col("value")), 3).alias("km"))


@query("J14_ngrams", r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}_]+)', 1) AS w FROM conversations)
SELECT conv_id, turn, len(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END))::INT AS n_trigrams FROM t""")
def j14(spark, d):
    grams = text.ngrams(text.word_tokens(F.col("text")), 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(grams)).alias("n_trigrams"))


@query("J15_common_ngrams", r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}_]+)', 1) AS w FROM conversations),
g AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i:i + 1]) ELSE [] END) AS g FROM t)
SELECT conv_id, turn, count(*) FILTER (list_has_all(['the', 'of', 'and', 'in', 'de', 'la', 'que', 'der', 'die', 'und'], g)) AS n_common FROM g GROUP BY ALL""")
def j15(spark, d):
    common = F.array(*map(F.lit, ["the", "of", "and", "in", "de", "la", "que", "der", "die", "und"]))
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.ngrams(text.word_tokens(F.col("text")), 2)).alias("g"))
    return t.groupBy("conv_id", "turn").agg(F.count_if(F.forall(F.split("g", " "), lambda w: F.array_contains(common, w))).alias("n_common"))


@query("J16_uniform_hash", "SELECT doc_id, ('0x' || substr(sha256('42:' || source), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents")
def j16(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.unit_hash(F.concat(F.lit("42:"), "source")).alias("u"))


@query("J17_tag_weights", "SELECT event_type, round(CASE WHEN event_type LIKE 'e%' THEN greatest(1.0, 0.8 * length(event_type)) ELSE length(event_type) * 1.0 END, 6)::DOUBLE AS weight FROM events GROUP BY 1")
def j17(spark, d):
    base = F.length("event_type").cast("double")
    return table(spark, d, "events").select("event_type").distinct().select("event_type", F.round(F.when(F.col("event_type").startswith("e"), F.greatest(F.lit(1.0), 0.8 * base)).otherwise(base), 6).alias("weight"))


@query("J18_head_slices", "SELECT vec_id, round(list_sum(embedding[1:12]::DOUBLE[]), 6) AS head_a, round(list_sum(embedding[13:16]::DOUBLE[]), 6) AS head_b FROM embeddings")
def j18(spark, d):
    total = lambda a, n: F.round(F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return table(spark, d, "embeddings").select("vec_id", total(1, 12).alias("head_a"), total(13, 4).alias("head_b"))


@query("J19_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def j19(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("best"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("J20_json_access", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def j20(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("J21_time_arithmetic", "SELECT event_id, epoch_us(ts + INTERVAL 5 SECOND) AS due_us, epoch_us(ts - INTERVAL 48 HOUR) AS horizon_us, epoch_us(ts + INTERVAL 72 HOUR) AS expires_us FROM events")
def j21(spark, d):
    ts = F.col("ts").cast("timestamp")
    us = lambda c: F.unix_micros(c)
    return table(spark, d, "events").select("event_id", us(ts + F.expr("INTERVAL 5 SECOND")).alias("due_us"), us(ts - F.expr("INTERVAL 48 HOUR")).alias("horizon_us"), us(ts + F.expr("INTERVAL 72 HOUR")).alias("expires_us"))


@query("J22_greatest_coalesce", "SELECT o_orderkey, greatest(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, -1.0), 1000.0)::DOUBLE AS floor_price, nullif(o_orderstatus, 'P') AS settled FROM orders")
def j22(spark, d):
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", F.greatest(F.coalesce(price, F.lit(-1.0)), F.lit(1000.0)).alias("floor_price"), F.nullif("o_orderstatus", F.lit("P")).alias("settled"))


@query("J23_any_substring", "SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'ung') OR contains(lower(text), 'mente') AS any_cue FROM documents")
def j23(spark, d):
    return table(spark, d, "documents").select("doc_id", text.any_word(F.lower("text"), ["tion", "ung", "mente"]).alias("any_cue"))


@query("L8_uuid5", r"""
WITH t AS (SELECT o_orderkey, sha1('\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB || ('case:' || o_orderkey)::BLOB) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS case_id FROM t""")
def l8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("case:"), "o_orderkey")).alias("case_id"))
