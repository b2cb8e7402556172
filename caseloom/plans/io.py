"""Queries over sources, normalisers and sinks (families A, C1 to C4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseloom.operators import intake
from caseloom.operators.shared import new_folder
from caseloom.sources import broker, files, payloads

from .registry import query, table


def _us(c):
    return F.unix_micros(c.cast("timestamp"))


@query("A1_trajectory_shape", """
WITH c AS (SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1)
SELECT 'sc-' || conv_id AS scenario_id, turns, chars, CASE WHEN conv_id % 5 = 0 THEN 'c' || conv_id END AS concept_id, CASE conv_id % 10 WHEN 1 THEN 'family_id' WHEN 2 THEN 'split' END AS reject FROM c""")
def a1(spark, d):
    """Conversations as JSON lines (and blank ones), read back as trajectories: a legacy field moves, what is missing is named."""
    k = F.col("conv_id")
    bubble = F.struct(F.concat(F.lit("m"), "turn").alias("source_message_id"), F.col("text"), F.lit(0).alias("offset_seconds"))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), F.array(bubble).alias("bubbles"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    record = F.struct(F.concat(F.lit("sc-"), k).alias("scenario_id"), F.when(k % 10 != 1, "f").alias("family_id"), F.when(k % 10 == 2, "other").otherwise("dev").alias("split"), F.when(k % 5 == 0, F.concat(F.lit("c"), k)).alias("concept_id"), "turns")
    path = new_folder(spark, "trajectories")
    c.select(F.explode(F.array(F.to_json(record), F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    t = files.trajectories(spark, path)
    chars = F.aggregate(F.flatten(F.transform("turns", lambda x: x["bubbles"])), F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"]))
    return t.select("scenario_id", F.size("turns").cast("long").alias("turns"), chars.alias("chars"), F.try_element_at("world_truth", F.lit("concept_id")).alias("concept_id"), "reject")


@query("A2_jsonl_rows", """SELECT event_type, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS line FROM events""")
def a2(spark, d):
    """Events written as JSON lines by type, and the lines read back."""
    path = new_folder(spark, "jsonl")
    files.write_jsonl(table(spark, d, "events").select("event_id", "user_id", "event_type"), path, ["event_type"])
    lines = spark.read.text(path, recursiveFileLookup=True)
    return lines.select(F.regexp_extract(F.col("_metadata.file_path"), "/event_type=([^/]*)/", 1).alias("event_type"), F.col("value").alias("line"))


@query("A3_corpus_lines", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'raw ' || props ELSE event_type END AS text FROM events""")
def a3(spark, d):
    kind = F.col("event_type")
    line = F.when(kind == "error", F.lit('{"split": "test", "text": "x"}')).when(kind == "view", F.concat(F.lit("raw "), "props")).otherwise(F.concat(F.lit('{"split": "train", "body": "'), kind, F.lit('"}')))
    return table(spark, d, "events").select("event_id", files.corpus_line(line).alias("text"))


@query("A4_held_out_items", "SELECT item_id, length(text)::INT AS n_chars FROM benchmark")
def a4(spark, d):
    body = F.to_json(F.struct(F.array(F.struct("item_id", "text")).alias("items")))
    item = F.explode(F.from_json(body, "items array<struct<item_id:bigint,text:string>>")["items"]).alias("i")
    return table(spark, d, "benchmark").select(item).select("i.item_id", F.length("i.text").alias("n_chars"))


@query("A5_fixture_replay", "SELECT conv_id, turn, epoch_us(TIMESTAMP '2026-09-11' + turn * INTERVAL 2 SECOND) AS received_us FROM conversations")
def a5(spark, d):
    bubble = F.struct(F.col("turn").cast("string").alias("source_message_id"), "text", (F.col("turn") * 2).cast("int").alias("offset_seconds"))
    f = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.collect_list(bubble).alias("bubbles")).withColumn("tenant_id", F.lit("research"))
    m = payloads.replayed(f, F.lit("2026-09-11").cast("timestamp"))
    return m.select(F.col("conversation_id").alias("conv_id"), F.col("source_message_id").cast("long").alias("turn"), F.unix_micros("received_at").alias("received_us"))


def _payload():
    kind, k = F.col("event_type"), F.col("user_id")
    data = F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), k).alias("chatId"), F.when(kind != "view", kind).alias("body"), F.when((kind == "view") & (k % 2 == 0), F.lit(1.5)).alias("latitude"), (k % 7 == 0).alias("fromMe"))
    return F.to_json(F.struct(F.when(kind == "error", "ack").otherwise("message.received").alias("event"), data.alias("data")))


@query("A6_webhook", """SELECT event_id, 'u' || user_id AS conversation_id, CASE WHEN event_type = 'view' THEN '[Pin Lokasi]' ELSE event_type END AS text FROM events WHERE event_type <> 'error' AND (event_type <> 'view' OR user_id % 2 = 0)""")
def a6(spark, d):
    t = table(spark, d, "events").select("event_id", payloads.webhook(_payload(), "t").alias("m")).where("m IS NOT NULL")
    return t.select("event_id", "m.conversation_id", "m.text")


@query("A7_connector_keys", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 's' || user_id ELSE 'p' || user_id END AS source_id FROM events")
def a7(spark, d):
    u = F.col("user_id")
    body = F.when(u % 3 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("s"), u).alias("_serialized")).alias("id")))).otherwise(F.to_json(F.struct(F.concat(F.lit("p"), u).alias("id"))))
    return table(spark, d, "events").select("event_id", payloads.required(body, "source_message_id", "id").alias("source_id"))


@query("A8_message_time", "SELECT event_id, CASE WHEN user_id % 4 = 3 THEN 0 ELSE epoch_us(ts) // 1000000 * 1000000 END AS received_us FROM events")
def a8(spark, d):
    s, u = F.floor(_us(F.col("ts")) / 1000000).cast("long"), F.col("user_id") % 4
    value = F.when(u == 0, s.cast("string")).when(u == 1, (s * 1000).cast("string")).when(u == 2, F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_micros(payloads.message_time(value, F.timestamp_seconds(F.lit(0)))).alias("received_us"))


@query("A9_social_time", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN epoch_us(ts) // 1000000 * 1000000 END AS published_us FROM events")
def a9(spark, d):
    s = F.floor(_us(F.col("ts")) / 1000000).cast("long").cast("string")
    return table(spark, d, "events").select("event_id", F.unix_micros(payloads.social_time(F.when(F.col("user_id") % 3 == 0, s).otherwise("yesterday"))).alias("published_us"))


@query("A10_social_item", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN substr(url, 1, 256) ELSE 'sha256:' || sha256('web|host|') END AS external_id, '(tanpa teks)' AS text FROM pages""")
def a10(spark, d):
    k = F.col("page_id") % 3
    item = F.to_json(F.struct(F.when(k == 0, F.col("page_id").cast("string")).alias("id"), F.when(k == 1, F.col("url")).alias("link"), F.struct(F.lit("host").alias("username")).alias("user"), F.lit("  ").alias("text")))
    p = payloads.social_post(F.lit("web"), F.lit("q"), item)
    return table(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", "p.external_id", "p.text")


@query("A11_collect_first", "SELECT event_type AS platform, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def a11(spark, d):
    posts = table(spark, d, "events").select(F.col("event_type").alias("platform"), F.col("user_id").alias("external_id"), "event_id")
    return payloads.collected(posts, "event_id").select("platform", F.col("external_id").alias("user_id"), "event_id")


@query("A12_envelope_parse", "SELECT event_id, CASE WHEN user_id % 3 < 2 THEN (json_extract(props, '$.k'))::INT END AS k FROM events")
def a12(spark, d):
    u = F.col("user_id") % 3
    out = F.when(u == 0, F.col("props")).when(u == 1, F.concat(F.lit("starting\n"), "props", F.lit("\ndone"))).otherwise("no json here")
    return table(spark, d, "events").select("event_id", F.get_json_object(payloads.envelope(out), "$.k").cast("int").alias("k"))


@query("A13_broker_envelopes", "SELECT event_id::VARCHAR AS event_id, event_type || '.events' AS topic, user_id::VARCHAR AS partition_key, value, 'evt/' || event_type AS headers FROM events")
def a13(spark, d):
    """Events as a broker takes them (key, value, headers in bytes), and as its source gives them back."""
    sent = broker.encoded(table(spark, d, "events").withColumn("topic", F.concat("event_type", F.lit(".events"))), "topic", "user_id", "event_id", F.struct("event_id", "value"), {"kind": F.lit("evt"), "event_type": F.col("event_type")})
    got = broker.decoded(sent)
    headers = F.concat_ws("/", F.element_at("headers", "kind"), F.element_at("headers", "event_type"))
    return got.select("event_id", "topic", "partition_key", F.get_json_object("payload", "$.value").cast("double").alias("value"), headers.alias("headers"))


@query("A14_log_offsets", "SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS log_offset FROM events")
def a14(spark, d):
    """The offset of each event in its topic; topics of any size, as ranges of a topic are numbered apart."""
    return broker.appended(table(spark, d, "events").select(F.col("event_type").alias("topic"), "event_id"), "topic", [F.col("event_id")], "log_offset")


@query("A14_poll_and_commit", """
WITH l AS (SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS o FROM events), g AS (SELECT DISTINCT topic, CASE WHEN topic = 'error' THEN 0 ELSE length(topic) * 3 END AS start FROM l), p AS (SELECT l.* FROM l JOIN g USING (topic) WHERE o >= start AND o < start + 10)
SELECT topic, count(*) AS polled, min(event_id) AS first_event, max(o) + 1 AS committed FROM p GROUP BY 1""")
def a14b(spark, d):
    """Ten messages of each topic from its committed offset, and the offset after them."""
    log = broker.appended(table(spark, d, "events").select(F.col("event_type").alias("topic"), "event_id"), "topic", [F.col("event_id")], "log_offset")
    at = log.select("topic").distinct().where("topic <> 'error'").select("topic", (F.length("topic") * 3).cast("long").alias("committed"))
    polled = broker.polled(log, at, "topic", "log_offset", 10)
    after = broker.committed(at, polled, "topic", "log_offset")
    return polled.groupBy("topic").agg(F.count(F.lit(1)).alias("polled"), F.min("event_id").alias("first_event")).join(after, "topic")


@query("A15_relational_store", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3")
def a15(spark, d):
    """Nations through a transaction, into a store and back in ranges of the key; one is refused, so nothing of its batch stays."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    files.transaction(spark, url, ["CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(64), n_regionkey INT)"])
    files.write_jdbc(rows.where("n_regionkey <> 3"), url, "nation")
    try:
        files.transaction(spark, url, ["DELETE FROM nation WHERE n_nationkey < 10", "INSERT INTO nation SELECT * FROM nation"])
        raise AssertionError("a repeated key was taken")
    except files.TransactionFailed:
        pass
    back = files.jdbc(spark, url, "SELECT * FROM nation", "n_nationkey", 0, 25, 4)
    return back.select(*(F.col(c).cast("long" if c.lower() != "n_name" else "string").alias(c.lower()) for c in back.columns))


@query("A16_digest_verification", "SELECT CASE WHEN lang = 'gone' THEN 'missing' WHEN lang = 'up' THEN 'unsafe_path' WHEN lang > 'en' THEN 'mismatch' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT DISTINCT lang FROM documents UNION ALL SELECT 'gone' UNION ALL SELECT 'up') GROUP BY 1")
def a16(spark, d):
    """Files by language and their manifest: some digests are another's, one file is not there, one path leads out."""
    folder = new_folder(spark, "artifacts")
    made = files.exported(table(spark, d, "documents").select("lang", "doc_id", "text"), folder, "lang")
    listed = made.select("path", F.when(F.col("split") > "en", F.sha2("sha256", 256)).otherwise(F.upper("sha256")).alias("sha256"))
    odd = spark.createDataFrame([("data/none.json", "00"), ("../up", "00")], listed.schema)
    return files.verified(spark, folder, listed.union(odd)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("A17_export", "SELECT lang AS split, count(*) AS records, true AS listed, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def a17(spark, d):
    """An export by split with its manifest and sums, checked against the files."""
    folder = new_folder(spark, "export")
    made = files.exported(table(spark, d, "documents").select("lang", "doc_id", "text"), folder, "lang")
    good = files.verified(spark, folder, made.select("split", "path", "records", "sha256"))
    sums = spark.read.text(f"{folder}/sha256sums").select(F.split_part("value", F.lit("  "), F.lit(2)).alias("path"), F.split_part("value", F.lit("  "), F.lit(1)).alias("sum"))
    by = good.join(sums, "path", "left").groupBy("split").agg(F.sum("records").alias("records"), F.bool_and((F.col("status") == "ok") & (F.col("sum") == F.col("sha256"))).alias("listed"))
    back = spark.read.schema("doc_id long, text string, lang string").json(f"{folder}/data").groupBy(F.col("lang").alias("split")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))
    return by.join(back, "split")


@query("A18_lineage_stats", """
WITH f AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY trim(text, ' ') ORDER BY doc_id) AS r FROM documents WHERE trim(text, ' ') <> '') WHERE r = 1)
SELECT (SELECT count(*) FROM documents) AS raw_records, count(*) AS clean_records, sha256(string_agg(trim(text, ' '), chr(10) ORDER BY doc_id)) AS clean_sha256, (SELECT sha256(string_agg(text, chr(10) ORDER BY doc_id)) FROM documents) AS raw_sha256 FROM f""")
def a18(spark, d):
    """Records before and after copies are left out, and the hash of either corpus as one text."""
    return files.lineage(table(spark, d, "documents"), "doc_id", "text")


@query("A19_metrics_text", """WITH c AS (SELECT event_type, user_id % 2 AS side, count(*) AS n, sum(user_id) AS total FROM events GROUP BY 1, 2) SELECT event_type || '_count{side="' || side || '"} ' || n AS line FROM c UNION ALL SELECT event_type || '_sum{side="' || side || '"} ' || total FROM c""")
def a19(spark, d):
    c = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("total"))
    return files.prometheus(c, "event_type", ["side"], "n", "total")


@query("A20_report_rows", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def a20(spark, d):
    return files.markdown(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("A21_conditional_migration", "SELECT * FROM (VALUES (1, 'created'), (2, 'present'), (3, 'present')) t(step, outcome)")
def a21(spark, d):
    """A table made where it is not there yet, three times."""
    name = f"migrated_{uuid.uuid4().hex}"
    made = [(i, files.migrated(spark, name, "n_nationkey BIGINT, n_name STRING", new_folder(spark, "migrated"))) for i in (1, 2, 3)]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([(i, "created" if new else "present") for i, new in made], "step int, outcome string")


@query("A22_registration", "SELECT n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'insert' WHEN n_nationkey % 2 = 0 THEN 'same' ELSE 'skip' END AS action FROM nation")
def a22(spark, d):
    n = table(spark, d, "nation")
    new = n.select(F.col("n_name").alias("name"), F.lit("1").alias("version"), F.lit("a").alias("digest"))
    known = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.lit("1").alias("version"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("digest"))
    return payloads.registration(new, known).select("name", "action")


@query("C1_self_sent", "SELECT event_id, user_id % 7 = 0 OR event_type = 'error' AS self_sent FROM events")
def c1(spark, d):
    flag = F.when(F.col("user_id") % 7 == 0, "TRUE").otherwise("no")
    ident = F.concat(F.when(F.col("event_type") == "error", "true_").otherwise(""), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", intake.self_sent([flag], F.lit("a"), F.lit("b"), ident).alias("self_sent"))


@query("C2_receipt_only", "SELECT event_id, event_type = 'error' OR (event_type = 'view' AND user_id % 2 = 0) AS receipt FROM events")
def c2(spark, d):
    kind = F.col("event_type")
    ack = F.when(F.col("user_id") % 2 == 0, F.lit(1))
    made = intake.receipt_only([], F.when(kind == "error", "ACK").otherwise("message"), F.lit("chat"), F.when(kind != "view", kind), ack, F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", made.alias("receipt"))


@query("C3_group_chat", "SELECT event_id, user_id % 5 = 0 AS grouped FROM events")
def c3(spark, d):
    address = F.concat(F.lit("x"), F.when(F.col("user_id") % 5 == 0, "@g.us").otherwise("@c.us"))
    return table(spark, d, "events").select("event_id", intake.group_chat([F.lit("0")], [address]).alias("grouped"))


@query("C4_accepted", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' AND (event_type <> 'view' OR user_id % 2 = 0) GROUP BY 1")
def c4(spark, d):
    t = table(spark, d, "events").where(payloads.webhook(_payload(), "t").isNotNull())
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
