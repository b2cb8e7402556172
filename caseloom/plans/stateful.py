"""Queries over the replayable stateful operators (families F3, K, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.operators import intake, ledger

from .registry import query, table

E = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value, (json_extract(props, '$.k'))::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
NEXT = "ON e.user_id = b.user_id AND e.i = b.i + 1"
BURSTS = f"""
WITH RECURSIVE {E},
b(user_id, event_id, t, i, burst, first) AS (SELECT user_id, event_id, t, i, 0, t FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.t, e.i, CASE WHEN e.t > least(b.first + 86400000000, b.t + 21600000000) THEN b.burst + 1 ELSE b.burst END, CASE WHEN e.t > least(b.first + 86400000000, b.t + 21600000000) THEN e.t ELSE b.first END FROM b JOIN e {NEXT})
"""
HOUR = 3600 * 1_000_000


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _events(spark, d):
    return table(spark, d, "events").withColumn("t", ledger.micros("ts")).withColumn("k", _k())


def _bursts(spark, d):
    return intake.bursts(table(spark, d, "events"), ["user_id"], "ts", "event_id", 6 * 3600, 24 * 3600)


def _firings(spark, d):
    g = _bursts(spark, d).join(_events(spark, d).select("event_id", "t"), "event_id").groupBy("user_id", "burst")
    return g.agg(F.count(F.lit(1)).alias("n"), F.least(F.max("t") + 6 * HOUR, F.min("t") + 24 * HOUR).alias("due_us"))


@query("K1_burst_windows", BURSTS + "SELECT user_id, event_id, burst FROM b")
def k1(spark, d):
    return _bursts(spark, d).select("user_id", "event_id", "burst")


FIRINGS = "SELECT user_id, burst, count(*) AS n, least(max(t) + 21600000000, min(t) + 86400000000) AS due_us FROM b GROUP BY 1, 2"


@query("F3_burst_deadlines", BURSTS + FIRINGS)
def f3(spark, d):
    return _firings(spark, d)


@query("K2_late_messages", BURSTS + f""", f AS ({FIRINGS}), m AS (SELECT b.user_id, b.event_id, b.t + e.k * 3600000000 AS arrived, f.due_us AS own FROM b JOIN e ON e.event_id = b.event_id JOIN f ON f.user_id = b.user_id AND f.burst = b.burst)
SELECT event_id, arrived > own AS late, (SELECT min(due_us) FROM f WHERE f.user_id = m.user_id AND f.due_us >= m.arrived) AS fired_us FROM m""")
def k2(spark, d):
    """Messages arrive up to days after they were sent: the firing that picks each up, if any has."""
    f = _firings(spark, d)
    own = _bursts(spark, d).join(f, ["user_id", "burst"]).select("event_id", F.col("due_us").alias("own"))
    m = _events(spark, d).select("user_id", "event_id", (F.col("t") + F.col("k").cast("long") * HOUR).alias("arrived"))
    got = intake.linked(m, f, "user_id", "event_id", "arrived", "due_us").select("event_id", F.col("fired").alias("fired_us"))
    return m.join(own, "event_id").join(got, "event_id").select("event_id", (F.col("arrived") > F.col("own")).alias("late"), "fired_us")


@query("K3_generations", f"""
WITH RECURSIVE {E}, a AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'claim' WHEN 'error' THEN 'finalize' ELSE 'ingest' END AS kind FROM e),
b(user_id, event_id, i, generation, fired, token, til, outcome) AS (
SELECT user_id, event_id, i, (kind = 'ingest')::INT, kind <> 'ingest', -1, -1::BIGINT, CASE kind WHEN 'ingest' THEN 'ingested' WHEN 'claim' THEN 'idle' ELSE 'conflict' END FROM a WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i,
CASE WHEN e.kind = 'ingest' AND (b.fired OR b.token >= 0) THEN b.generation + 1 WHEN e.kind = 'claim' AND NOT b.fired AND NOT (b.token >= 0 AND b.til > e.t) THEN b.generation + 1 ELSE b.generation END,
CASE WHEN e.kind = 'ingest' THEN false WHEN e.kind = 'finalize' THEN b.fired OR (b.token >= 0 AND b.token = b.generation) ELSE b.fired END,
CASE WHEN e.kind = 'ingest' AND b.fired THEN -1 WHEN e.kind = 'claim' AND NOT b.fired AND NOT (b.token >= 0 AND b.til > e.t) THEN b.generation + 1 WHEN e.kind = 'finalize' AND NOT b.fired AND b.token >= 0 AND b.token = b.generation THEN -1 ELSE b.token END,
CASE WHEN e.kind = 'ingest' AND b.fired THEN -1 WHEN e.kind = 'claim' AND NOT b.fired AND NOT (b.token >= 0 AND b.til > e.t) THEN e.t + 432000000000 WHEN e.kind = 'finalize' AND NOT b.fired AND b.token >= 0 AND b.token = b.generation THEN -1 ELSE b.til END,
CASE WHEN e.kind = 'ingest' THEN 'ingested' WHEN e.kind = 'claim' THEN CASE WHEN b.fired THEN 'idle' WHEN b.token >= 0 AND b.til > e.t THEN 'busy' ELSE 'claimed' END WHEN NOT b.fired AND b.token >= 0 AND b.token = b.generation THEN 'fired' ELSE 'conflict' END
FROM b JOIN a e {NEXT}) SELECT event_id, generation, outcome FROM b""")
def k3(spark, d):
    """Timers of users: purchases claim a lease of five days, errors finalize, all else is ingested."""
    kind = F.when(F.col("event_type") == "purchase", "claim").when(F.col("event_type") == "error", "finalize").otherwise("ingest")
    return ledger.generations(_events(spark, d), "user_id", ["t", "event_id"], kind, F.col("t"), "event_id", 120 * 3600).select("event_id", "generation", "outcome")


@query("K4_case_association", f"""
WITH RECURSIVE {E}, a AS (SELECT *, CASE WHEN k % 10 = 0 THEN event_id - 150 END AS quoted, CASE WHEN k % 7 = 0 THEN 'key-' || (k % 3) END AS label, event_type = 'error' AS closed FROM e),
p AS (SELECT a.*, q.i AS by_quote, max(CASE WHEN a.label IS NOT NULL THEN a.i END) OVER (PARTITION BY a.user_id, a.label ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_label,
max(CASE WHEN NOT a.closed THEN a.i END) OVER (PARTITION BY a.user_id ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_open FROM a LEFT JOIN a q ON q.user_id = a.user_id AND q.event_id = a.quoted AND q.i < a.i),
l AS (SELECT p.user_id, p.event_id, p.i, coalesce(p.by_quote, CASE WHEN p.label IS NOT NULL THEN p.by_label WHEN o.t >= p.t - 172800000000 THEN p.last_open END) AS parent FROM p LEFT JOIN a o ON o.user_id = p.user_id AND o.i = p.last_open),
b(user_id, event_id, i, case_no) AS (SELECT user_id, event_id, i, event_id FROM l WHERE parent IS NULL UNION ALL SELECT l.user_id, l.event_id, l.i, b.case_no FROM b JOIN l ON l.user_id = b.user_id AND l.parent = b.i)
SELECT user_id, event_id, case_no FROM b""")
def k4(spark, d):
    """The case of every event of a user, by quote, key, recency or a new case."""
    quoted = F.when(_k() % 10 == 0, F.col("event_id") - 150)
    label = F.when(_k() % 7 == 0, F.concat(F.lit("key-"), _k() % 3))
    return ledger.association(table(spark, d, "events"), "user_id", "ts", "event_id", quoted, label, F.col("event_type") == "error", 48 * 3600)


@query("K5_snapshot_revisions", BURSTS + "SELECT user_id, burst, (row_number() OVER (PARTITION BY user_id ORDER BY burst))::INT AS revision, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY i)) AS evidence_hash FROM b GROUP BY 1, 2")
def k5(spark, d):
    """One snapshot for each firing: its revision (bursts are numbered without gaps) and the hash of what it holds."""
    m = _bursts(spark, d).join(_events(spark, d).select("event_id", "t"), "event_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda x: x["event_id"].cast("string")), "\n")
    return m.groupBy("user_id", "burst").agg(F.sha2(ids, 256).alias("evidence_hash")).select("user_id", "burst", (F.col("burst") + 1).alias("revision"), "evidence_hash")


@query("K6_idempotent_ingest", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) <> max(l_returnflag) AS conflict FROM lineitem GROUP BY 1, 2")
def k6(spark, d):
    return intake.deduplicated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"], "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "conflict")


UUID_SQL = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


@query("K7_inbox_dedupe", f"""
WITH m AS (SELECT event_type, event_id, CASE WHEN user_id % 3 = 2 THEN md5('user ' || user_id) ELSE md5(user_id::VARCHAR) END AS h FROM events)
SELECT event_type AS consumer, {UUID_SQL.format('h')} AS event_uuid, min(event_id) AS first, count(*) - 1 AS duplicates FROM m GROUP BY 1, 2""")
def k7(spark, d):
    """Ids are dashed UUIDs in capitals, bare hex digits, or text that is mapped through MD5."""
    h = F.md5(F.col("user_id").cast("string"))
    dashed = F.upper(F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    ident = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("{"), dashed, F.lit("}"))).when(F.col("user_id") % 3 == 1, h).otherwise(F.concat(F.lit("user "), "user_id"))
    return ledger.inbox(table(spark, d, "events"), "event_type", ident, "event_id")


@query("K8_poison_branch", f"""
WITH {E}, m AS (SELECT user_id AS topic, event_id, i - 1 AS log_offset, event_type <> 'error' AS ok, k < 80 AS handled FROM e), s AS (SELECT topic, min(log_offset) FILTER (NOT ok AND NOT handled) AS stop FROM m GROUP BY 1),
o AS (SELECT m.*, CASE WHEN log_offset = stop THEN 'raised' WHEN log_offset > stop THEN 'unread' WHEN NOT ok THEN 'dead_letter' ELSE 'processed' END AS outcome FROM m JOIN s USING (topic))
SELECT topic, event_id, outcome, coalesce(max(log_offset) FILTER (outcome = 'processed') OVER (PARTITION BY topic) + 1, 0)::BIGINT AS committed FROM o""")
def k8(spark, d):
    """A topic for each user: errors are poison, and most of them are taken by the handler."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    m = _events(spark, d).select(F.col("user_id").alias("topic"), "event_id", "event_type", "k", (F.row_number().over(w) - 1).cast("long").alias("log_offset"))
    return ledger.consumed(m, "topic", "log_offset", F.col("event_type") != "error", F.col("k") < 80).select("topic", "event_id", "outcome", "committed")


NOW = "epoch_us(TIMESTAMP '2024-02-15')"
OUTBOX = f"o AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS created_us, CASE WHEN k < 40 THEN epoch_us(ts) + 3600000000 END AS published_us, k % 4 AS attempts, CASE k % 5 WHEN 0 THEN {NOW} + 30000000 WHEN 1 THEN {NOW} - 10000000 WHEN 2 THEN {NOW} + 172800000000 END AS lease_expires_us FROM (SELECT *, (json_extract(props, '$.k'))::INT AS k FROM events))"
TOPICS = {"signup": "cases.ready.v1", "purchase": "commands.ticket.v1"}


def _outbox(spark, d):
    now = ledger.micros(F.lit("2024-02-15"))
    lease = F.when(F.col("k") % 5 == 0, now + 30_000_000).when(F.col("k") % 5 == 1, now - 10_000_000).when(F.col("k") % 5 == 2, now + 48 * HOUR)
    o = _events(spark, d).select("event_id", "event_type", "user_id", F.col("t").alias("created_us"), F.when(F.col("k") < 40, F.col("t") + HOUR).alias("published_us"), (F.col("k") % 4).alias("attempts"), lease.alias("lease_expires_us"))
    return o, now


CLAIMED = f"c AS (SELECT * FROM o WHERE published_us IS NULL AND (lease_expires_us IS NULL OR lease_expires_us <= {NOW}) ORDER BY created_us, event_id LIMIT 50)"


@query("K9_outbox_relay", f"WITH {OUTBOX}, {CLAIMED} SELECT event_id, attempts + 1 AS attempts, {NOW} + 60000000 AS lease_expires_us, CASE event_type WHEN 'signup' THEN 'cases.ready.v1' WHEN 'purchase' THEN 'commands.ticket.v1' ELSE event_type || '.events' END AS topic, user_id::VARCHAR AS partition_key, event_id || '/' || event_type || '/1' AS headers FROM c")
def k9(spark, d):
    """One relay batch (the feature: the 50 oldest free events): claimed, leased, and addressed."""
    o, now = _outbox(spark, d)
    r = ledger.relayed(ledger.claimed(o, now), "event_type", "user_id", "event_id", F.lit(1), TOPICS)
    return r.select("event_id", "attempts", "lease_expires_us", "topic", "partition_key", F.concat_ws("/", *(r.headers[k] for k in ("event_id", "event_type", "revision"))).alias("headers"))


@query("K9_outbox_after_relay", f"WITH {OUTBOX}, {CLAIMED} SELECT event_type, count(*) FILTER (p IS NULL) AS waiting, count(p) AS published, count(l) AS leased FROM (SELECT o.event_type, CASE WHEN c.event_id IS NOT NULL THEN {NOW} ELSE o.published_us END AS p, CASE WHEN c.event_id IS NULL THEN o.lease_expires_us END AS l FROM o LEFT JOIN c USING (event_id)) GROUP BY 1")
def k9b(spark, d):
    """The outbox once the batch is published."""
    o, now = _outbox(spark, d)
    after = ledger.published(o, ledger.claimed(o, now), now)
    return after.groupBy("event_type").agg(F.count_if(F.col("published_us").isNull()).alias("waiting"), F.count("published_us").alias("published"), F.count("lease_expires_us").alias("leased"))


@query("K10_stuck_leases", f"WITH {OUTBOX} SELECT event_id, coalesce(published_us IS NULL AND lease_expires_us > {NOW} + 600000000, false) AS released, CASE WHEN NOT coalesce(published_us IS NULL AND lease_expires_us > {NOW} + 600000000, false) THEN lease_expires_us END AS lease_expires_us FROM o")
def k10(spark, d):
    o, now = _outbox(spark, d)
    return ledger.reconciled(o, now).select("event_id", "released", "lease_expires_us")


@query("K11_stale_revisions", "SELECT l_orderkey, l_partkey, l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) AS stale FROM lineitem")
def k11(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    top = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top"))
    return li.join(top, "l_orderkey").select("l_orderkey", "l_partkey", (F.col("l_linenumber") < F.col("top")).alias("stale"))


@query("K12_category_anchor", f"""
WITH RECURSIVE {E}, a AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'TICKETED' ELSE 'WAITING_CLARIFICATION' END AS state, k % 10 = 0 AS fixed FROM e),
b(user_id, event_id, i, revision, category, anchored, was) AS (SELECT user_id, event_id, i, 1, event_type, false, state FROM a WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, b.revision + 1, CASE WHEN b.was = 'WAITING_CLARIFICATION' AND NOT e.fixed AND e.value / 50 < 0.75 THEN b.category ELSE e.event_type END,
b.was = 'WAITING_CLARIFICATION' AND e.event_type <> b.category AND NOT e.fixed AND e.value / 50 < 0.75, e.state FROM b JOIN a e {NEXT})
SELECT user_id, event_id, revision, category, anchored FROM b""")
def k12(spark, d):
    """Events of a user as revisions of a case."""
    says = F.when(F.col("k") % 10 == 0, "Maaf, salah lapor").otherwise("keterangan tambahan")
    state = F.when(F.col("k") % 3 == 0, "TICKETED").otherwise("WAITING_CLARIFICATION")
    return ledger.anchored(_events(spark, d), "user_id", ["t", "event_id"], F.col("event_type"), F.col("value") / 50, says, state, "event_id")


STATES = list(ledger.MOVES)
MOVES_SQL = ", ".join(f"'{a}>{b}'" for a, bs in ledger.MOVES.items() for b in bs)


@query("K13_state_machine", f"""
WITH RECURSIVE {E}, a AS (SELECT *, ({STATES})[k % 11 + 1] AS target FROM e),
b(user_id, event_id, i, state, legal) AS (SELECT user_id, event_id, i, CASE WHEN 'ASSEMBLING>' || target IN ({MOVES_SQL}) THEN target ELSE 'ASSEMBLING' END, 'ASSEMBLING>' || target IN ({MOVES_SQL}) FROM a WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, CASE WHEN b.state || '>' || e.target IN ({MOVES_SQL}) THEN e.target ELSE b.state END, b.state || '>' || e.target IN ({MOVES_SQL}) FROM b JOIN a e {NEXT})
SELECT user_id, event_id, state, legal FROM b""")
def k13(spark, d):
    target = F.get(F.array(*map(F.lit, STATES)), F.col("k") % 11)
    return ledger.state_moves(_events(spark, d), "user_id", ["t", "event_id"], target, "event_id")


@query("K14_send_ledger", """
WITH r AS (SELECT user_id, event_id, sha256(event_type) AS h, CASE WHEN value < 10 THEN 'error' WHEN value < 20 THEN 'timeout' WHEN value < 45 THEN 'ok' END AS result FROM events), f AS (SELECT user_id, arg_min(h, event_id) AS h, min(event_id) AS event_id FROM r GROUP BY 1)
SELECT r.user_id, any_value(CASE WHEN x.result IS NULL THEN 'PENDING' WHEN x.result = 'ok' THEN 'SENT' WHEN x.result = 'timeout' THEN 'DELIVERY_UNKNOWN' ELSE 'FAILED' END) AS status, any_value((x.result IS NOT NULL)::INT) AS attempts, count(*) FILTER (r.h = f.h) - 1 AS replays, count(*) FILTER (r.h <> f.h) AS conflicts
FROM r JOIN f USING (user_id) JOIN r x ON x.event_id = f.event_id GROUP BY 1""")
def k14(spark, d):
    """Each user's events as send requests of one idempotency key."""
    result = F.when(F.col("value") < 10, "error").when(F.col("value") < 20, "timeout").when(F.col("value") < 45, "ok")
    return ledger.sends(table(spark, d, "events"), "user_id", F.col("event_type"), result, F.col("event_id"))


@query("K15_ticket_store", f"""
WITH RECURSIVE {E}, a AS (SELECT *, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'close' WHEN 'purchase' THEN 'transfer' ELSE 'update' END AS action, CASE WHEN k > 97 THEN 1 END AS expected FROM e),
b(user_id, i, revision, status, custody) AS (SELECT user_id, i, (action = 'create')::INT, CASE WHEN action = 'create' THEN 'OPEN' ELSE 'NONE' END, 0 FROM a WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN (e.action = 'create' AND b.status = 'NONE') OR (e.action <> 'create' AND b.status = 'OPEN' AND coalesce(e.expected = b.revision, true)) THEN b.revision + 1 ELSE b.revision END,
CASE WHEN e.action = 'create' AND b.status = 'NONE' THEN 'OPEN' WHEN e.action = 'close' AND b.status = 'OPEN' AND coalesce(e.expected = b.revision, true) THEN 'CLOSED' ELSE b.status END,
CASE WHEN e.action = 'transfer' AND b.status = 'OPEN' AND coalesce(e.expected = b.revision, true) THEN b.custody + 1 ELSE b.custody END FROM b JOIN a e {NEXT})
SELECT user_id, revision, status, custody FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def k15(spark, d):
    """Tickets of users folded from their ordered events as commands."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "error", "close").when(kind == "purchase", "transfer").otherwise("update")
    return ledger.tickets(_events(spark, d), "user_id", ["t", "event_id"], action, F.when(F.col("k") > 97, 1))


@query("K16_circuit_breaker", f"""
WITH RECURSIVE {E}, a AS (SELECT *, event_type <> 'error' AS ok FROM e),
b(user_id, event_id, i, fails, opened, state) AS (SELECT user_id, event_id, i, (NOT ok)::INT, NULL::BIGINT, 'CLOSED' FROM a WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t < b.opened + 21600000000 THEN b.fails WHEN e.ok THEN 0 ELSE b.fails + 1 END,
CASE WHEN e.t < b.opened + 21600000000 THEN b.opened WHEN e.ok THEN NULL WHEN b.opened IS NOT NULL OR b.fails + 1 >= 2 THEN e.t END,
CASE WHEN e.t < b.opened + 21600000000 THEN 'OPEN' WHEN b.opened IS NOT NULL THEN 'HALF_OPEN' ELSE 'CLOSED' END FROM b JOIN a e {NEXT})
SELECT user_id, event_id, state FROM b""")
def k16(spark, d):
    """Breaker state at every call of a user's events, failures being error events."""
    return ledger.breaker(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error", failures=2, wait=6 * 3600)


@query("K17_dead_letters", """
WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n, l_returnflag = 'N' AS ok, l_quantity > 40 AS applied, 'Timeout' || l_linestatus AS error FROM lineitem),
f AS (SELECT l_orderkey, min(n) FILTER (ok OR applied) AS hit, least(count(*), 3) AS tried FROM a WHERE n <= 3 GROUP BY 1)
SELECT f.l_orderkey, CASE WHEN hit IS NULL THEN CASE WHEN tried = 3 THEN 'MAX_RETRIES_EXCEEDED' ELSE 'PENDING' END WHEN ok THEN 'RECEIVED' ELSE 'RECONCILED' END AS outcome, coalesce(hit, tried)::INT AS attempts, CASE WHEN hit IS NULL THEN error END AS error FROM f JOIN a ON a.l_orderkey = f.l_orderkey AND a.n = coalesce(hit, tried)""")
def k17(spark, d):
    """The lines of an order as attempts of one call; MAX_RETRIES_EXCEEDED rows are the dead letters."""
    li = table(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    return ledger.retried(li, "l_orderkey", order, F.col("l_returnflag") == "N", F.col("l_quantity") > 40, F.concat(F.lit("Timeout"), "l_linestatus"))


WANTED = ["signup", "view", "click", "purchase", "error"]
ASK = "(CASE WHEN len(list_filter({w}, lambda x: NOT list_contains({r}, x) AND NOT list_contains({a}, x))) > 0 THEN list_filter({w}, lambda x: NOT list_contains({r}, x) AND NOT list_contains({a}, x)) ELSE list_filter({w}, lambda x: NOT list_contains({r}, x)) END)[1:2]"
RESOLVED = "CASE WHEN e.k % 2 = 0 THEN list_sort(list_distinct(list_append(b.resolved, e.event_type))) ELSE b.resolved END"


@query("K18_session_rounds", f"""
WITH RECURSIVE {E}, b(user_id, i, til, round, asked, resolved, status) AS (SELECT user_id, i, t + 259200000000, 1, ['signup', 'view'], []::VARCHAR[], 'WAITING_REPLY' FROM e WHERE i = 1 UNION ALL
SELECT user_id, i, til, CASE WHEN status = 'WAITING_REPLY' AND now_status = 'WAITING_REPLY' THEN round + 1 ELSE round END,
CASE WHEN status = 'WAITING_REPLY' AND now_status = 'WAITING_REPLY' THEN list_concat(asked, {ASK.format(w=WANTED, r='now_resolved', a='asked')}) ELSE asked END, CASE WHEN status = 'WAITING_REPLY' AND now_status <> 'UNRESOLVED_EXPIRED' THEN now_resolved ELSE resolved END, CASE WHEN status = 'WAITING_REPLY' THEN now_status ELSE status END
FROM (SELECT e.user_id, e.i, b.til, b.round, b.asked, b.resolved, b.status, {RESOLVED} AS now_resolved,
CASE WHEN e.t > b.til THEN 'UNRESOLVED_EXPIRED' WHEN len({RESOLVED}) = 5 THEN 'RESOLVED' WHEN b.round >= 3 THEN 'UNRESOLVED_LIMIT' ELSE 'WAITING_REPLY' END AS now_status FROM b JOIN e {NEXT}))
SELECT user_id, status, round, array_to_string(asked, ',') AS asked, array_to_string(resolved, ',') AS resolved FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def k18(spark, d):
    """A session for each user; every other reply resolves the field named by its type."""
    resolves = F.when(F.col("k") % 2 == 0, F.col("event_type"))
    return ledger.sessions(_events(spark, d), "user_id", ["t", "event_id"], F.col("t"), resolves, WANTED)


@query("K19_append_only", "SELECT event_id, CASE WHEN k = 7 THEN 'DELETED' ELSE 'UPDATED' END AS violation FROM (SELECT event_id, event_type, (json_extract(props, '$.k'))::INT AS k FROM events) WHERE k = 7 OR (k = 8 AND event_type <> 'view')")
def k19(spark, d):
    """Two versions of a log, of which the later lost some rows and changed others."""
    e = _events(spark, d).select("event_id", "event_type", "k")
    after = e.where("k <> 7").select("event_id", F.when(F.col("k") == 8, "view").otherwise(F.col("event_type")).alias("event_type"), "k")
    after = after.union(e.select(-F.col("event_id") - 1, "event_type", "k"))
    return ledger.appended_only(e, after, ["event_id"])


@query("L3_enforce_append_only", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def l3(spark, d):
    """A log that only grew passes the guard, which raises for any other."""
    e = table(spark, d, "events").select("event_id", "event_type")
    after = e.union(e.select(-F.col("event_id") - 1, "event_type"))
    return ledger.enforce_append_only(e, after, ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("K21_bank_upsert", "SELECT user_id, max(event_id) AS latest, arg_max(event_type, event_id) AS category, max(event_id) FILTER (event_type = 'purchase') AS ticket_id, arg_min(event_type = 'purchase', event_id) AS is_active FROM events GROUP BY 1")
def k21(spark, d):
    """Upserts of a user's case: what is new replaces, the ticket stays where the new one is null, the insert's mark stays."""
    bought = F.col("event_type") == "purchase"
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("latest"), F.col("event_type").alias("category"), F.when(bought, F.col("event_id")).alias("ticket_id"), bought.alias("is_active"))
    return ledger.upserted(e, "user_id", F.col("event_id"), ["latest", "category"], ["ticket_id"], ["is_active"])


@query("K22_gateway_audit", """
WITH c AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'ticket' WHEN 'view' THEN 'message' WHEN 'click' THEN 'escalation' END AS kind, value, user_id || ':' || coalesce(CASE event_type WHEN 'purchase' THEN 'ticket' WHEN 'view' THEN 'message' WHEN 'click' THEN 'escalation' END, 'none') AS key, sha256((value > 25)::VARCHAR) AS h FROM events), f AS (SELECT key, arg_min(h, event_id) AS first FROM c GROUP BY 1)
SELECT event_id, CASE kind WHEN 'ticket' THEN CASE WHEN value > 25 THEN 'ticket.executed.v1' ELSE 'ticket.policy_denied.v1' END WHEN 'message' THEN 'message.executed.v1' ELSE 'model.escalation.executed.v1' END AS audit, CASE WHEN kind = 'ticket' THEN CASE WHEN value > 25 THEN 'TICKETED' ELSE 'BLOCKED' END END AS state,
CASE kind WHEN 'ticket' THEN CASE WHEN value > 25 THEN 'executed' ELSE 'policy_denied' END WHEN 'message' THEN CASE WHEN value < 5 THEN 'DELIVERY_UNKNOWN' ELSE 'SENT' END ELSE CASE WHEN value < 10 THEN 'UNAVAILABLE' WHEN value > 25 THEN 'APPROVED' ELSE 'DENIED' END END AS outcome, CASE WHEN h = first THEN key ELSE key || ':' || substr(h, 1, 8) END AS effective_key FROM c JOIN f USING (key) WHERE kind IS NOT NULL""")
def k22(spark, d):
    """Commands of three kinds through the gateway, each with its audit row, state and idempotency key."""
    kind = F.when(F.col("event_type") == "purchase", "ticket").when(F.col("event_type") == "view", "message").when(F.col("event_type") == "click", "escalation")
    c = table(spark, d, "events").select("event_id", "user_id", kind.alias("kind"), "value")
    c = ledger.distinct_keys(c, F.concat_ws(":", "user_id", F.coalesce("kind", F.lit("none"))), F.col("value") > 25, F.col("event_id"))
    h = ledger.handled(c, "kind", F.col("value") > 25, F.when(F.col("value") < 5, "DELIVERY_UNKNOWN").otherwise("SENT"), F.when(F.col("value") >= 10, "local"))
    return h.select("event_id", "audit", "state", "outcome", "effective_key")


@query("K23_result_scatter", "SELECT d.doc_id, CASE WHEN (d.doc_id // 5) % 7 = 0 OR NOT bool_or(l.doc_id IS NOT NULL) OVER (PARTITION BY d.doc_id // 5) THEN NULL WHEN l.doc_id IS NULL THEN 'KLARIFIKASI: Evaluasi batch otomatis' ELSE CASE quality WHEN 1 THEN 'EKSEKUSI' ELSE 'TOLAK' END || ': toxic ' || toxic END AS content FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def k23(spark, d):
    """Chunks of five documents and a model's JSON array for each, which leaves some out; every seventh chunk's is no JSON."""
    chunk = F.floor(F.col("doc_id") / 5)
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    cell = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, " eksekusi").otherwise("Tolak").alias("decision"), F.concat(F.lit("toxic "), "toxic").alias("reasoning"))
    raw = labels.join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy(chunk.alias("chunk")).agg(F.to_json(F.collect_list(cell)).alias("j"))
    raw = raw.select("chunk", F.when(F.col("chunk") % 7 == 0, "no answer").otherwise(F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```"))).alias("raw"))
    items = table(spark, d, "documents").select("doc_id", chunk.alias("chunk"))
    return ledger.scattered(items, raw, "chunk", "doc_id", "raw").select("doc_id", "content")
