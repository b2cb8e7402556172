"""Replayable forms of the stateful parts: outbox, inbox, revisions, tickets, breakers, sends, sessions, the knowledge bank.

Where what a row leads to depends on all rows before it, the rows of a key stream
through an ordered fold of constant state (``keyed.folded``); all else is partial
aggregation and equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import folded

# Topics of event types.
TOPICS = {"message.received.v1": "intake.messages.v1", "case.ready.v1": "cases.ready.v1", "ticket.create.requested": "commands.ticket.v1", "whatsapp.send.requested.v1": "commands.message.v1", "model.escalation.requested.v1": "commands.escalation.v1", "ticket.status.updated.v1": "tickets.status.v1", "failure.quarantined.v1": "failures.dlq.v1"}
# Words that correct an earlier category.
CORRECTIONS = ["bukan", "salah lapor", "ralat aduan", "keliru"]
#: The states of a case, and where each may go.
MOVES = {
    "ASSEMBLING": ["READY"],
    "READY": ["ANALYZING"],
    "ANALYZING": ["WAITING_RESULTS", "WAITING_CLARIFICATION", "EXECUTING", "REJECTED", "WAITING_DEPENDENCY", "BLOCKED", "UNRESOLVED"],
    "WAITING_RESULTS": ["WAITING_CLARIFICATION", "EXECUTING", "REJECTED", "WAITING_DEPENDENCY", "BLOCKED", "UNRESOLVED"],
    "WAITING_CLARIFICATION": ["READY", "UNRESOLVED"],
    "EXECUTING": ["TICKETED", "BLOCKED", "WAITING_DEPENDENCY"],
    "WAITING_DEPENDENCY": ["EXECUTING", "BLOCKED", "UNRESOLVED"],
    "TICKETED": ["READY"],
    "REJECTED": ["READY"],
    "BLOCKED": ["READY"],
    "UNRESOLVED": ["READY"],
}


def micros(at: str | Column) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def topic(kind: Column, topics: dict[str, str] = TOPICS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in topics.items() for x in kv)), kind), F.concat(kind, F.lit(".events")))


# Outbox and inbox.


def claimed(outbox: DataFrame, now: Column, lease: int = 60, batch: int = 50, created: str = "created_us", ident: str = "event_id", published: str = "published_us", expires: str = "lease_expires_us", attempts: str = "attempts") -> DataFrame:
    """The ``batch`` oldest rows that are unpublished and free of a lease, with attempts + 1 and a new lease; times in microseconds."""
    free = F.col(published).isNull() & (F.col(expires).isNull() | (F.col(expires) <= now))
    return outbox.where(free).orderBy(created, ident).limit(batch).withColumn(attempts, F.col(attempts) + 1).withColumn(expires, now + lease * 1_000_000)


def relayed(rows: DataFrame, kind: str, key: str, ident: str, revision: Column, topics: dict[str, str] = TOPICS) -> DataFrame:
    """Add topic, partition_key and headers, as a broker takes them."""
    headers = F.create_map(F.lit("event_id"), F.col(ident).cast("string"), F.lit("event_type"), F.col(kind), F.lit("revision"), revision.cast("string"))
    return rows.withColumn("topic", topic(F.col(kind), topics)).withColumn("partition_key", F.col(key).cast("string")).withColumn("headers", headers)


def published(outbox: DataFrame, done: DataFrame, now: Column, ident: str = "event_id", at: str = "published_us", expires: str = "lease_expires_us") -> DataFrame:
    """The outbox with the rows named in ``done`` marked as published and free of a lease."""
    hit = done.select(F.col(ident).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    both = outbox.join(hit, F.col(ident) == F.col("_id"), "left")
    marked = F.col("_hit").isNotNull()
    return both.withColumn(at, F.when(marked & F.col(at).isNull(), now).otherwise(F.col(at))).withColumn(expires, F.when(~marked, F.col(expires))).drop("_id", "_hit")


def reconciled(outbox: DataFrame, now: Column, lease: int = 60, times: int = 10, published: str = "published_us", expires: str = "lease_expires_us") -> DataFrame:
    """Release unpublished rows whose lease ends more than ``times`` leases from now; adds ``released``."""
    if lease * times <= 0:
        raise ValueError("the longest lease must be positive")
    stuck = F.coalesce(F.col(published).isNull() & (F.col(expires) > now + lease * times * 1_000_000), F.lit(False))
    return outbox.withColumn("released", stuck).withColumn(expires, F.when(~stuck, F.col(expires)))


def event_uuid(ident: Column) -> Column:
    """The id as a UUID: its own 32 hex digits where it is one (with or without dashes, braces, urn), else those of its MD5."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(ident, "(?i)^urn:uuid:", ""), r"^\{|\}$|-", ""))
    h = F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.md5(ident))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def inbox(events: DataFrame, consumer: str, ident: Column, order: str) -> DataFrame:
    """(consumer, event_uuid, first, duplicates): each event of a consumer once, the first delivery counts."""
    by = events.groupBy(F.col(consumer).alias("consumer"), event_uuid(ident).alias("event_uuid"))
    return by.agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def consumed(messages: DataFrame, topic: str, offset: str, ok: Column, handled: Column) -> DataFrame:
    """Add outcome and committed: messages of a topic in offset order.

    A failure that ``handled`` takes goes to the dead letters and the next is read; any
    other stops the topic, so it and all later messages stay unread.  ``committed`` is
    the offset from which the topic goes on: after the last message processed.
    """
    good, dead = F.coalesce(ok, F.lit(False)), F.coalesce(handled, F.lit(False))
    marked = messages.withColumn("_good", good).withColumn("_dead", ~good & dead)
    stop = marked.groupBy(F.col(topic).alias("_topic")).agg(F.min(F.when(~F.col("_good") & ~F.col("_dead"), F.col(offset))).alias("_stop"))
    read = F.col("_stop").isNull() | (F.col(offset) < F.col("_stop"))
    both = marked.join(stop, F.col(topic).eqNullSafe(F.col("_topic")))
    outcome = F.when(~read, F.when(F.col(offset) == F.col("_stop"), "raised").otherwise("unread")).when(F.col("_dead"), "dead_letter").otherwise("processed")
    both = both.withColumn("outcome", outcome)
    last = both.where("outcome = 'processed'").groupBy(F.col("_topic").alias("_t")).agg((F.max(offset) + 1).alias("committed"))
    out = both.join(last, F.col("_topic").eqNullSafe(F.col("_t")), "left").withColumn("committed", F.coalesce("committed", F.lit(0).cast("long")))
    return out.drop("_good", "_dead", "_topic", "_stop", "_t")


def appended_only(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, violation): rows of ``before`` that ``after`` rewrote (UPDATED) or lacks (DELETED)."""
    rest = [c for c in before.columns if c not in key]
    mark = lambda t, name: t.groupBy(*key).agg(F.sort_array(F.collect_list(F.xxhash64(*rest))).alias(name))
    both = mark(before, "_was").join(mark(after, "_is"), key, "left")
    violation = F.when(F.col("_is").isNull(), "DELETED").when(F.size(F.array_except("_was", "_is")) > 0, "UPDATED")
    return both.select(*key, violation.alias("violation")).where("violation IS NOT NULL")


def enforce_append_only(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``after``, or an error if a row of ``before`` was rewritten or removed."""
    broken = appended_only(before, after, key).limit(1).collect()
    if broken:
        raise ValueError(f"append-only table: {broken[0].asDict()}")
    return after


# Revisions and states.


def current_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key, by partial aggregation."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def anchored(revisions: DataFrame, key: str, order: list[str], category: Column, confidence: Column, text: Column, state: Column, ident: str, sure: float = 0.75, corrections: list[str] = CORRECTIONS) -> DataFrame:
    """(key, ident, revision, category, anchored): the category of each revision of a case.

    A revision after the first keeps the category stored before it if the case was
    waiting for clarification (``state`` is that in which the revision before left it),
    the text has no word of correction and the model is less than ``sure``.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    corrects = F.lit(False)
    for w in corrections:
        corrects = corrects | low.contains(w)

    def step(s, row):
        n, stored, was = s
        ident_, new, score, fixed, after = row
        keep = n >= 1 and was == "WAITING_CLARIFICATION" and stored is not None and new != stored and not fixed and not (score is not None and score >= sure)
        chosen = stored if keep else new
        return (n + 1, chosen, after), [(ident_, n + 1, chosen, keep)]

    kind = revisions.schema[ident].dataType.simpleString()
    return folded(revisions, [key], [F.col(o) for o in order], [F.col(ident), category, confidence.cast("double"), corrects, state], lambda: (0, None, None), step, f"{ident} {kind}, revision int, category string, anchored boolean")


def state_moves(events: DataFrame, key: str, order: list[str], target: Column, ident: str, first: str = "ASSEMBLING", moves: dict[str, list[str]] = MOVES) -> DataFrame:
    """(key, ident, state, legal): the state of a case after each event; an illegal move changes nothing."""
    allowed = {(a, b) for a, bs in moves.items() for b in bs}

    def step(state, row):
        ident_, to = row
        legal = (state, to) in allowed
        state = to if legal else state
        return state, [(ident_, state, legal)]

    kind = events.schema[ident].dataType.simpleString()
    return folded(events, [key], [F.col(o) for o in order], [F.col(ident), target], lambda: first, step, f"{ident} {kind}, state string, legal boolean")


def generations(events: DataFrame, key: str, order: list[str], kind: Column, at: Column, ident: str, lease: int) -> DataFrame:
    """(key, ident, generation, outcome): timers with leases and fencing.

    ``ingest`` opens a new generation after a firing or during a lease; ``claim`` takes a
    lease of ``lease`` seconds and a new generation, unless nothing is due (idle) or the lease of
    another holds (busy); ``finalize`` fires only if the claim's generation is still the present
    one, else it is a conflict.
    """
    span = lease * 1_000_000

    def step(s, row):
        generation, fired, token, until = s
        ident_, what, t = row
        if what == "ingest":
            if fired:
                generation, fired, token, until = generation + 1, False, -1, -1
            elif token >= 0:
                generation += 1
            outcome = "ingested"
        elif what == "claim":
            if fired:
                outcome = "idle"
            elif token >= 0 and until > t:
                outcome = "busy"
            else:
                generation += 1
                token, until, outcome = generation, t + span, "claimed"
        elif not fired and token >= 0 and token == generation:
            fired, token, until, outcome = True, -1, -1, "fired"
        else:
            outcome = "conflict"
        return (generation, fired, token, until), [(ident_, generation, outcome)]

    kind_ = events.schema[ident].dataType.simpleString()
    return folded(events, [key], [F.col(o) for o in order], [F.col(ident), kind, at], lambda: (0, True, -1, -1), step, f"{ident} {kind_}, generation int, outcome string")


def association(messages: DataFrame, key: str, at: str, ident: str, quoted: Column, case_key: Column, closed: Column, horizon: int) -> DataFrame:
    """(key, ident, case_no): the case of each message of a conversation.

    First the case of the quoted message, then that of the same explicit key (a
    new one for a new key), then the newest open case within ``horizon``
    seconds, else a new case, named by its first message.  The state of the fold is the
    conversation's map of message and key to case.
    """
    span = horizon * 1_000_000

    def step(s, row):
        by_id, by_label, last = s
        t, id_, quote, label, shut = row
        case = by_id.get(quote) if quote is not None else None
        if case is None and label is not None:
            case = by_label.get(label, id_)
        elif case is None and last is not None and last[0] >= t - span:
            case = last[1]
        case = id_ if case is None else case
        by_id[id_] = case
        if label is not None:
            by_label[label] = case
        return (by_id, by_label, last if shut else (t, case)), [(id_, case)]

    kind = messages.schema[ident].dataType.simpleString()
    return folded(messages, [key], [micros(at), F.col(ident)], [micros(at), F.col(ident), quoted.cast(kind), case_key.cast("string"), closed], lambda: ({}, {}, None), step, f"{ident} {kind}, case_no {kind}")


def breaker(calls: DataFrame, key: str, at: str, ident: str, ok: Column, failures: int = 5, wait: int = 30) -> DataFrame:
    """(key, ident, state): CLOSED, OPEN (call refused) or HALF_OPEN (one probe) at each call of a dependency, in order."""
    span = wait * 1_000_000

    def step(s, row):
        fails, opened = s
        t, id_, good = row
        if opened is not None and t < opened + span:
            return s, [(id_, "OPEN")]
        probe = opened is not None
        if good:
            fails, opened = 0, None
        else:
            fails += 1
            opened = t if probe or fails >= failures else None
        return (fails, opened), [(id_, "HALF_OPEN" if probe else "CLOSED")]

    kind = calls.schema[ident].dataType.simpleString()
    return folded(calls, [key], [micros(at), F.col(ident)], [micros(at), F.col(ident), ok], lambda: (0, None), step, f"{ident} {kind}, state string")


def tickets(commands: DataFrame, key: str, order: list[str], action: Column, expected: Column) -> DataFrame:
    """(key, revision, status, custody): the fold of ordered create / update / transfer / close commands.

    A command other than create needs an open ticket and, where it names a
    revision, the present one; otherwise it changes nothing.  ``custody`` counts hand-overs.
    """

    def step(s, row):
        revision, status, custody = s
        what, wanted = row
        if what == "create":
            return ((revision + 1, "OPEN", custody) if status == "NONE" else s), []
        if status != "OPEN" or (wanted is not None and wanted != revision):
            return s, []
        return (revision + 1, "CLOSED" if what == "close" else status, custody + (what == "transfer")), []

    return folded(commands, [key], [F.col(o) for o in order], [action, expected.cast("int")], lambda: (0, "NONE", 0), step, "revision int, status string, custody int", finish=lambda s: [s])


# Sends, retries, sessions.


def sends(requests: DataFrame, key: str, payload: Column, result: Column, order: Column) -> DataFrame:
    """(key, status, attempts, replays, conflicts): the ledger after all requests of each idempotency key.

    Only the first request of a key is sent: ``result`` is ok, timeout or error (null: still
    PENDING).  A timeout leaves the outcome unknown, which is no failure and is not sent again.  Later
    requests are replays, or conflicts where their payload differs.
    """
    marked = requests.select(F.col(key).alias(key), F.sha2(payload.cast("string"), 256).alias("_hash"), result.alias("_result"), order.alias("_order"))
    by = marked.groupBy(key, "_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"), F.min_by("_result", "_order").alias("_result"))
    whole = by.groupBy(key).agg(F.sum("_n").alias("_all"), F.min_by(F.struct("_n", "_result"), "_first").alias("_f"))
    status = F.when(F.col("_f._result").isNull(), "PENDING").when(F.col("_f._result") == "ok", "SENT").when(F.col("_f._result") == "timeout", "DELIVERY_UNKNOWN").otherwise("FAILED")
    return whole.select(key, status.alias("status"), F.when(F.col("_f._result").isNull(), 0).otherwise(1).alias("attempts"), (F.col("_f._n") - 1).alias("replays"), (F.col("_all") - F.col("_f._n")).alias("conflicts"))


def sent_once(rows: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """The first send of each idempotency key, with conflict: a later payload differs."""
    rest = [c for c in rows.columns if c != key]
    by = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_s"), (F.min(payload) != F.max(payload)).alias("conflict"))
    return by.select(key, "_s.*", "conflict")


def retried(attempts: DataFrame, key: str, order: list[Column], ok: Column, applied: Column, error: Column, most: int = 3) -> DataFrame:
    """(key, outcome, attempts, error): calls with up to ``most`` attempts.

    After a failure the store is asked whether the call was applied all the same
    (``applied``), which counts as done.  RECEIVED, RECONCILED, PENDING (attempts left) or
    MAX_RETRIES_EXCEEDED, which is a dead letter with the last error.
    """

    def step(s, row):
        n, outcome, why = s
        good, found, error_ = row
        if outcome or n >= most:
            return s, []
        return (n + 1, "RECEIVED" if good else "RECONCILED" if found else None, None if good or found else error_), []

    def finish(s):
        n, outcome, why = s
        return [(outcome or ("MAX_RETRIES_EXCEEDED" if n >= most else "PENDING"), n, why)]

    return folded(attempts, [key], order, [ok, applied, error], lambda: (0, None, None), step, "outcome string, attempts int, error string", finish)


def sessions(replies: DataFrame, key: str, order: list[str], at: Column, resolves: Column, missing: list[str], rounds: int = 3, questions: int = 2, expiry: int = 72 * 3600) -> DataFrame:
    """(key, status, round, asked, resolved): clarification sessions after all replies; a key's first row opens its session.

    A round asks the first ``questions`` missing fields that are neither resolved nor
    asked (all unresolved ones again if none is left).  A reply after ``expiry`` seconds ends the session
    UNRESOLVED_EXPIRED; nothing missing ends it RESOLVED, the last round UNRESOLVED_LIMIT.
    """
    span = expiry * 1_000_000

    def ask(resolved, asked):
        fresh = [f for f in missing if f not in resolved and f not in asked][:questions]
        return fresh or [f for f in missing if f not in resolved][:questions]

    def step(s, row):
        t, field = row
        if s is None:
            first = ask((), ())
            return (t + span, 1, tuple(first), (), "WAITING_REPLY" if first else "RESOLVED"), []
        until, n, asked, resolved, status = s
        if status != "WAITING_REPLY":
            return s, []
        if t > until:
            return (until, n, asked, resolved, "UNRESOLVED_EXPIRED"), []
        resolved = tuple(sorted({*resolved, field})) if field is not None else resolved
        if all(f in resolved for f in missing):
            return (until, n, asked, resolved, "RESOLVED"), []
        if n >= rounds:
            return (until, n, asked, resolved, "UNRESOLVED_LIMIT"), []
        return (until, n + 1, (*asked, *ask(resolved, asked)), resolved, status), []

    return folded(replies, [key], [F.col(o) for o in order], [at, resolves], lambda: None, step, "status string, round int, asked string, resolved string", finish=lambda s: [(s[4], s[1], ",".join(s[2]), ",".join(s[3]))])


def round_questions(missing: Column, resolved: Column, asked: Column, most: int = 2) -> Column:
    """Up to ``most`` missing fields (lower case, once each, in order) that are neither resolved nor asked; if none, those not resolved."""
    norm = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    wanted = F.array_distinct(norm(missing))
    fresh = F.array_except(wanted, F.array_union(norm(resolved), norm(asked)))
    return F.slice(F.when(F.size(fresh) > 0, fresh).otherwise(F.array_except(wanted, norm(resolved))), 1, most)


# Knowledge bank and gateway.


def upserted(rows: DataFrame, key: str, order: Column, latest: list[str], kept: list[str], first: list[str]) -> DataFrame:
    """One row for each key after upserts in order: ``latest`` columns of the last, ``kept`` of the last that is not null, ``first`` of the insert."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*latest), order).alias("_l"), *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in kept), F.min_by(F.struct(*first), order).alias("_f")).select(key, "_l.*", *kept, "_f.*")


def handled(commands: DataFrame, kind: str, allowed: Column, status: Column, provider: Column) -> DataFrame:
    """Add audit (event type), state (of the case, null: unchanged) and outcome for ticket, message and escalation commands."""
    k = F.col(kind)
    ok = F.coalesce(allowed, F.lit(False))
    audit = F.when(k == "ticket", F.when(ok, "ticket.executed.v1").otherwise("ticket.policy_denied.v1")).when(k == "message", "message.executed.v1").when(k == "escalation", "model.escalation.executed.v1")
    state = F.when(k == "ticket", F.when(ok, "TICKETED").otherwise("BLOCKED"))
    outcome = F.when(k == "ticket", F.when(ok, "executed").otherwise("policy_denied")).when(k == "message", status).when(k == "escalation", F.when(provider.isNull(), "UNAVAILABLE").when(ok, "APPROVED").otherwise("DENIED"))
    return commands.withColumn("audit", audit).withColumn("state", state).withColumn("outcome", outcome).where("audit IS NOT NULL")


def distinct_keys(messages: DataFrame, key: Column, payload: Column, order: Column) -> DataFrame:
    """Add effective_key: the idempotency key, with the payload's hash behind it where an earlier message of the key had another payload."""
    marked = messages.withColumn("_key", key).withColumn("_hash", F.sha2(payload.cast("string"), 256)).withColumn("_order", order)
    first = marked.groupBy(F.col("_key").alias("_k")).agg(F.min_by("_hash", "_order").alias("_first"))
    both = marked.join(first, F.col("_key") == F.col("_k"))
    return both.withColumn("effective_key", F.when(F.col("_hash") == F.col("_first"), F.col("_key")).otherwise(F.concat_ws(":", "_key", F.substring("_hash", 1, 8)))).drop("_key", "_hash", "_order", "_k", "_first")


def scattered(items: DataFrame, outputs: DataFrame, chunk: str, item: str, raw: str, default: str = "KLARIFIKASI: Evaluasi batch otomatis") -> DataFrame:
    """Add content: the result of each item from its chunk's JSON array (within stray text too).

    Items that the array leaves out get ``default``; a chunk without an array gets null, and
    is to be asked item by item.
    """
    array = F.regexp_extract(F.col(raw), r"(?s)(\[.*\])", 1)
    parsed = F.from_json(array, "array<struct<id:string,decision:string,reasoning:string>>")
    got = outputs.select(F.col(chunk).alias("_c"), parsed.alias("_r")).where(F.size("_r") > 0)
    cell = got.select("_c", F.explode("_r").alias("_x"))
    content = F.concat(F.upper(F.trim(F.coalesce("_x.decision", F.lit("KLARIFIKASI")))), F.lit(": "), F.coalesce("_x.reasoning", F.lit("")))
    known = cell.select("_c", F.col("_x.id").alias("_i"), content.alias("_content")).groupBy("_c", "_i").agg(F.min("_content").alias("_content"))
    answered = got.select(F.col("_c").alias("_a")).distinct()
    out = items.join(known, (F.col(chunk) == F.col("_c")) & (F.col(item).cast("string") == F.col("_i")), "left").join(answered, F.col(chunk) == F.col("_a"), "left")
    return out.withColumn("content", F.when(F.col("_a").isNotNull(), F.coalesce("_content", F.lit(default)))).drop("_c", "_i", "_content", "_a")
