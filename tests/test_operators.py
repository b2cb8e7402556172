import json

import pytest
from pyspark.sql import functions as F

from caseloom.operators import datasets, intake, ledger, metrics, retrieval
from caseloom.sources import files, payloads


def bursts(spark, seconds):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(seconds)], "c int, id int, s int").withColumn("at", F.timestamp_seconds("s"))
    return [r.burst for r in intake.bursts(df, ["c"], "at", "id", 5, 20).orderBy("id").collect()]


def test_burst_gap_and_cap(spark):
    assert bursts(spark, [0, 3, 7, 11, 15, 18]) == [0] * 6
    assert bursts(spark, [0, 3, 7, 11, 15, 18, 23, 28]) == [0] * 6 + [1, 1]
    assert bursts(spark, [0, 5, 11]) == [0, 0, 1]


def test_association_by_quote_key_and_horizon(spark):
    day = 86400
    rows = [(1, 0, None, "a", False), (2, 1, None, "b", False), (3, 2, None, "a", False), (4, 3, None, "b", False), (5, 4, 1, None, False), (6, day, None, None, False), (7, 4 * day, None, None, False)]
    df = spark.createDataFrame([("c", *r) for r in rows], "conv string, id long, s long, quoted long, label string, closed boolean").withColumn("at", F.timestamp_seconds("s"))
    got = ledger.association(df, "conv", "at", "id", F.col("quoted"), F.col("label"), F.col("closed"), 48 * 3600)
    assert {r.id: r.case_no for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 1, 7: 7}


def test_duplicate_delivery(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (2, "a", 2), (2, "b", 3)], "id int, body string, at int")
    assert {(r.id, r.at, r.conflict) for r in intake.deduplicated(df, ["id"], ["body"], "at").collect()} == {(1, 0, False), (2, 2, True)}


def test_ticket_fold(spark):
    rows = [(1, "create", None), (2, "create", None), (3, "update", 1), (4, "update", 1), (5, "transfer", None), (6, "close", None), (7, "update", None)]
    df = spark.createDataFrame([("t", *r) for r in rows], "t string, at int, action string, expected int")
    got = ledger.tickets(df, "t", ["at"], F.col("action"), F.col("expected")).first()
    assert (got.revision, got.status, got.custody) == (4, "CLOSED", 1)


def test_breaker(spark):
    calls = [(0, False), (1, False), (2, True), (31, False), (40, True), (70, True), (71, True)]
    df = spark.createDataFrame([("d", i, s, ok) for i, (s, ok) in enumerate(calls)], "d string, id int, s int, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    got = ledger.breaker(df, "d", "at", "id", F.col("ok"), failures=2, wait=30)
    assert [r.state for r in got.orderBy("id").collect()] == ["CLOSED", "CLOSED", "OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED"]


@pytest.mark.parametrize(("k", "want"), [(1, "100"), (2, "101"), (3, "111"), (10, "721"), (20, "1433")])
def test_stratified_split(spark, k, want):
    df = spark.createDataFrame([("c", f"f{i}") for i in range(k)], "category string, family string")
    got = {r.split: r["count"] for r in datasets.stratified_split(df, "category", "family").groupBy("split").count().collect()}
    counts = [got.get(s, 0) for s in ("train", "dev", "test")]
    assert sum(counts) == k and all((c > 0) == (w != "0") for c, w in zip(counts, want[:3], strict=False) if k <= 3)


def test_near_duplicates_equal_brute_force(spark):
    import random

    r = random.Random(1)
    base = [f"w{r.randint(0, 30)}" for _ in range(60)]
    lines = [" ".join(base[:30]), " ".join(base[:30] + ["x"]), " ".join(base), " ".join(["y"] + base), "a b", "a b", " ".join(base[:30])]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    got = {(p.left_id, p.right_id): p.jaccard for p in datasets.near_duplicates(df, "id", "text", 3, 0.8).collect()}
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (x.split() for x in lines)]
    want, first = {}, {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    reps = sorted(i for s, i in first.items() if s)
    for a in reps:
        for b in reps:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8:
                want[a, b] = j
    assert got == pytest.approx(want) and want


def test_macro_f1_counts_absent_modes_as_zero(spark):
    df = spark.createDataFrame([("EXECUTE", "EXECUTE"), ("REJECT_IGNORE", "REJECT_IGNORE")], "g string, p string")
    assert metrics.macro_f1(df, "g", "p", metrics.MODES).first()[0] == 0.5


def test_two_empty_entity_sets_are_perfect(spark):
    none = spark.createDataFrame([], "k int")
    assert metrics.entity_metrics(none, none, ["k"]).first().f1 == 1.0


def test_temperature(spark):
    df = spark.createDataFrame([([4.0, 0.0], 0)] * 3 + [([4.0, 0.0], 1)], "l array<double>, y int")
    assert metrics.temperature(df, "l", "y") == pytest.approx(4 / 1.0986, rel=2e-3)


def test_bm25_prefers_the_matching_document(spark):
    docs = spark.createDataFrame([(1, "jalan rusak berlubang di depan pasar"), (2, "sampah menumpuk"), (3, "jalan ramai"), (4, "lampu mati")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "jalan berlubang")], "item_id long, text string")
    got = retrieval.top_k(retrieval.bm25(docs, q), "item_id", "lexical_score", "doc_id", 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3]
    again = retrieval.rerank(retrieval.bm25(docs, q), docs, q).orderBy(F.desc("combined_score")).first()
    assert again.doc_id == 1 and again.coverage == 1.0


def test_bm25_held_and_joined_agree(spark):
    import random

    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 30))) for i in range(80)] + [(None, "a b"), (90, None), (91, "")], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, text(5)) for i in range(12)] + [(20, "zz"), (21, None)], "item_id int, text string")
    held = {(x.item_id, x.doc_id): x.lexical_score for x in retrieval.bm25(docs, q).collect()}
    joined = {(x.item_id, x.doc_id): x.lexical_score for x in retrieval.bm25(docs, q, held=0).collect()}
    assert held == pytest.approx(joined) and len(held) > 300
    assert retrieval.bm25(docs, q.where("item_id >= 20")).count() == 0 and retrieval.bm25(docs.limit(0), q).count() == 0


def test_containing_small_and_large_lists(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcd"), (2, "bcx"), (3, None), (4, "")], "t long, text string")
    needles = spark.createDataFrame([(1, "bc"), (2, "d"), (3, "zz"), (4, None), (5, "bc"), (6, "")], "n long, needle string")
    small = sorted((r.t, r.n) for r in intake.containing(texts, needles, "text", "needle").collect())
    monkeypatch.setattr(intake, "CONTAINED_BYTES", 0)
    assert small == sorted((r.t, r.n) for r in intake.containing(texts, needles, "text", "needle").collect()) == [(1, 1), (1, 2), (1, 5), (1, 6), (2, 1), (2, 5), (2, 6), (4, 6)]


def test_greedy_pass_over_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 502), (501, 502)], "left_id long, right_id long")
    ids = spark.createDataFrame([(i,) for i in [*range(201), 300, 500, 501, 502]], "id long")
    got = {r.id for r in datasets.greedy_kept(pairs, ids, "id").collect()}
    assert got == {*range(0, 201, 2), 300, 500}


def test_duplicate_lines_equal_the_plain_pass(spark):
    import random

    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") * 2 for _ in range(12)) for _ in range(6)]
    lines = [r.choice(base) + r.choice(["", " x", " x", " y z"]) for _ in range(60)] + ["a b", "a b", " ", "Aa bb", None]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, text string")
    got = {x.i for x in datasets.deduplicated_lines(df, "i", "text").collect()}
    kept, want = [], set()
    for i, line in enumerate(lines):
        w = (line or "").strip().lower().split()
        grams = set(zip(w, w[1:], w[2:], strict=False))
        if w and (len(w) < 3 or all(len(grams & g) / len(grams | g) < 0.85 for g in kept)):
            want.add(i)
            if len(w) >= 3:
                kept.append(grams)
    assert got == want


def test_synthesis_tops_up(spark):
    topics = spark.createDataFrame([("lampu",), ("jalan",)], "topic string")
    got = datasets.synthesized(topics, {"a": "warga lapor {x} rusak", "b": "x {x}"}, "topic", 10, F.format_string("tambahan nomor %d pada daftar %d", "i", F.col("i") * 31)).collect()
    assert len(got) >= 10 and {"warga lapor lampu rusak", "warga lapor jalan rusak"} <= {r.text for r in got}
    assert not any(len(r.text) <= 10 for r in got)


def test_sends_and_conflicting_keys(spark):
    rows = [("a", "x", None, 1), ("b", "x", "ok", 1), ("b", "x", "error", 2), ("b", "y", "error", 3), ("c", "z", "timeout", 1), ("d", "z", "boom", 1)]
    df = spark.createDataFrame(rows, "k string, p string, r string, t int")
    got = {x.k: tuple(x)[1:] for x in ledger.sends(df, "k", F.col("p"), F.col("r"), F.col("t")).collect()}
    assert got == {"a": ("PENDING", 0, 0, 0), "b": ("SENT", 1, 1, 1), "c": ("DELIVERY_UNKNOWN", 1, 0, 0), "d": ("FAILED", 1, 0, 0)}
    keys = ledger.distinct_keys(df, F.col("k"), F.col("p"), F.col("t"))
    assert sum(":" in x.effective_key for x in keys.collect()) == 1


def test_append_only_guard(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    assert {tuple(r) for r in ledger.appended_only(before, after, ["id"]).collect()} == {(2, "UPDATED"), (3, "DELETED")}
    with pytest.raises(ValueError, match="append-only"):
        ledger.enforce_append_only(before, after, ["id"])
    assert ledger.enforce_append_only(before, before.union(after.where("id = 4")), ["id"]).count() == 4


def test_event_ids_as_uuids(spark):
    h = "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([(h,), ("{01234567-89AB-CDEF-0123-456789ABCDEF}",), ("urn:uuid:" + h,), ("event 7",)], "i string")
    got = [r.u for r in df.select(ledger.event_uuid(F.col("i")).alias("u")).collect()]
    assert set(got[:3]) == {"01234567-89ab-cdef-0123-456789abcdef"} and got[3] != got[0] and len(got[3]) == 36


def test_no_tenant_sees_no_row(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "tenant_id string, n int")
    assert intake.of_tenant(df, "a").count() == 1 and intake.of_tenant(df, None).count() == intake.of_tenant(df, "").count() == 0


def test_files(spark, tmp_path):
    lines = [json.dumps({"scenario_id": "s", "family_id": "f", "split": "train", "concept_id": "c", "turns": [{"turn": 0}]}), "", json.dumps({"scenario_id": "s"})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = files.trajectories(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.world_truth, r.reject) for r in got] == [({"concept_id": "c"}, None), ({}, "family_id")]
    (tmp_path / "c.txt").write_text('plain\n\n{"content": "x", "split": "train"}\n{"text": "y", "split": "dev"}\n{bad json\n')
    assert {r.text for r in files.corpus(spark, str(tmp_path / "c.txt")).collect()} == {"plain", "x", "{bad json"}
    (tmp_path / "h.json").write_text('{"items": [{"a": 1}, {"a": 2}]}')
    assert files.held_out(spark, str(tmp_path / "h.json")).count() == 2


def test_verified_files(spark, tmp_path):
    import hashlib

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    m = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0"), ("../x", "0")], "path string, sha256 string")
    assert {r.path: r.status for r in files.verified(spark, str(tmp_path / "m"), m).collect()} == {"a.bin": "ok", "b.bin": "missing", "../x": "unsafe_path"}


def test_webhook(spark):
    sent = [{"event": "message.received", "data": {"id": "1", "chatId": "c", "body": "halo", "timestamp": 5}}, {"event": "ack"}, {"event": "message.received", "data": {"id": "2"}}, {"event": "message.received", "data": {"id": "3", "latitude": 1.0}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in sent], "p string")
    got = [r.m for r in df.select(payloads.webhook(F.col("p"), "t").alias("m")).collect()]
    assert (got[0].text, got[0].conversation_id, got[0].received_at) == ("halo", "c", "5")
    assert got[1] is None and got[2] is None and got[3].text == "[Pin Lokasi]"


def test_streaming_bursts(spark, tmp_path):
    from caseloom.streaming.bursts import assembled

    rows = [("a", i, s) for i, s in enumerate([1000, 1003, 1007, 1030])] + [("b", 9, 1500)]
    spark.createDataFrame(rows, "k string, id int, s int").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, id int, s int, at timestamp").parquet(str(tmp_path / "in")).withWatermark("at", "1 second")
    q = assembled(stream, "k", "at", "id").writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    import hashlib

    seen = ""
    for i in "012":
        seen = hashlib.md5((seen + i).encode()).hexdigest()
    got = {(r.key, r.burst, r.n, r.ids_hash) for r in spark.table("bursts").collect()}
    assert got >= {("a", 0, 3, seen), ("a", 1, 1, hashlib.md5(b"3").hexdigest())}


def test_broker_polls_and_commits(spark):
    from caseloom.sources import broker

    log = broker.appended(spark.createDataFrame([("t", i) for i in range(7)] + [("u", 0)], "topic string, n int"), "topic", [F.col("n")], "log_offset")
    at = spark.createDataFrame([("t", 5)], "topic string, committed long")
    polled = broker.polled(log, at, "topic", "log_offset", 4)
    assert {(r.topic, r.n) for r in polled.collect()} == {("t", 5), ("t", 6), ("u", 0)}
    assert {tuple(r) for r in broker.committed(at, polled.where("n < 6"), "topic", "log_offset").collect()} == {("t", 6), ("u", 1)}


def test_manifest_of_held_out_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", str(i), "x") for i in range(3)] + [("b", "9", "y")], "split string, id string, text string")
    made = files.exported(rows, str(tmp_path / "out"), "split")
    assert {(r.split, r.records) for r in made.collect()} == {("a", 3), ("b", 1)}
    listed = made.select(F.col("split").alias("name"), "path", "sha256", F.lit(3).alias("expected_count"), F.lit(None).cast("string").alias("split_hash"))
    got = {r.name: r for r in files.validated(spark, str(tmp_path / "out"), listed, ["id"], spark.createDataFrame([("9",)], "id string")).collect()}
    assert got["a"].is_valid and got["a"].split_hash_matches is None
    assert not got["b"].is_valid and not got["b"].count_matches and not got["b"].zero_leakage and got["b"].sha256_matches


@pytest.mark.parametrize(("pivots", "size"), [(64, 4096), (3, 4), (1, 1)])
def test_nearest_rows_equal_brute_force(spark, pivots, size):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    v[10:20] = v[9]  # copies
    rows = [(i, "a" if i % 4 else "b", v[i].tolist()) for i in range(60)] + [(60, "a", None), (61, "a", [0.0] * 5), (62, "a", [1.0]), (63, None, v[0].tolist())]
    df = spark.createDataFrame(rows, "id long, block string, v array<double>")
    got = retrieval.similar_pairs(df.where("id % 3 = 0"), df, "block", "id", "v", 0.2, 4, pivots, size)
    want = set()
    for i, b, x in rows:
        if i % 3 or b is None or x is None or len(x) != 5:
            continue
        near = []
        for j, c, y in rows:
            if j != i and c == b and y is not None and len(y) == 5:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                s = round(float(np.dot(x, y) / n), 6) if n > 1e-9 else 0.0
                near += [(-s, j)] if s >= 0.2 else []
        want |= {(i, j, -s, k) for k, (s, j) in enumerate(sorted(near)[:4], 1)}
    assert {(r.query_id, r.entry_id, r.similarity, r["rank"]) for r in got.collect()} == want
    assert retrieval.similar_pairs(df.limit(0), df, "block", "id", "v", 0.2, 4).count() == 0
    assert retrieval.similar_pairs(df, df.limit(0), "block", "id", "v", 0.2, 4).count() == 0
