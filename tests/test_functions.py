import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from caseloom.functions import scores, text, vectors
from caseloom.operators import cases, datasets, spans


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normalised_hash(spark):
    got = one(spark, text.text_hash(F.lit("  Jalan  RUSAK\n é ")))[0]
    assert got == hashlib.sha256("jalan rusak é".encode()).hexdigest()


def test_uuid5(spark):
    got = one(spark, text.uuid5(str(uuid.NAMESPACE_URL), F.lit("case:1")))[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "case:1"))


def test_connector_split(spark):
    got = one(spark, text.connector_split(F.lit("Jalan depan pasar banjir karena selokan mampet total")))[0]
    assert (got.cause, got.effect) == ("selokan mampet total", "Jalan depan pasar banjir")
    assert one(spark, text.connector_split(F.lit("banjir karena hujan")))[0] is None


def test_ngrams_and_masks(spark):
    words = F.array(*map(F.lit, "a b c d".split()))
    assert one(spark, text.ngrams(words, 3), text.ngrams(words, 5))[:] == (["a b c", "b c d"], [])
    s = F.array(F.struct(F.lit(6).alias("start"), F.lit(11).alias("end")))
    assert one(spark, text.masked_spans(F.lit("hello world again"), s))[0] == "hello again"


@pytest.mark.parametrize(
    ("said", "label"),
    [
        ("Lampu mati di Jl. Merdeka No. 12 dekat taman", "SUFFICIENT"),
        ("Banjir di kecamatan Coblong", "INCOMPLETE"),
        ("Sampah menumpuk, patokannya belum jelas", "AMBIGUOUS"),
        ("Ada lubang, lokasi tepatnya masih belum diketahui warga", "AMBIGUOUS"),
        ("Pohon tumbang di gasibu daerah dago", "SUFFICIENT"),
        ("Jalan rusak sekali", "INCOMPLETE"),
    ],
)
def test_completeness(spark, said, label):
    assert one(spark, cases.completeness(F.lit(said)))[0] == label


def test_nearest_place(spark):
    assert one(spark, cases.nearest_place(F.lit(-6.9389), F.lit(107.5889)))[0] == "Bojongloa Kaler"


def test_authority(spark):
    got = one(spark, cases.authority(F.lit("JUR-FICT-02"), F.lit("WASTE")), cases.authority(F.lit("JUR-FICT-09"), F.lit("WASTE")))
    assert got[:] == ("UNIT-LH-02", None)


def test_gates_fail_closed(spark):
    null = F.lit(None)
    gate = cases.ticket_gate(F.lit("JUR-FICT-01"), F.lit("ROAD"), null.cast("string"), F.array().cast("array<string>"), F.lit(True), F.lit("k"), F.lit("k"))
    assert one(spark, gate)[0] == "AUTHORITY_ROUTE_INVALID"


def test_softmax_and_argmax(spark):
    p = one(spark, vectors.softmax(F.array(F.lit(1.0), F.lit(1.0)), 0.5), vectors.argmax(F.array(F.lit(2.0), F.lit(5.0), F.lit(5.0))))
    assert p[0] == pytest.approx([0.5, 0.5]) and p[1] == 1


def test_trust_uses_the_parent_for_thin_support(spark):
    n = F.lit(None).cast("int")
    t = one(spark, scores.trust(n, n, n, n, F.lit(95), F.lit(100), F.lit(0.95)))[0]
    assert t.used_parent and t.posterior_mean == pytest.approx(96 / 102) and 0 < t.lower_bound < t.posterior_mean


def test_chunks(spark):
    got = one(spark, spans.chunk_bounds(F.lit(1000)), spans.chunk_bounds(F.lit(0)))
    assert [(c.start, c.end) for c in got[0]] == [(0, 448), (384, 832), (768, 1000)]
    assert [(c.start, c.end) for c in got[1]] == [(0, 0)]


def test_merged_spans_stop_at_another_label(spark):
    rows = [(0, 5, "LOC", 0.5), (4, 9, "LOC", 0.9), (6, 8, "OBJ", 0.4), (9, 12, "LOC", 0.3), (13, 15, "LOC", 0.2)]
    df = spark.createDataFrame([(rows,)], "s array<struct<start:int,end:int,label:string,confidence:double>>")
    got = df.select(spans.merged_spans(F.col("s"))).first()[0]
    assert [(m.start, m.end, m.label, m.confidence) for m in got] == [(0, 9, "LOC", 0.9), (6, 8, "OBJ", 0.4), (9, 15, "LOC", 0.3)]


def test_message_times(spark):
    at = lambda v: one(spark, F.unix_micros(scores.epoch_or_iso(F.lit(v), F.timestamp_seconds(F.lit(7)))))[0] / 1e6
    assert [at(v) for v in ("1700000000", "1700000000000", "2023-11-14T22:13:20Z", "soon")] == [1.7e9, 1.7e9, 1.7e9, 7]


def test_word_lists_match_themselves_only(spark):
    df = spark.createDataFrame([("abc",), ("x*",), ("a|b [c] $^?",), (None,)], "t string")
    found = lambda words: [r[0] for r in df.select(text.any_word(F.col("t"), words)).collect()]
    assert found([]) == [False, False, False, None]
    assert found(["x*"]) == [False, True, False, None]
    assert found(["[c]", "$^?"]) == [False, False, True, None]
    alias = [r[0] for r in df.select(datasets.longest_alias(F.col("t"), ["b [c]", "a|b", "c", "ab"])).collect()]
    assert alias == [None, None, "b [c]", None] and [r[0] for r in df.select(datasets.longest_alias(F.col("t"), [])).collect()] == [None] * 4


def test_ngram_keys_tell_runs_apart(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    a, b, c, d = one(spark, *(text.ngram_hashes(words(s), 3) for s in ("a b c d", "x a b c", "a b", "c b a")))
    assert len(a) == 2 and a[0] == b[1] and c == [] and d[0] not in a
    assert one(spark, text.word_count(F.lit("don't  été 中文 a_b")), F.size(text.word_tokens(F.lit("don't  été 中文 a_b"))))[:] == (5, 5)


def test_ambiguous_places_and_landmarks(spark):
    say = lambda t: one(spark, cases.completeness(F.lit(t)))[0]
    assert say("Jalan rusak, patokannya belum jelas") == "AMBIGUOUS"
    assert say("Lokasi persisnya masih belum diketahui") == "AMBIGUOUS"
    assert say("lampu mati dekat taman lansia di dago") == "SUFFICIENT"
    assert say("lampu mati") == "INCOMPLETE"


def test_questions(spark):
    ask = lambda f, c: one(spark, cases.question(F.lit(f), F.lit(c)))[0]
    assert ask(" Location", "WASTE") == cases.LOCATION_QUESTIONS["WASTE"] and ask("location", "OTHER") == cases.FIELD_QUESTIONS["location"]
    assert ask("alamat rumah", "ROAD") == cases.FIELD_QUESTIONS["location"] and ask("waktu", "ROAD") == cases.FIELD_QUESTIONS["time"]
    assert "warna" in ask("warna", "ROAD")


def test_masked_mean(spark):
    tokens = F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    mask = lambda *m: F.array(*map(F.lit, m))
    assert one(spark, vectors.masked_mean(tokens, mask(1, 1, 0)))[0] == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.masked_mean(tokens, mask(0, 0, 0)))[0] == [0.0, 0.0]


def test_constituents_and_synonyms(spark):
    got = one(spark, datasets.constituents(F.lit("lampu jalan mati/redup di dekat pasar-baru lama"), ["di", "dan"]))[0]
    assert got == ["lampu jalan mati", "atau redup", "di dekat pasar", "baru lama"]
    assert one(spark, datasets.constituents(F.lit("a b c d"), []))[0] == ["a b c d"] and one(spark, datasets.constituents(F.lit("  "), []))[0] == []
    assert one(spark, datasets.synonyms(F.lit("The cat, thé the_x THE"), {"the": "this"}))[0] == "this cat, thé the_x this"
