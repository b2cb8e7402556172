"""Queries over retrieval, vectors, tokens and spans (families D, E, F, G, I, K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text, vectors
from caseloom.functions.scores import rounded
from caseloom.operators import cases, intake, ledger, retrieval, spans
from caseloom.operators.keyed import ranked

from .registry import query, table

WORD = r"([\p{L}\p{M}\p{N}_]+)"
PAIRS = "SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"


@query("D8_similarity_join", f"SELECT query_id, entry_id, similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id))::INT AS rank FROM ({PAIRS}) WHERE similarity >= 0.15 AND query_id % 20 = 0) WHERE rank <= 5")
def d8(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.similar_pairs(e.where("vec_id % 20 = 0"), e, "label", "vec_id", "embedding", 0.15, 5)


@query("G3_vector_top_k", f"SELECT query_id, entry_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id))::INT AS rank FROM ({PAIRS})) WHERE rank <= 5 AND query_id % 20 = 0")
def g3(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.similar_pairs(e.where("vec_id % 20 = 0"), e, "label", "vec_id", "embedding", -1.0, 5).select("query_id", "entry_id", "rank")


@query("D9_set_overlap", r"""
WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_\-]+)', 1)), lambda w: length(w) > 6) AS w FROM conversations)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn AND list_has_any(a.w, b.w)""")
def d9(spark, d):
    long = F.filter(F.array_distinct(text.ascii_tokens(F.col("text"))), lambda w: F.length(w) > 6)
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(long).alias("w"))
    return t.withColumnRenamed("turn", "turn_a").join(t.withColumnRenamed("turn", "turn_b"), ["conv_id", "w"]).where("turn_a < turn_b").select("conv_id", "turn_a", "turn_b").distinct()


MESSAGE_SPANS = "SELECT conv_id, turn, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 2)::BIGINT AS s, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2)::BIGINT AS e FROM conversations"


def _message_spans(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text") + 2).over(w) - 2
    return table(spark, d, "conversations").select("conv_id", "turn", (end - F.length("text")).alias("s"), end.alias("e"))


@query("F5_character_offsets", f"SELECT conv_id, turn, s AS char_start, e AS char_end FROM ({MESSAGE_SPANS})")
def f5(spark, d):
    return _message_spans(spark, d).select("conv_id", "turn", F.col("s").alias("char_start"), F.col("e").alias("char_end"))


@query("D10_chunk_provenance", f"""
WITH m AS ({MESSAGE_SPANS}), c AS (SELECT conv_id, unnest(range(0, max(e), 500)) AS cs FROM m GROUP BY conv_id)
SELECT m.conv_id, cs AS chunk_start, turn FROM c JOIN m ON c.conv_id = m.conv_id AND s < cs + 600 AND cs < e""")
def d10(spark, d):
    m = _message_spans(spark, d)
    c = m.groupBy("conv_id").agg(F.max("e").alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(500).cast("long"))).alias("cs")).withColumn("ce", F.col("cs") + 600)
    return spans.overlapping(c, m, ["conv_id"], ("cs", "ce"), ("s", "e")).select("conv_id", F.col("cs").alias("chunk_start"), "turn")


TOKENS = r"""SELECT conv_id, turn, token, (sum(length(token)) OVER w - length(token))::BIGINT AS s, (sum(length(token)) OVER w)::BIGINT AS e, i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+)', 1)) AS token, generate_subscripts(regexp_extract_all(text, '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+)', 1), 1) AS i FROM conversations) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)"""


MARKS_SQL = "(VALUES (1, 0, 5, 'A'), (2, 3, 30, 'B'), (3, 40, 55, 'C'), (4, 50, 52, 'B')) z(o, zs, ze, label)"


def _marks(t):
    """Four spans of each turn, of which some overlap."""
    cells = F.array(*(F.struct(F.lit(o).alias("ordinal"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(x).alias("label")) for o, s, e, x in ((1, 0, 5, "A"), (2, 3, 30, "B"), (3, 40, 55, "C"), (4, 50, 52, "B"))))
    return t.select("conv_id", "turn", F.explode(cells).alias("z")).select("conv_id", "turn", "z.*")


@query("D11_word_span_labels", f"""
WITH t AS (SELECT * FROM ({TOKENS}) WHERE NOT regexp_matches(token, '^\\s')), m AS (SELECT conv_id, turn, i, s, min(o) AS o, arg_min(label, o) AS label FROM t JOIN {MARKS_SQL} ON greatest(s, zs) < least(e, ze) GROUP BY ALL), w AS (SELECT t.*, m.o, m.label FROM t LEFT JOIN m USING (conv_id, turn, i))
SELECT conv_id, turn, w.s AS token_start, CASE WHEN o IS NULL THEN 'O' WHEN o IS NOT DISTINCT FROM lag(o) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 'I-' || label ELSE 'B-' || label END AS tag FROM w""")
def d11(spark, d):
    c = table(spark, d, "conversations")
    words = spans.tokens_with_offsets(c, ["conv_id", "turn"])
    return spans.labelled_words(words, _marks(c), ["conv_id", "turn"]).select("conv_id", "turn", "token_start", "tag")


IDS = {"O": 0, "B-A": 1, "I-A": 2, "B-B": 3, "I-B": 4}


@query("M19_subtoken_labels", f"""
WITH t AS (SELECT conv_id, turn, i AS word, token, s, e FROM ({TOKENS}) WHERE NOT regexp_matches(token, '^\\s')), p AS (SELECT conv_id, turn, word, (unnest(range(s, e, 3)))::BIGINT AS s, e FROM t), u AS (SELECT conv_id, turn, word, s, least(s + 3, e) AS e FROM p UNION ALL SELECT conv_id, turn, 0, 0, 0 FROM conversations UNION ALL SELECT conv_id, turn, 1000000, 0, 0 FROM conversations),
m AS (SELECT conv_id, turn, word, s, e, min(o) AS o, arg_min(label, o) AS label FROM u JOIN {MARKS_SQL} ON greatest(s, zs) < least(e, ze) GROUP BY ALL), w AS (SELECT u.*, m.o, m.label FROM u LEFT JOIN m USING (conv_id, turn, word, s, e)),
g AS (SELECT *, CASE WHEN o IS NULL THEN 'O' WHEN o IS NOT DISTINCT FROM lag(o) OVER (PARTITION BY conv_id, turn ORDER BY word, s) THEN 'I-' || label ELSE 'B-' || label END AS tag FROM w)
SELECT conv_id, turn, word, s AS token_start, CASE WHEN s >= e THEN -100 ELSE CASE tag WHEN 'B-A' THEN 1 WHEN 'I-A' THEN 2 WHEN 'B-B' THEN 3 WHEN 'I-B' THEN 4 ELSE 0 END END AS label_id FROM g""")
def m19(spark, d):
    """Words in pieces of three characters between two tokens without width; the label C has no id."""
    t = spans.label_ids(spans.labelled_words(_subtokens(spark, d), _marks(table(spark, d, "conversations")), ["conv_id", "turn"], "place"), IDS)
    return t.select("conv_id", "turn", "word", "token_start", "label_id")


def _subtokens(spark, d):
    c = table(spark, d, "conversations")
    words = spans.tokens_with_offsets(c, ["conv_id", "turn"])
    cut = words.select("conv_id", "turn", (F.col("i") + 1).alias("word"), F.explode(F.sequence("token_start", F.col("token_end") - 1, F.lit(3).cast("long"))).alias("token_start"), F.col("token_end").alias("stop"))
    pieces = cut.select("conv_id", "turn", "word", "token_start", F.least(F.col("token_start") + 3, F.col("stop")).alias("token_end"))
    edge = lambda n: c.select("conv_id", "turn", F.lit(n).alias("word"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end"))
    return pieces.unionByName(edge(0)).unionByName(edge(1000000)).withColumn("place", F.struct("word", "token_start"))


BIO_SQL = f"""
WITH t AS (SELECT *, CASE WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'B-CAP' WHEN length(token) >= 6 THEN 'I-LONG' WHEN length(token) = 1 THEN 'O' ELSE 'I-CAP' END AS tag FROM ({TOKENS}) WHERE NOT regexp_matches(token, '^\\s')),
l AS (SELECT *, nullif(regexp_extract(tag, '^[BI]-(.*)$', 1), '') AS label FROM t), p AS (SELECT *, lag(coalesce(label, '')) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM l),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND label IS DISTINCT FROM before) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM p)
SELECT conv_id, turn, label, min(s) AS span_start, max(e) AS span_end, count(*) AS n_tokens FROM g WHERE label IS NOT NULL GROUP BY conv_id, turn, run, label"""


@query("F6_bio_runs", BIO_SQL)
def f6(spark, d):
    t = spans.tokens_with_offsets(table(spark, d, "conversations"), ["conv_id", "turn"])
    tag = F.when(F.col("token").rlike(r"^\p{Lu}"), "B-CAP").when(F.length("token") >= 6, "I-LONG").when(F.length("token") == 1, "O").otherwise("I-CAP")
    return spans.bio_spans(t.withColumn("tag", tag), ["conv_id", "turn"])


@query("F7_merged_spans", """
WITH s AS (SELECT l_orderkey, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e, l_returnflag AS label FROM lineitem WHERE l_returnflag = 'A'),
o AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT l_orderkey, min(s) AS span_start, max(e) AS span_end FROM g GROUP BY l_orderkey, run""")
def f7(spark, d):
    s = F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("label"), F.lit(1.0).alias("confidence"))
    t = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.collect_list(s).alias("s"))
    return t.select("l_orderkey", F.explode(spans.merged_spans(F.col("s"))).alias("m")).select("l_orderkey", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"))


@query("F8_continuation_repair", f"""
WITH t AS (SELECT conv_id, turn, i AS word, s, e FROM ({TOKENS}) WHERE NOT regexp_matches(token, '^\\s')), p AS (SELECT conv_id, turn, word, (unnest(range(s, e, 3)))::BIGINT AS s, e FROM t), u AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN word END AS word, s, least(s + 3, e) AS e, CASE WHEN s % 2 = 0 THEN 'B-A' ELSE 'I-A' END AS tag FROM p)
SELECT conv_id, turn, s AS token_start, CASE WHEN tag = 'B-A' AND CASE WHEN word IS NULL THEN s = lag(e) OVER w ELSE word = lag(word) OVER w END THEN 'I-A' ELSE tag END AS tag FROM u WINDOW w AS (PARTITION BY conv_id, turn ORDER BY s)""")
def f8(spark, d):
    """Sub-tokens of turns; in every second turn they have no word numbers, so contiguity decides."""
    t = _subtokens(spark, d).where("token_start < token_end").withColumn("tag", F.when(F.col("token_start") % 2 == 0, "B-A").otherwise("I-A")).withColumn("word", F.when(F.col("turn") % 2 == 0, F.col("word")))
    return spans.repaired(t, ["conv_id", "turn"], "token_start").select("conv_id", "turn", "token_start", "tag")


@query("F4_cumulative_text", "SELECT conv_id, turn, sha256(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS text_hash FROM conversations")
def f4(spark, d):
    """The hash of all texts up to each turn; a running hash, so no text is repeated."""
    return intake.running_hashes(table(spark, d, "conversations"), "conv_id", ["turn"], "text", "turn", "text_hash").select("conv_id", "turn", "text_hash")


@query("I9_regex_entities", r"""
SELECT doc_id, len(regexp_extract_all(text, ' of [A-Za-z]+'))::INT + len(regexp_extract_all(text, '[0-9]{2,}'))::INT AS n_entities, (regexp_extract_all(text, '[0-9]{2,}'))[1] AS first_number FROM documents""")
def i9(spark, d):
    e = spans.regex_entities(F.col("text"), [("LOCATION", " of [A-Za-z]+", 0.95), ("TIME", "[0-9]{2,}", 0.9)])
    t = table(spark, d, "documents").select("doc_id", e.alias("e"))
    return t.select("doc_id", F.size("e").alias("n_entities"), F.get(F.filter("e", lambda x: x["label"] == "TIME"), F.lit(0))["text"].alias("first_number"))


@query("L6_chunks", rf"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}', 1)) AS n FROM documents)
SELECT doc_id, k::INT AS chunk_start, least(k + 448, n)::INT AS chunk_end FROM (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 448) / 384.0)::BIGINT, 0) * 384 + 1, 384)) AS k FROM t)""")
def l6(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("n"))
    return t.select("doc_id", F.explode(spans.chunk_bounds(F.col("n"))).alias("c")).select("doc_id", F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))


@query("E19_document_frequency", rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}', 1)) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1""")
def e19(spark, d):
    return retrieval.corpus_statistics(table(spark, d, "documents"))[0].select("term", "df")


BM25_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}', 1) AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}', 1)) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6)::DOUBLE AS lexical_score FROM p JOIN q USING (term) JOIN f USING (term), n GROUP BY ALL)"""


def _bm25(spark, d):
    s = retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return s.withColumn("lexical_score", rounded(F.col("lexical_score"), 6))


@query("J6_bm25", BM25_SQL + " SELECT item_id, count(*) AS n_hits, round(max(lexical_score), 4) AS best FROM s GROUP BY 1")
def j6(spark, d):
    return _bm25(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_hits"), rounded(F.max("lexical_score"), 4).alias("best"))


@query("G4_bm25_top_k", BM25_SQL + " SELECT item_id, doc_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(lexical_score, 4) DESC, doc_id))::INT AS rank FROM s) WHERE rank <= 10")
def g4(spark, d):
    return retrieval.top_k(_bm25(spark, d).withColumn("lexical_score", rounded(F.col("lexical_score"), 4)), "item_id", "lexical_score", "doc_id", 10).select("item_id", "doc_id", "rank")


@query("F1_score_ranks", BM25_SQL + " SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(lexical_score, 4) DESC, doc_id) AS rank FROM s")
def f1(spark, d):
    """Every hit has its rank; ranges of scores are ranked apart, so no query's hits meet in one task."""
    scored = _bm25(spark, d).select("item_id", "doc_id", rounded(F.col("lexical_score"), 4).alias("score"))
    r = ranked(scored, ["item_id"], [-F.col("score"), F.col("doc_id")], "rank")
    return r.select("item_id", "doc_id", (F.col("rank") + 1).alias("rank"))


@query("J7_rerank", BM25_SQL + rf""",
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lexical_score DESC, doc_id) AS r FROM s) WHERE r <= 20),
b AS (SELECT c.item_id, c.doc_id, lexical_score, regexp_extract_all(lower(q.text), '{WORD}', 1) AS q, regexp_extract_all(lower(t.text), '{WORD}', 1) AS t FROM c JOIN benchmark q USING (item_id) JOIN documents t USING (doc_id))
SELECT item_id, doc_id, round(len(list_intersect(list_distinct(q), t)) / greatest(len(list_distinct(q)), 1), 6)::DOUBLE AS coverage, contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') AS whole_phrase, round(lexical_score / max(lexical_score) OVER (PARTITION BY item_id), 4) AS lexical FROM b""")
def j7(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    pool = retrieval.top_k(_bm25(spark, d), "item_id", "lexical_score", "doc_id", 20)
    r = retrieval.rerank(pool, docs, items)
    return r.select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"), (F.col("phrase") == 1.0).alias("whole_phrase"), F.round("lexical", 4).alias("lexical"))


CACHE_SQL = """
WITH k AS (SELECT vec_id, label, embedding::DOUBLE[] AS y, md5((vec_id % 3 = 0)::VARCHAR || (vec_id // 7)::VARCHAR) AS h FROM embeddings), q AS (SELECT vec_id, label, y AS x, h FROM k WHERE vec_id % 20 = 0),
e AS (SELECT q.vec_id, min(k.vec_id) AS entry_id FROM q JOIN k ON q.label = k.label AND q.h = k.h AND q.vec_id <> k.vec_id GROUP BY 1),
n AS (SELECT q.vec_id, k.vec_id AS entry_id, round(list_cosine_similarity(x, y), 6) AS s FROM q JOIN k ON q.label = k.label AND q.vec_id <> k.vec_id WHERE q.vec_id NOT IN (SELECT vec_id FROM e)),
b AS (SELECT vec_id, entry_id, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, entry_id) AS r FROM n WHERE s >= 0.12) WHERE r = 1)
SELECT q.vec_id, coalesce(e.entry_id, b.entry_id) AS entry_id, CASE WHEN e.entry_id IS NOT NULL THEN 'EXACT' WHEN b.s >= 0.25 THEN 'DUPLICATE' WHEN b.s IS NOT NULL THEN 'REUSE' ELSE 'MISS' END AS action, CASE WHEN e.entry_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(b.s, 0.0) END AS similarity
FROM q LEFT JOIN e USING (vec_id) LEFT JOIN b USING (vec_id)"""


@query("K20_cache_lookup", CACHE_SQL)
def k20(spark, d):
    h = F.md5(F.concat((F.col("vec_id") % 3 == 0).cast("string"), F.floor(F.col("vec_id") / 7).cast("string")))
    e = table(spark, d, "embeddings").withColumn("h", h)
    found = retrieval.cache_lookup(e.where("vec_id % 20 = 0"), e, "vec_id", "label", "h", "embedding", 0.25, 0.12)
    return found.select("vec_id", "entry_id", "action", "similarity")


@query("G9_round_questions", """
WITH f AS (SELECT user_id, list(DISTINCT event_type) FILTER (event_type <> 'error') AS asked, list(DISTINCT event_type) FILTER (value > 49) AS resolved FROM events GROUP BY 1), m AS (SELECT user_id, ['signup', 'view', 'click', 'purchase', 'error', 'time'] AS w, coalesce(asked, []) AS a, coalesce(resolved, []) AS r FROM f),
c AS (SELECT user_id, list_filter(w, lambda x: NOT list_contains(r, x)) AS still, list_filter(w, lambda x: NOT list_contains(r, x) AND NOT list_contains(a, x)) AS fresh FROM m)
SELECT user_id, array_to_string((CASE WHEN len(fresh) > 0 THEN fresh ELSE still END)[1:2], ',') AS questions FROM c""")
def g9(spark, d):
    """The next questions for each user: fields asked are the types of their events, resolved those with a high value."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("asked"), F.collect_set(F.when(F.col("value") > 49, F.col("event_type"))).alias("resolved"))
    wanted = F.array(*map(F.lit, ["signup", "View ", "click", "purchase", "error", "view", "time"]))
    return seen.select("user_id", F.array_join(ledger.round_questions(wanted, F.col("resolved"), F.col("asked")), ",").alias("questions"))


ASKED = ["location", " Location_Incomplete ", "time", "issue", "image_fallback", "alamat lengkap", "waktu kejadian", "warna"]
QUESTION_SQL = " ".join(f"WHEN f IN ('location', 'location_incomplete') AND category = '{c}' THEN '{q}'" for c, q in cases.LOCATION_QUESTIONS.items()) + " " + " ".join(f"WHEN f = '{f}' THEN '{q}'" for f, q in cases.FIELD_QUESTIONS.items())


@query("I14_question_lookup", f"""
WITH t AS (SELECT o_orderkey, (list_concat({cases.CATEGORIES}, ['NONE']))[(o_orderkey % 13 + 1)::INT] AS category, ({ASKED})[(o_custkey % 8 + 1)::INT] AS field FROM orders), n AS (SELECT *, lower(trim(field)) AS f FROM t)
SELECT o_orderkey, CASE {QUESTION_SQL} WHEN contains(f, 'loc') OR contains(f, 'alamat') THEN '{cases.FIELD_QUESTIONS['location']}' WHEN contains(f, 'time') OR contains(f, 'waktu') THEN '{cases.FIELD_QUESTIONS['time']}' ELSE 'Mohon berikan informasi lebih lanjut mengenai ' || field || ' agar aduan dapat kami proses.' END AS question FROM n""")
def i14(spark, d):
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.col(by) % len(names)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", cases.question(pick(ASKED, "o_custkey"), pick([*cases.CATEGORIES, "NONE"], "o_orderkey")).alias("question"))


@query("L10_span_union", "SELECT conv_id, turn, md5(substr(text, 1, (length(text) // 2)::BIGINT) || repeat(' ', greatest(length(text) - 5 - length(text) // 2, 0)::INT) || CASE WHEN length(text) - 5 >= length(text) // 2 THEN substr(text, length(text) - 4, 5) ELSE substr(text, (length(text) // 2 + 1)::BIGINT) END) AS text_md5 FROM conversations WHERE length(text) >= 8")
def l10(spark, d):
    """Two spans that overlap and one behind a gap, as one text."""
    n = F.length("text")
    part = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.substring("text", (a + 1).cast("int"), (b - a).cast("int")).alias("text"))
    three = F.array(part(F.floor(n / 4), F.floor(n / 2)), part(n - 5, n), part(F.lit(0), F.floor(n / 3)))
    return table(spark, d, "conversations").where(n >= 8).select("conv_id", "turn", F.md5(spans.union_text(three)).alias("text_md5"))


@query("I11_seeded_thinning", """
SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(text, ' '), lambda w, i: ('0x' || substr(sha256('7:' || conv_id || '-' || turn || ':' || (i - 1)), 1, 6))::INT % 1000 >= 100), ' ')) AS text_md5 FROM conversations""")
def i11(spark, d):
    from caseloom.operators.inference import thinned

    key = F.concat_ws("-", "conv_id", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(thinned(F.col("text"), key, 7)).alias("text_md5"))


@query("L1_sql_dot_product", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings")
def l1(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"))


@query("L2_path_function", r"SELECT page_id, NOT regexp_matches(substr(url, 9), '(^|/)\.\.?(/|$)') AND NOT starts_with(substr(url, 9), '/') AND length(substr(url, 9)) > 0 AS valid FROM pages")
def l2(spark, d):
    return table(spark, d, "pages").select("page_id", text.valid_path(F.substring("url", 9, 10_000_000)).alias("valid"))


@query("J13_half_even", "SELECT o_orderkey, round_even(o_totalprice / 1000, 0)::DOUBLE AS thousands FROM orders")
def j13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / 1000, 0).alias("thousands"))


RANK_SQL = "CASE {0} WHEN 'TIME' THEN 3 WHEN 'LOC' THEN 2 WHEN 'OBJ' THEN 1 ELSE 0 END"
MARK_CHARS = " ' ' || chr(9) || chr(13) || chr(10) || '.,!?:;\"''()[]{}' "


def _trim_sql(spans_: str) -> str:
    piece = "substr(t, x.s + 1, greatest(x.e - x.s, 0))"
    inside = "(t IS NOT NULL AND x.s >= 0 AND x.e <= length(t))"
    return f"list_filter(list_transform({spans_}, lambda x: {{'s': CASE WHEN {inside} THEN x.s + length({piece}) - length(ltrim({piece}, {MARK_CHARS})) ELSE x.s END, 'e': CASE WHEN {inside} THEN x.e - (length({piece}) - length(rtrim({piece}, {MARK_CHARS}))) ELSE x.e END, 'l': x.l}}), lambda x: x.s >= 0 AND x.s < x.e)"


def _resolved_sql(source: str, key: str) -> str:
    """CTEs up to ``r(key, r)``: the list of resolved spans {s, e, l} of each row of ``source`` (key, t, sp)."""
    inner = "list_filter(a, lambda x: x.s >= o.s AND x.e <= o.e AND (x.s <> o.s OR x.e <> o.e))"
    reach = f"list_max(list_transform(({inner})[1:i - 1], lambda y: y.e))"
    gap = f"(i > 1 AND g.s > {reach} AND CASE WHEN g.s <= coalesce(length(t), -1) THEN g.s - {reach} > 1 AND lower(trim(substr(t, {reach} + 1, g.s - {reach}))) NOT IN ('', 'dan', 'atau', 'serta', '&', 'yg', 'yang') ELSE g.s - {reach} > 6 END)"
    crosses = "((k.s < x[1].s AND x[1].s < k.e AND k.e < x[1].e) OR (x[1].s < k.s AND k.s < x[1].e AND x[1].e < k.e))"
    return f"""z0 AS ({source}), z1 AS (SELECT {key}, t, {_trim_sql('sp')} AS q FROM z0),
z2 AS (SELECT {key}, t, list_sort(list_transform(q, lambda x: {{'s': x.s, 'back': -x.e, 'low': -({RANK_SQL.format('x.l')}), 'e': x.e, 'l': x.l}})) AS o_ FROM z1),
z3 AS (SELECT {key}, t, list_filter(o_, lambda x, i: i = 1 OR o_[i - 1].s <> x.s OR o_[i - 1].e <> x.e) AS a FROM z2),
z4 AS (SELECT {key}, t, list_filter(a, lambda o: NOT (len({inner}) > 1 AND len(list_filter({inner}, lambda x: x.l <> o.l)) = 0 AND len(list_filter({inner}, lambda g, i: {gap})) > 0)) AS b FROM z3),
z5 AS (SELECT {key}, t, list_transform(list_sort(list_transform(b, lambda x: {{'low': x.low, 'short': x.s - x.e, 's': x.s, 'e': x.e, 'l': x.l}})), lambda x: [x]) AS c FROM z4),
z6 AS (SELECT {key}, t, CASE WHEN len(c) = 0 THEN [] ELSE list_reduce(c, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {crosses})) > 0 THEN kept ELSE list_concat(kept, x) END) END AS kept FROM z5),
z7 AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(kept, lambda x: x.s), list_transform(kept, lambda x: x.e)))) AS bd FROM z6),
z8 AS (SELECT *, list_filter(list_transform(bd[1:len(bd) - 1], lambda x, i: {{'s': x, 'e': bd[i + 1], 'of': (list_filter(kept, lambda k: k.s <= x AND bd[i + 1] <= k.e))[1]}}), lambda x: x.of IS NOT NULL) AS cells FROM z7),
z9 AS (SELECT *, CASE WHEN len(cells) = 0 THEN [] ELSE list_reduce(list_transform(cells, lambda x: [x]), lambda done, x: CASE WHEN done[-1].e = x[1].s AND done[-1].of = x[1].of THEN list_concat(done[1:len(done) - 1], [{{'s': done[-1].s, 'e': x[1].e, 'of': done[-1].of}}]) ELSE list_concat(done, x) END) END AS pieces FROM z8),
r AS (SELECT {key}, {_trim_sql("list_transform(pieces, lambda p: {'s': p.s, 'e': p.e, 'l': p.of.l})")} AS r FROM z9)"""


L9_SOURCE = "SELECT conv_id, turn, text AS t, [{'s': 0, 'e': length(text) // 2, 'l': 'OBJ'}, {'s': length(text) // 10, 'e': length(text) // 5, 'l': 'TIME'}, {'s': 3 * length(text) // 10, 'e': 7 * length(text) // 10, 'l': 'LOC'}, {'s': 4 * length(text) // 5, 'e': 9 * length(text) // 10, 'l': 'OBJ'}, {'s': 4 * length(text) // 5, 'e': 21 * length(text) // 25, 'l': 'OBJ'}, {'s': 22 * length(text) // 25, 'e': 9 * length(text) // 10, 'l': 'OBJ'}] AS sp FROM conversations"


@query("L9_resolved_spans", f"WITH {_resolved_sql(L9_SOURCE, 'conv_id, turn')} SELECT conv_id, turn, x.s AS span_start, x.e AS span_end, x.l AS label FROM (SELECT conv_id, turn, unnest(r) AS x FROM r)")
def l9(spark, d):
    """Non-overlapping spans of a few conflicting ones in every turn: nested, crossing and bridging."""
    n = F.length("text")
    span = lambda a, b, q, label: F.struct(F.floor(n * a / q).cast("int").alias("start"), F.floor(n * b / q).cast("int").alias("end"), F.lit(label).alias("label"))
    marks = F.array(span(0, 1, 2, "OBJ"), span(1, 2, 10, "TIME"), span(3, 7, 10, "LOC"), span(8, 9, 10, "OBJ"), span(20, 21, 25, "OBJ"), span(44, 45, 50, "OBJ"))
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(spans.resolved_spans(marks, F.col("text"))).alias("s"))
    return t.select("conv_id", "turn", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.col("s.label").alias("label"))


M17_SOURCE = f"""SELECT c.conv_id, c.turn, c.text AS t, CASE WHEN c.turn % 3 = 0 THEN [{{'s': 0::BIGINT, 'e': least(length(c.text), 9)::BIGINT, 'l': 'OBJ'}}, {{'s': 2::BIGINT, 'e': 4::BIGINT, 'l': 'TIME'}}] ELSE coalesce(f.sp, []) END AS sp FROM conversations c
LEFT JOIN (SELECT conv_id, turn, list({{'s': s, 'e': e, 'l': label}}) AS sp FROM (SELECT conv_id, turn, s, e, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'TIME' WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'LOC' WHEN length(token) > 9 THEN 'OBJ' END AS label FROM ({TOKENS})
UNION ALL SELECT conv_id, turn, (m - 1)::BIGINT, (m - 1 + 12)::BIGINT, 'OBJ' FROM (SELECT conv_id, turn, strpos(text, ' the ') AS m FROM conversations)  WHERE m > 0) WHERE label IS NOT NULL GROUP BY ALL) f ON f.conv_id = c.conv_id AND f.turn = c.turn"""


@query("M17_span_labelling", f"WITH {_resolved_sql(M17_SOURCE, 'conv_id, turn')} SELECT conv_id, turn, array_to_string(list_transform(r, lambda x: x.s || '-' || x.e || x.l), ' ') AS spans FROM r")
def m17(spark, d):
    """Canonical spans where a turn has them (every third), else those of several rule tables; free of overlap."""
    c = table(spark, d, "conversations")
    t = spans.tokens_with_offsets(c, ["conv_id", "turn"])
    label = F.when(F.col("token").rlike("^[0-9]+$"), "TIME").when(F.col("token").rlike(r"^\p{Lu}"), "LOC").when(F.length("token") > 9, "OBJ")
    cell = lambda a, b, x: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), x.alias("label"))
    found = t.withColumn("label", label).where("label IS NOT NULL").select("conv_id", "turn", cell(F.col("token_start"), F.col("token_end"), F.col("label")).alias("s"))
    at = F.locate(" the ", F.col("text"))
    found = found.unionByName(c.where(at > 0).select("conv_id", "turn", cell(at - 1, at + 11, F.lit("OBJ")).alias("s")))
    ruled = found.groupBy("conv_id", "turn").agg(F.collect_list("s").alias("ruled"))
    canonical = F.when(F.col("turn") % 3 == 0, F.array(cell(F.lit(0), F.least(F.length("text"), F.lit(9)), F.lit("OBJ")), cell(F.lit(2), F.lit(4), F.lit("TIME"))))
    both = c.join(ruled, ["conv_id", "turn"], "left").select("conv_id", "turn", "text", F.coalesce(canonical, "ruled", F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("s"))
    shown = F.transform(spans.resolved_spans(F.col("s"), F.col("text")), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), x["label"]))
    return both.select("conv_id", "turn", F.array_join(shown, " ").alias("spans"))


FIELDS = "struct<label:string,p:double>"


@query("L4_model_backend", "SELECT conv_id, turn, CASE WHEN text NOT LIKE '%.%.%.%' THEN upper(substr(text, 1, 1)) END AS label, CASE WHEN text NOT LIKE '%.%.%.%' THEN (length(text) % 10) / 10.0::DOUBLE END AS p, CASE WHEN text LIKE '%.%.%.%' THEN 'ValueError: too many sentences' END AS failure FROM conversations")
def l4(spark, d):
    """A model that fails on texts of three sentences: these rows say so, all others have its answer."""
    from pyspark.sql.types import _parse_datatype_string

    from caseloom.operators.inference import predictions

    def model(texts):
        if any(t.count(".") >= 3 for t in texts):
            raise ValueError("too many sentences")
        return [{"label": t[:1].upper(), "p": (len(t) % 10) / 10.0} for t in texts]

    out = predictions(table(spark, d, "conversations").select("conv_id", "turn", "text"), model, _parse_datatype_string(FIELDS))
    return out.select("conv_id", "turn", "prediction.label", "prediction.p", "failure")


@query("L5_embedder", "SELECT conv_id, turn, length(text) - length(replace(text, 'e', '')) AS e_count, length(text) AS n FROM conversations")
def l5(spark, d):
    from caseloom.operators.inference import embedder

    vector = embedder(lambda texts: [[float(t.count("e")), float(len(t))] for t in texts])("text")
    t = table(spark, d, "conversations").select("conv_id", "turn", vector.alias("v"))
    return t.select("conv_id", "turn", F.col("v")[0].cast("long").alias("e_count"), F.col("v")[1].cast("long").alias("n"))


@query("J5_masked_mean", """
WITH t AS (SELECT vec_id, list_transform(range(0, 4), lambda i: embedding[i * 4 + 1:i * 4 + 4]::DOUBLE[]) AS tokens, list_transform(range(0, 4), lambda i: CASE WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END) AS mask FROM embeddings),
m AS (SELECT vec_id, list_transform(range(1, 5), lambda j: list_sum(list_transform(tokens, lambda v, i: v[j] * mask[i])) / greatest(list_sum(mask), 1e-9)) AS v FROM t)
SELECT vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS first, round(v[4] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS last FROM m""")
def j5(spark, d):
    """Four token vectors of each row, of which the mask leaves some out."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)).cast("array<double>"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when((F.col("vec_id") + i) % 3 == 0, 0).otherwise(1))
    t = table(spark, d, "embeddings").select("vec_id", vectors.masked_mean(tokens, mask).alias("v"))
    return t.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[3], 6).alias("last"))
