"""Tokens with offsets, chunks, BIO runs, and span merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text as tx
from caseloom.functions.vectors import bind


def tokens_with_offsets(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, i, token, token_start, token_end): words and marks; offsets are running lengths of all pieces."""
    parts = df.select(*key, F.posexplode(tx.pieces(F.col(text))).alias("i", "token"))
    upto = F.sum(F.length("token")).over(Window.partitionBy(*key).orderBy("i"))
    placed = parts.withColumn("token_end", upto).withColumn("token_start", F.col("token_end") - F.length("token"))
    return placed.where(~F.col("token").rlike(r"^\s"))


def chunk_bounds(n: Column, most: int = 448, overlap: int = 64) -> Column:
    """array<struct(start, end)> of token windows that cover n tokens; one empty window for none."""
    step = most - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda k: F.struct((k * step).alias("start"), F.least(k * step + most, n).alias("end")))


def bio_spans(tags: DataFrame, key: list[str], order: str = "i", tag: str = "tag", start: str = "token_start", end: str = "token_end") -> DataFrame:
    """(key, label, span_start, span_end, n_tokens): runs of B-/I- tags; an I- that continues nothing begins a span."""
    w = Window.partitionBy(*key).orderBy(order)
    label = F.regexp_extract(tag, "^[BI]-(.*)$", 1)
    inside = tags.withColumn("label", label).withColumn("before", F.lag("label").over(w))
    begins = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & ~F.col("label").eqNullSafe(F.col("before")))
    runs = inside.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(w)).where(F.col("label") != "")
    return runs.groupBy(*key, "run", "label").agg(F.min(start).alias("span_start"), F.max(end).alias("span_end"), F.count(F.lit(1)).alias("n_tokens")).drop("run")


def merged_spans(spans: Column) -> Column:
    """Merge overlapping or adjacent spans of one label, in a fold over (start, longest first).

    Elements: struct(start, end, label, confidence).  Only the last merged span is
    looked at, as an interleaved span of another label ends a run.
    """
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["confidence"]).alias("low"), s["label"].alias("label")))), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label"), (-s["low"]).alias("confidence")))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce((last["label"] == s["label"]) & (s["start"] <= last["end"] + 1), F.lit(False))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"), F.greatest(last["confidence"], s["confidence"]).alias("confidence"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, step)


def overlapping(left: DataFrame, right: DataFrame, key: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs within a key whose half-open intervals overlap: an equality join with a range condition."""
    return left.join(right, key).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))


# Ranks of labels, words that may join two parts of one entity, and marks around entities.
RANK = {"TIME": 3, "LOC": 2, "OBJ": 1}
JOINING = ["", "dan", "atau", "serta", "&", "yg", "yang"]
EDGES = r"[ \t\r\n.,!?:;\"'()\[\]{}]"


def _rank(label: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(label == name, rank).otherwise(out)
    return out


def _trimmed(spans: Column, text: Column) -> Column:
    """Valid spans without the marks around them; where the text does not reach, spans stay as they are."""

    def one(s: Column) -> Column:
        inside = text.isNotNull() & (s["end"] <= F.length(text)) & (s["start"] >= 0)
        piece = F.substring(text, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0)))
        lead, tail = F.length(F.regexp_extract(piece, f"^{EDGES}*", 0)), F.length(F.regexp_extract(piece, f"{EDGES}*$", 0))
        return F.struct(F.when(inside, s["start"] + lead).otherwise(s["start"]).cast("int").alias("start"), F.when(inside, s["end"] - tail).otherwise(s["end"]).cast("int").alias("end"), s["label"].alias("label"))

    return F.filter(F.transform(spans, one), lambda s: (s["start"] >= 0) & (s["start"] < s["end"]))


def resolved_spans(spans: Column, text: Column) -> Column:
    """array<struct(start, end, label)> without overlap, by a sweep over the boundaries of the spans.

    * One label for each extent, the highest (TIME, LOC, OBJ).
    * A span goes if the spans inside it, all of its label, leave a gap that is no joining word:
      it only bridges them.
    * Of spans that cross (neither holds the other), that of higher label, then greater length, then
      earlier start stays.
    * All boundaries cut the text into segments; each belongs to the best span that covers it,
      by the same order; neighbouring segments of one span are joined, and trimmed.
    """
    known = F.coalesce(F.length(text), F.lit(-1))
    # Ordered by start, the longest first, the highest label first.
    shape = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-_rank(s["label"])).alias("low"), s["end"].alias("end"), s["label"].alias("label"))
    ordered = F.array_sort(F.transform(_trimmed(spans, text), shape))

    def single(all_: Column) -> Column:
        return F.filter(all_, lambda s, i: (i == 0) | (F.get(all_, i - 1)["start"] != s["start"]) | (F.get(all_, i - 1)["end"] != s["end"]))

    def unbridged(all_: Column) -> Column:
        def bridges(outer: Column) -> Column:
            inner = F.filter(all_, lambda s: (s["start"] >= outer["start"]) & (s["end"] <= outer["end"]) & ((s["start"] != outer["start"]) | (s["end"] != outer["end"])))

            def gap(parts: Column) -> Column:
                reach = lambda i: F.array_max(F.transform(F.slice(parts, F.lit(1), F.greatest(i, F.lit(1))), lambda s: s["end"]))
                # Position 0 has no part before it.
                wide = lambda s, i: (i > 0) & (s["start"] > reach(i)) & F.when(s["start"] <= known, (s["start"] - reach(i) > 1) & ~F.lower(F.trim(F.substring(text, reach(i) + 1, s["start"] - reach(i)))).isin(JOINING)).otherwise(s["start"] - reach(i) > 6)
                return F.exists(F.transform(parts, lambda s, i: F.coalesce(wide(s, i), F.lit(False))), lambda x: x)

            return bind(inner, lambda parts: (F.size(parts) > 1) & F.forall(parts, lambda s: s["label"] == outer["label"]) & gap(parts))

        return F.filter(all_, lambda s: ~bridges(s))

    def uncrossed(all_: Column) -> Column:
        by_rank = F.array_sort(F.transform(all_, lambda s: F.struct(s["low"].alias("low"), (s["start"] - s["end"]).alias("short"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
        cross = lambda a, b: ((a["start"] < b["start"]) & (b["start"] < a["end"]) & (a["end"] < b["end"])) | ((b["start"] < a["start"]) & (a["start"] < b["end"]) & (b["end"] < a["end"]))
        return F.aggregate(by_rank, F.slice(by_rank, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: cross(k, s)), kept).otherwise(F.concat(kept, F.array(s))))

    def swept(kept: Column) -> Column:
        def segments(bounds: Column) -> Column:
            owner = lambda a, b: F.get(F.filter(kept, lambda s: (s["start"] <= a) & (b <= s["end"])), F.lit(0))
            cells = F.transform(F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("start"), F.get(bounds, i + 1).alias("end"), owner(a, F.get(bounds, i + 1)).alias("of")))
            cells = F.filter(cells, lambda c: c["of"].isNotNull())

            def join(done: Column, c: Column) -> Column:
                last = F.try_element_at(done, F.lit(-1))
                longer = F.struct(last["start"].alias("start"), c["end"].alias("end"), last["of"].alias("of"))
                return F.when(F.coalesce((last["end"] == c["start"]) & (last["of"] == c["of"]), F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(c)))

            return bind(cells, lambda cs: F.aggregate(cs, F.slice(cs, 1, 0), join))

        bounds = F.array_sort(F.array_distinct(F.concat(F.transform(kept, lambda s: s["start"]), F.transform(kept, lambda s: s["end"]))))
        return bind(bounds, segments)

    pieces = bind(ordered, lambda o: bind(single(o), lambda a: bind(unbridged(a), lambda b: bind(uncrossed(b), swept))))
    out = _trimmed(F.transform(pieces, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["of"]["label"].alias("label"))), text)
    return F.when(spans.isNotNull(), F.coalesce(out, F.array().cast("array<struct<start:int,end:int,label:string>>")))


def labelled_words(words: DataFrame, spans: DataFrame, key: list[str], order: str = "i", word: tuple[str, str] = ("token_start", "token_end"), span: tuple[str, str] = ("start", "end"), ordinal: str = "ordinal", label: str = "label") -> DataFrame:
    """Words with ``tag``: the first span (by ordinal) that a word overlaps gives its label, B- at the first word of a span, I- after, else O.

    Words and spans of a key meet by an equality join with a range condition; each word keeps
    the least ordinal by partial aggregation.
    """
    s = spans.select(*key, F.col(span[0]).alias("_s"), F.col(span[1]).alias("_e"), F.col(ordinal).alias("_o"), F.col(label).alias("_l"))
    hit = words.select(*key, order, *word).join(s, key).where((F.greatest(F.col(word[0]), F.col("_s"))) < F.least(F.col(word[1]), F.col("_e")))
    first = hit.groupBy(*key, order).agg(F.min(F.struct("_o", "_l")).alias("_m"))
    both = words.join(first, [*key, order], "left")
    before = F.lag("_m._o").over(Window.partitionBy(*key).orderBy(order))
    tag = F.when(F.col("_m").isNull(), "O").otherwise(F.concat(F.when(F.col("_m._o").eqNullSafe(before), "I-").otherwise("B-"), F.col("_m._l")))
    return both.withColumn("tag", tag).drop("_m")


def label_ids(tags: DataFrame, ids: dict[str, int], word: tuple[str, str] = ("token_start", "token_end"), ignored: int = -100) -> DataFrame:
    """Add label_id: the id of the tag (that of O for unknown tags); tokens without width are ignored."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col("tag"))
    return tags.withColumn("label_id", F.when(F.col(word[0]) >= F.col(word[1]), ignored).otherwise(F.coalesce(known, F.lit(ids["O"]))))


def repaired(tokens: DataFrame, key: list[str], order: str, tag: str = "tag", word: str = "word", start: str = "token_start", end: str = "token_end") -> DataFrame:
    """``tag`` with B- as I- on tokens that continue a word: the word of the token before, or, without word numbers, where it ends."""
    w = Window.partitionBy(*key).orderBy(order)
    same = F.col(word).isNotNull() & (F.col(word) == F.lag(word).over(w))
    touch = F.col(word).isNull() & (F.col(start) == F.lag(end).over(w))
    goes_on = F.coalesce(same | touch, F.lit(False))
    return tokens.withColumn(tag, F.when(goes_on & F.col(tag).startswith("B-"), F.concat(F.lit("I-"), F.expr(f"substring({tag}, 3)"))).otherwise(F.col(tag)))


def joined_text(left: Column, right: Column) -> Column:
    """The text of two spans (struct start, end, text) together: where they overlap the text counts once, a gap is blanks."""
    swap = (right["start"] < left["start"]) | ((right["start"] == left["start"]) & (right["end"] > left["end"]))
    a, b = (lambda f: F.when(swap, right[f]).otherwise(left[f])), (lambda f: F.when(swap, left[f]).otherwise(right[f]))
    gap = F.greatest(b("start") - a("end"), F.lit(0))
    over = F.greatest(a("end") - b("start"), F.lit(0))
    rest = F.substring(b("text"), over + 1, F.length(b("text")))
    both = F.when(b("end") <= a("end"), a("text")).otherwise(F.concat(a("text"), F.repeat(F.lit(" "), gap), rest))
    return F.when(F.coalesce(left["text"], F.lit("")) == "", right["text"]).when(F.coalesce(right["text"], F.lit("")) == "", left["text"]).otherwise(both)


def union_text(spans: Column) -> Column:
    """The text of all spans (struct start, end, text) together, from the first to the last."""

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.least(s["start"], x["start"]).alias("start"), F.greatest(s["end"], x["end"]).alias("end"), joined_text(s, x).alias("text"))

    ordered = F.array_sort(spans)
    first = F.get(ordered, F.lit(0))
    return F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), first, step)["text"]


def placed(text: Column, values: Column) -> Column:
    """array<struct(start, end, label)>: each value (struct text, label), the longest first, at its first place that touches no used one.

    Places are tried one after another from the left; a try that is taken goes on behind it.
    """
    longest = F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct((-F.length(v["text"])).alias("short"), i.alias("i"), v["text"].alias("text"), v["label"].alias("label")))), lambda v: F.struct(v["text"].alias("text"), v["label"].alias("label")))

    def step(used: Column, v: Column) -> Column:
        n = F.length(v["text"])
        # Starts of the value, each behind the end of the one before, as a scan from the left finds them.
        parts = F.split(text, F.concat(F.lit("\\Q"), v["text"], F.lit("\\E")), -1)
        starts = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p) + n).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")))["out"]
        free = F.filter(starts, lambda a: ~F.exists(used, lambda u: (a < u["end"]) & (a + n > u["start"])))
        fits = (n > 0) & (F.size(free) > 0)
        spot = F.get(free, F.lit(0))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(used, F.array(F.struct(spot.alias("start"), (spot + n).alias("end"), v["label"].alias("label"))))).otherwise(used)

    return F.array_sort(F.aggregate(longest, F.array().cast("array<struct<start:int,end:int,label:string>>"), step))


def regex_entities(text: Column, patterns: list[tuple[str, str, float]]) -> Column:
    """array<struct(label, text, confidence)> of the matches of each pattern, in the order of the patterns."""

    def found(label: str, pattern: str, confidence: float) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(F.lit(label).alias("label"), F.trim(m).alias("text"), F.lit(confidence).alias("confidence")))

    return F.concat(*(found(*p) for p in patterns))


# Default patterns of the (Indonesian) entity rules.
PATTERNS = [
    ("LOCATION", r"\b(?:Jl\.|Jalan|Kelurahan|Kecamatan|Kabupaten|Kota|Desa|RT\s*\d+\s*/?\s*RW\s*\d+|KM\s*\d+)(?:\s+[A-Z0-9a-z\.\-]+){1,6}", 0.95),
    ("OBJECT", r"(?i)\b(?:jalan\s+berlubang|jalan\s+rusak|aspal\s+ambles|lubang\s+jalan|lampu\s+penerangan|lampu\s+jalan|tiang\s+listrik|kabel\s+menjuntai|saluran\s+drainase|gorong-gorong|trotoar\s+rusak|jembatan\s+retak|pohon\s+tumbang|tumpukan\s+sampah|pipa\s+pdam\s+bocor)\b", 0.92),
    ("TIME", r"(?i)\b(?:kemarin(?:\s+(?:pagi|siang|sore|malam))?|tadi\s+(?:pagi|siang|sore|malam)|hari\s+ini|seminggu\s+terakhir|sejak\s+\d+\s+(?:hari|minggu|bulan)\s+lalu|pukul\s+\d{1,2}[:\.]\d{2}|jam\s+\d{1,2}(?:[:\.]\d{2})?)\b", 0.90),
]
