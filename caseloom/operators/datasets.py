"""Dataset engineering: splits, leakage and contamination audits, near-duplicates."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import text as tx
from caseloom.functions.vectors import bind, unit_hash

from .keyed import components, folded, ranked
from .retrieval import small
from .shared import written
from .spans import EDGES, placed


def hash_split(family: Column, seed: int = 42, train: float = 0.7, dev: float = 0.15) -> Column:
    u = unit_hash(F.concat(F.lit(f"{seed}:"), family))
    return F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")


def split_quotas(families: DataFrame, category: str, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """(category, _q): how many families of each category go to train and dev, and a last count for test, for any number of families."""
    shares = [train, dev, 1 - train - dev]
    # Quotas grow one family at a time, by the largest deficit.  What lies two below a split's share is
    # given out in any case, so the fold starts there and takes a few steps, however many families there are.
    state = F.transform(F.array(*map(F.lit, shares)), lambda x: F.greatest(F.lit(1).cast("long"), F.floor(F.col("k") * x) - 2))
    left = F.col("k") - F.aggregate(state, F.lit(0).cast("long"), lambda a, x: a + x)
    lack = lambda s, i, k: F.round(k * shares[i] - F.get(s, F.lit(i)), 9)

    def give(s: Column, _: Column, k: Column) -> Column:
        to = F.when((lack(s, 0, k) >= lack(s, 1, k)) & (lack(s, 0, k) >= lack(s, 2, k)), 0).when(lack(s, 1, k) >= lack(s, 2, k), 1).otherwise(2)
        return F.transform(s, lambda x, i: F.when(i == to, x + 1).otherwise(x))

    counts = families.groupBy(category).agg(F.count(F.lit(1)).alias("k"))
    few = lambda *q: F.array(*(F.lit(x).cast("long") for x in q))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(12)), state, lambda s, i: F.when(i <= left, give(s, i, F.col("k"))).otherwise(s))
    quota = F.when(F.col("k") == 1, few(1, 0, 0)).when(F.col("k") == 2, few(1, 0, 1)).otherwise(grown)
    return counts.select(category, quota.alias("_q"))


def stratified_split(families: DataFrame, category: str, family: str, seed: int = 42, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """Add split: per category the families in hash order fill quotas of train, dev and test.

    One family goes to train, two to train and test; from three on each split
    gets one, and the rest goes by the largest deficit (ties: train, dev, test),
    which for the remaining k - 3 is the largest-remainder share of k.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), category, family), 256)
    # The leading digits of the hash are a number, by which large categories are ranked in ranges.
    placed = ranked(families, [category], [F.conv(F.substring(order, 1, 13), 16, 10).cast("double"), order, F.col(family)], "_at")
    quotas = split_quotas(families, category, train, dev)
    split = F.when(F.col("_at") < F.col("_q")[0], "train").when(F.col("_at") < F.col("_q")[0] + F.col("_q")[1], "dev").otherwise("test")
    return placed.join(quotas, category).withColumn("split", split).drop("_at", "_q")


def family_overlap(rows: DataFrame, family: str, split: str) -> DataFrame:
    """(left_split, right_split, family): families that two splits share."""
    seen = rows.select(F.col(family).alias("family"), F.col(split).alias("s")).distinct()
    a, b = seen.select("family", F.col("s").alias("left_split")), seen.select("family", F.col("s").alias("right_split"))
    return a.join(b, "family").where("left_split < right_split").select("left_split", "right_split", "family")


def shared_ngrams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int, text: str = "text", common: list[str] | None = None) -> DataFrame:
    """(left_key, right_key, n_shared): distinct word n-grams that two texts share, without all-common ones.

    N-grams are 64-bit keys made from shifted slices of word hashes, without strings.  The right
    side's are few (a broadcast where they are, by their count), so the left side's meet them
    as they leave the text, before any shuffle.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = df.select(F.col(key), tx.word_tokens(F.col(text)).alias("w"))
        if common:  # windows with a word outside the list
            listed = F.array(*map(F.lit, common))
            rare = F.transform("w", lambda x: ~F.array_contains(listed, x))
            keys = F.filter(F.zip_with(tx.ngram_hashes(F.col("w"), n), F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.exists(F.slice(rare, i, F.lit(n)), lambda x: x)), lambda h, ok: F.when(ok, h)), lambda h: h.isNotNull())
        else:
            keys = tx.ngram_hashes(F.col("w"), n)
        return words.select(key, F.explode(F.array_distinct(keys)).alias("g"))

    return grams(left, left_key).join(small(grams(right, right_key)), "g").groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("n_shared"))


def ngram_sets(lines: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(id, rep): the class of each text, named by its least id: texts with equal sets of word n-grams; texts without one are classes of their own."""
    sets = _sets(lines, key, text, n).select("id", F.col("h").alias("_h"))
    reps = sets.groupBy("_h").agg(F.min("id").alias("rep"))
    short = lines.select(F.col(key).alias("id")).join(sets.select("id").distinct(), "id", "left_anti")
    return sets.join(reps, "_h").select("id", "rep").unionByName(short.select("id", F.col("id").alias("rep")))


def _sets(lines: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, g, h): sorted n-gram keys of texts that have one, and a hash of the set."""
    sets = lines.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tx.ngram_hashes(tx.word_tokens(F.col(text)), n))).alias("g")).where(F.size("g") > 0)
    return sets.withColumn("h", F.sha2(F.array_join(F.transform("g", lambda x: x.cast("string")), ","), 256))


def near_duplicates(lines: DataFrame, key: str, text: str, n: int = 3, least: float = 0.85) -> DataFrame:
    """(left_id, right_id, jaccard): pairs of classes (``ngram_sets``) whose word n-gram sets reach ``least``, left_id < right_id.

    Candidates come from a prefix filter: sets are ordered by the rarity of
    their n-grams, and two sets that reach the bound share one of the first
    size - ceil(least * size) + 1, with no more than the rest behind it.  Copies are one class
    first, so no group of them is paired up; ``ngram_sets`` has the members.
    """
    classes = _sets(lines, key, text, n).groupBy("h").agg(F.min("id").alias("rep"), F.min_by("g", "id").alias("g")).select("rep", "g")
    grams = classes.select("rep", F.size("g").alias("size"), F.explode("g").alias("h"))
    rarity = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # A gram of one set alone makes no pair, but holds its place in the prefix.
    placed = grams.join(rarity, "h").withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("df", "h")))
    prefix = placed.where((F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1) & (F.col("df") > 1)).select("rep", "size", "h", "at")
    a, b = prefix.select("h", F.col("rep").alias("a"), F.col("size").alias("na"), F.col("at").alias("ia")), prefix.select("h", F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("at").alias("ib"))
    both = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    fits = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")) & (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both - F.least(F.col("ia"), F.col("ib")) + 1)
    pairs = a.join(b, "h").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    full = classes.select("rep", "g")
    sides = pairs.join(full.withColumnRenamed("rep", "a").withColumnRenamed("g", "ga"), "a").join(full.withColumnRenamed("rep", "b").withColumnRenamed("g", "gb"), "b")
    jaccard = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    between = sides.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)
    return between.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "jaccard")


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in order, by partial aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_s")).select(*key, "_s.*")


def split_hash(rows: DataFrame, split: str, ident: str, salt: str = "") -> DataFrame:
    """(split, n, split_hash): SHA-256 of the sorted ids, one for each line.

    A hash of one text is sequential: Spark sorts the ids, and they stream through it, so no
    split is held in memory.
    """

    def step(s, row):
        if s is None:
            h = hashlib.sha256(salt.encode())
            s = (h, bool(salt), 0)
        h, more, n = s
        h.update((("\n" if more else "") + row[0]).encode())
        return (h, True, n + 1), []

    text = F.col(ident).cast("string")
    return folded(rows.where(F.col(ident).isNotNull()), [split], [text], [text], lambda: None, step, "n long, split_hash string", finish=lambda s: [(s[2], s[0].hexdigest())])


# Patterns of category labels, and tokens that are no leak.
CATEGORY_LABELS = [r"(?i)\b(category|kategori)\s*[:=]\s*[a-zA-Z_]+\b", r"(?i)\b(drainage_flood|clean_water|civil_admin|health_service)\b", r"(?i)\b(drainage flood|clean water|civil admin|health service)\b", r"\b(ROAD|WASTE)\b", r"\bCategory\.[A-Z_]+\b"]


def audit_families(rows: DataFrame, scenario: str, family: str, split: str, text: str, actions: Column, missing: Column, hidden: Column, truth: Column, least: int = 20, sizes: tuple[int, ...] = (6, 7), common: list[str] = (), labels: list[str] = CATEGORY_LABELS) -> DataFrame:
    """(violation, n): the six checks of a split of scenarios, over rows of bubbles.

    * family: families in several splits;
    * action: EXECUTE with missing fields, or REQUEST_CLARIFICATION without any;
    * duplicate_text: texts of more than ``least`` characters in several splits;
    * identifier: the scenario's or a known family's id, a category label, or a key, code or
      key-value pair of ``truth`` (map) in the text;
    * ngram: word n-grams, not all of ``common`` words, in several splits;
    * hidden_fact: a hidden fact in the text, or one of its identifying tokens.

    Ids are matched as whole tokens, so texts meet the known families by equality of a token.
    """
    several = lambda by, name: by.groupBy("v").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a < b").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
    counted = lambda by, name: by.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
    families = rows.select(F.col(family).alias("v"), split)
    has = lambda a: F.array_contains(actions, a)
    wrong = (has("EXECUTE") & (F.size(missing) > 0)) | (has("REQUEST_CLARIFICATION") & (F.size(missing) == 0))
    texts = rows.where(F.length(tx.normalized(F.col(text))) > least).select(tx.text_hash(F.col(text)).alias("v"), split)
    grams = None
    for n in sizes:
        tokens = rows.select(tx.ascii_tokens(F.col(text)).alias("w"), split)
        keys = tx.ngram_hashes(F.col("w"), n)
        if common:
            listed = F.array(*map(F.lit, common))
            rare = F.transform("w", lambda x: ~F.array_contains(listed, x))
            keys = F.filter(F.zip_with(keys, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.exists(F.slice(rare, i, F.lit(n)), lambda x: x)), lambda h, ok: F.when(ok, h)), lambda h: h.isNotNull())
        one = tokens.select(F.explode(F.array_distinct(keys)).alias("v"), split)
        grams = one if grams is None else grams.union(one)
    # Identifiers.
    low = F.lower(F.col(text))
    inside = lambda what: F.array_contains("_w", F.lower(what))
    own = rows.withColumn("_w", F.array_distinct(tx.ascii_tokens(F.col(text)))).withColumn("_t", truth).withColumn("_row", F.xxhash64(scenario, text))
    label = F.lit(False)
    for p in labels:
        label = label | F.col(text).rlike(p)
    key_leak = F.exists(F.map_entries("_t"), lambda e: (e["key"].contains("_") & inside(e["key"])) | (e["value"].contains("_") & inside(e["value"])) | low.contains(F.concat(F.lower(e["key"]), F.lit(": "), F.lower(e["value"]))) | low.contains(F.concat(F.lower(e["key"]), F.lit("="), F.lower(e["value"]))))
    mine = ((F.length(scenario) >= 3) & inside(F.col(scenario))) | ((F.length(family) >= 3) & inside(F.col(family))) | label | F.coalesce(key_leak, F.lit(False)) | low.contains("world_truth")
    known = rows.select(F.lower(family).alias("_f")).where(F.length("_f") >= 5).distinct()
    cross = own.select("_row", F.lower(family).alias("_own"), F.explode("_w").alias("_f")).join(known, "_f").where("_f <> _own").select("_row").distinct()
    leaked = own.where(mine).select("_row").distinct().union(cross).distinct()
    # Hidden facts.
    told = F.filter(hidden, lambda h: F.trim(h) != "")
    tokens = lambda h: F.filter(tx.stop_worded(h), lambda w: w.rlike("[0-9]") | (F.length(w) >= 6))
    fact = F.exists(told, lambda h: low.contains(F.lower(F.trim(h))) | F.arrays_overlap(tokens(h), "_w"))
    hid = own.where(F.coalesce(fact, F.lit(False)))
    parts = [several(families, "family"), counted(rows.where(F.coalesce(wrong, F.lit(False))), "action"), several(texts, "duplicate_text"), counted(leaked, "identifier"), several(grams, "ngram"), counted(hid, "hidden_fact")]
    return reduce(DataFrame.unionByName, parts)


def held_out_audit(held: DataFrame, train: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(audit, n): held-out rows whose value is found in training, for (held value, training value) pairs."""
    out = None
    for name, (h, t) in checks.items():
        hit = held.select(h.alias("v")).join(train.select(t.alias("v")).distinct(), "v", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("audit"), "n")
        out = hit if out is None else out.unionByName(hit)
    return out


def greedy_kept(pairs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids that a greedy pass in id order keeps: an id goes if it pairs with a smaller kept one.

    What is kept of a cluster of linked ids depends on that cluster alone: components name
    the clusters, and the pairs of each stream by in order of the larger id, so the
    number of rounds does not follow the length of a chain; a fold holds the ids that a
    cluster has lost.
    """
    links = written(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), "near-pairs")
    root = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    named = links.join(root.withColumnRenamed("u", "b"), "b", "left").select(F.coalesce("root", "a").alias("root"), "a", "b")

    def step(s, row):
        lost, now, hit = s
        a, b = row
        if b != now:
            if hit:
                lost.add(now)
            now, hit = b, False
        return (lost, now, hit or a not in lost), []

    def finish(s):
        lost, now, hit = s
        return [(x,) for x in (lost | {now} if hit else lost)]

    kind = ids.schema[key].dataType.simpleString()
    gone = folded(named, ["root"], [F.col("b"), F.col("a")], [F.col("a"), F.col("b")], lambda: (set(), None, False), step, f"{key} {kind}", finish)
    return ids.select(key).join(gone.select(key), key, "left_anti")


def deduplicated_lines(lines: DataFrame, key: str, text: str, least: float = 0.85) -> DataFrame:
    """Lines (trimmed, not blank) that the greedy near-duplicate pass keeps; lines of fewer than three words stay.

    Words are split at white space.  Copies go first: the first of each class stays.
    """
    clean = lines.withColumn(text, F.trim(F.col(text))).where(F.col(text) != "")
    words = clean.select(F.col(key), F.array_join(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.md5(w)), " ").alias("_words"))
    classes = ngram_sets(words, key, "_words")
    firsts = classes.groupBy("rep").agg(F.min("id").alias(key)).select(key)
    kept = greedy_kept(near_duplicates(words, key, "_words", 3, least), firsts, key)
    return clean.join(kept, key, "left_semi")


def synthesized(topics: DataFrame, templates: dict[str, str], column: str, target: int, extra: Column, longest: int = 10, least: float = 0.85) -> DataFrame:
    """(line_no, text): topics by templates, lines of more than ``longest`` characters, without near-duplicates; topped up to ``target`` lines and freed of near-duplicates again.

    ``extra`` makes the text of a further line from the column ``i`` (from 0); as many are made as are lacking, and 50 more.
    """
    made = templated(topics, templates, column).where(F.length("text") > longest).select("text").distinct()
    numbered = zip_places(made, "text", "line_no")
    first = written(deduplicated_lines(numbered, "line_no", "text", least), "corpus")
    have = first.count()
    if have >= target:
        return first
    more = topics.sparkSession.range(target - have + 50).select((F.col("id") + (1 << 40)).alias("line_no"), F.col("id").alias("i")).select("line_no", extra.alias("text"))
    return deduplicated_lines(first.select("line_no", "text").unionByName(more), "line_no", "text", least)


def zip_places(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add a number to each row, in the order of a hash of the column; no table is ordered in one task."""
    h = F.xxhash64(column)
    return ranked(rows.withColumn("_one", F.lit(0)), ["_one"], [h, F.col(column)], name).drop("_one")


def templated(dimension: DataFrame, templates: dict[str, str], column: str) -> DataFrame:
    """Every row of ``dimension`` with every template: (columns, template, text); ``{x}`` takes the column's value."""
    cells = F.array(*(F.struct(F.lit(k).alias("template"), F.replace(F.lit(t), F.lit("{x}"), F.col(column)).alias("text")) for k, t in templates.items()))
    return dimension.withColumn("s", F.explode(cells)).select(*dimension.columns, "s.*")


def longest_alias(text: Column, aliases: list[str]) -> Column:
    """The longest alias that stands in the text between non-word characters; the first in order on ties; null for none."""
    if not aliases:
        return F.lit(None).cast("string")
    ordered = sorted(aliases, key=lambda a: (-len(a), a))
    return F.coalesce(*(F.when(text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){tx.quoted(a)}(?![\p{{L}}\p{{N}}_])"), F.lit(a)) for a in ordered))


# Words that end a clause, and words that a noun phrase of an object does not hold.
CLAUSE_ENDS = r"(?i)\b(?:di|ke|dari|dalam|pada|tanpa|saat|ketika|karena|sehingga|akibat|untuk|oleh|dan|atau|serta|tetapi|namun|tidak\s+berada|tidak\s+diangkat|tidak\s+diangkut|gak\s+diangkut|tertunda|terhenti\s+total|terhenti|mati\s+total|pecah|rusak|hilang|habis|membludak|eror|menumpuk|meluber|menimbulkan|tersumbat|retak|mampet|ambles|amblas|ambrol|berbau\s+busuk|berbau\s+karat|tanpa\s+pemberitahuan|padam\s+total|menyebabkan|menghalangi|membahayakan|mengakibatkan|kosong\s+tandas|terbengkalai|keterlambatan|belum\s+hadir)\b|[,;.:]"
NEGATIONS = ["tidak", "bukan", "belum", "sangat", "amat", "tolong", "mohon"]


def object_candidates(text: Column, issue: Column, fact: Column, rules: dict[str, list[str]], not_objects: list[str], ends: str = CLAUSE_ENDS, times: str | None = None, objects: str | None = None, negations: list[str] = NEGATIONS, most: int = 4) -> Column:
    """array<string>: compact noun phrases for the object of a complaint that the text holds, each once, in order.

    First the longest alias that the rule of ``fact`` (a value of the world's truth) finds in the text; then
    what the pattern ``objects`` finds in the issue; then the issue's clauses of one to ``most``
    words (three characters) that are no time and hold no word of ``not_objects`` or of negation,
    or what ``objects`` finds in them.  All must stand in the text between non-word characters.
    """
    edge = EDGES
    bare = lambda c: F.regexp_replace(c, f"^{edge}+|{edge}+$", "")
    none = F.array().cast("array<string>")
    low = F.lower(text)
    by_rule = F.coalesce(*(F.when(fact == value, longest_alias(low, aliases)) for value, aliases in rules.items())) if rules else F.lit(None).cast("string")
    named = F.regexp_extract_all(issue, F.lit(objects), 0) if objects else none
    parts = F.filter(F.transform(F.split(issue, ends), bare), lambda c: (F.length(c) >= 3) & (F.size(F.split(c, r"\s+")) <= most))
    if times:
        parts = F.filter(parts, lambda c: ~c.rlike(f"^(?:{times})$"))
    barred = F.array(*map(F.lit, [*not_objects, *negations])).cast("array<string>")
    plain = lambda c: F.when(F.arrays_overlap(F.split(F.lower(c), r"\s+"), barred), none).otherwise(F.array(c))
    if objects:
        chosen = F.transform(parts, lambda c: F.when(F.size(F.regexp_extract_all(c, F.lit(objects), 0)) > 0, F.regexp_extract_all(c, F.lit(objects), 0)).otherwise(plain(c)))
    else:
        chosen = F.transform(parts, plain)
    found = F.transform(F.concat(F.array_compact(F.array(by_rule)), named, F.flatten(chosen)), bare)
    found = F.filter(found, lambda c: (c != "") & F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower(c), F.lit(r"\E(?![\p{L}\p{N}_])"))))
    return bind(found, lambda f: F.filter(f, lambda c, i: ~F.exists(F.slice(f, F.lit(1), i.cast("int")), lambda d: F.lower(d) == F.lower(c))))


def synonyms(text: Column, words: dict[str, str]) -> Column:
    """Words of letters replaced by the table (lower case), all else as it is."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    parts = F.regexp_extract_all(text, F.lit(r"[a-zA-Z]+|[^a-zA-Z]+"), 0)
    whole = lambda i: ~F.coalesce(F.get(parts, i - 1).rlike(r"[\p{L}\p{N}_]$"), F.lit(False)) & ~F.coalesce(F.get(parts, i + 1).rlike(r"^[\p{L}\p{N}_]"), F.lit(False))
    return F.array_join(F.transform(parts, lambda w, i: F.coalesce(F.when(whole(i), F.try_element_at(table, F.lower(w))), w)), "")


def constituents(text: Column, breaks: list[str], most: int = 3) -> Column:
    """array<string>: a text in chunks: a break word begins one, ``most`` words without a break word at the end fill one; a last single word joins the chunk before.

    ``a/b`` is read as `a atau b`, dashes as blanks.
    """
    norm = F.trim(F.regexp_replace(F.replace(F.regexp_replace(text, r"(\w+)/(\w+)", "$1 atau $2"), F.lit("-"), F.lit(" ")), r"\s+", " "))
    words = F.filter(F.split(norm, " "), lambda w: w != "")
    listed = F.array(*map(F.lit, breaks)).cast("array<string>")
    is_break = lambda w: F.array_contains(listed, F.lower(w))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"))

    def step(s: Column, w: Column) -> Column:
        cut = is_break(w) & (F.size(s["now"]) > 0)
        grown = F.concat(s["now"], F.array(w))
        full = (F.size(grown) >= most) & ~is_break(w)
        done = F.when(cut, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).when(full, F.concat(s["done"], F.array(F.array_join(grown, " ")))).otherwise(s["done"])
        now = F.when(cut, F.array(w)).when(full, none).otherwise(grown)
        return F.struct(done.alias("done"), now.alias("now"))

    def finish(s: Column) -> Column:
        last = F.array_join(s["now"], " ")
        joins = (F.size(s["done"]) > 0) & (F.size(s["now"]) == 1) & ~is_break(F.get(s["now"], F.lit(0)))
        ends = F.concat(F.slice(s["done"], F.lit(1), F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(s["done"], F.lit(-1)), last)))
        return F.when(F.size(s["now"]) == 0, s["done"]).when(joins, ends).otherwise(F.concat(s["done"], F.array(last)))

    return F.aggregate(words, start, step, finish)


def paraphrased(chunks: Column, split: str) -> Column:
    """The sentence that a split makes of an issue's chunks: its own opening, order, joints and end."""
    # Opening, end, the joint of two chunks, the further joints, and how far the chunks are turned.
    opening, end, two, first, second, rest, turn = {
        "train": ("masalah", "di kawasan lingkungan", " dan ", " dan ", " serta ", " dan ", 0),
        "dev": ("kendala", "di lokasi sekitar", " terkait ", " terkait ", " sehubungan ", " terkait ", 1),
        "test": ("persoalan", "di area kawasan", " perihal ", " perihal ", " mengenai ", " perihal ", 2),
        "ood": ("gangguan", "di wilayah setempat", " dalam hal ", " dalam hal ", " pada ", " dan ", 0),
    }[split]
    n = F.size(chunks)
    at = lambda c, i: F.get(c, F.lit(i))
    if split == "ood":
        order, pair, alone = F.reverse(chunks), (1, 0), F.concat(F.lit("mengenai "), at(chunks, 0))
    else:
        order, pair, alone = F.concat(F.slice(chunks, F.lit(turn + 1), F.greatest(n - turn, F.lit(0))), F.slice(chunks, 1, turn)), ((1, 0) if split == "dev" else (0, 1)), at(chunks, 0)
    body = F.when(n >= 3, F.concat(at(order, 0), F.lit(first), at(order, 1), F.lit(second), F.array_join(F.slice(order, F.lit(3), F.greatest(n - 2, F.lit(0))), rest))).when(n == 2, F.concat(at(chunks, pair[0]), F.lit(two), at(chunks, pair[1]))).otherwise(alone)
    return F.concat_ws(" ", F.lit(opening), body, F.lit(end))


# Personas, noise levels, and the sentences of a persona.
PERSONAS = {
    "STANDARD": ("Lapor: ", "Titik patokannya di ", ", mohon bantuan unit terkait", "Laporan: ", "Lokasi berada di ", ""),
    "FORMAL": ("Yth petugas kami laporkan: ", "Keterangan patokan lokasi yaitu di ", "", "Yth petugas kami laporkan: ", "Keterangan patokan lokasi yaitu di ", ""),
    "FRUSTRATED_RAMBLING": ("Laporan sangat mendesak: ", "Kondisi parah patokan di ", " segera ditangani", "Laporan sangat mendesak: ", "Kondisi parah patokan di ", " segera ditangani"),
    "PANICKED": ("Darurat berbahaya: ", "Lokasi patokan persis di ", " tolong cepat", "Darurat berbahaya: ", "Lokasi patokan persis di ", " tolong cepat"),
}
NOISES = ["LOW", "MEDIUM", "HIGH"]


def trajectories(templates: DataFrame, scenarios: int, seed: int = 42, multi_turn: float = 0.5, words: dict[str, str] = tx.SLANG) -> DataFrame:
    """Bubbles (scenario_id, family_id, category, split, persona, noise, turn, message_id, text, offset_seconds, action, missing) of generated scenarios.

    ``templates``: family_id, category, landmark, issue, jurisdiction, city; a short dimension, of which
    scenario i takes the (i + seed)-th, in order of the family.  Persona, noise and the number of turns
    follow from i in the same way.  Noise shortens words, then swaps letters, but for names of places.
    """
    split = stratified_split(templates.select("category", "family_id"), "category", "family_id", seed).select("family_id", "split")
    order = F.conv(F.substring(F.sha2("family_id", 256), 1, 13), 16, 10).cast("double")
    n = templates.count()
    numbered = ranked(templates.withColumn("_one", F.lit(0)), ["_one"], [order, F.col("family_id")], "_at").drop("_one").join(split, "family_id")
    i = F.col("id") + seed
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    s = templates.sparkSession.range(scenarios).select("id", (i % max(n, 1)).alias("_at"), pick(list(PERSONAS)).alias("persona"), pick(NOISES).alias("noise"), ((i % 100) < int(multi_turn * 100)).alias("multi"))
    s = s.join(numbered, "_at").withColumn("scenario_id", F.format_string("sc-%s-%04d", "family_id", F.col("id") + 1))
    places = F.transform(F.split(F.concat_ws(" ", "landmark", "jurisdiction", "city"), r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"^[.,!?:;]+|[.,!?:;]+$", ""))
    table = F.create_map(*(F.lit(x) for k, v in PERSONAS.items() for x in (k, "\n".join(v))))
    said = F.split(F.element_at(table, F.col("persona")), "\n")
    part = lambda k, m: F.when(F.col("multi"), said[k]).otherwise(said[m])
    whole = F.concat_ws(", ", F.concat(F.lit("wilayah "), "jurisdiction"), "city")
    one = F.concat(part(0, 3), F.col("issue"))
    two = F.concat(part(1, 4), F.col("landmark"), F.when(F.col("multi"), F.lit("")).otherwise(F.concat(F.lit(", "), whole)), part(2, 5))

    def noisy(t: Column, shift: int) -> Column:
        short = F.when(F.col("noise").isin("MEDIUM", "HIGH"), tx.slang(t, words, places)).otherwise(t)
        return F.when(F.col("noise") == "HIGH", tx.typos(short, (F.col("id") + seed + shift).cast("int"), places)).otherwise(short)

    ask = F.when(F.col("multi"), "REQUEST_CLARIFICATION").otherwise("EXECUTE")
    lack = F.when(F.col("multi"), "jurisdiction").otherwise("")
    cell = lambda turn, no, text, offset, action, missing: F.struct(F.lit(turn).alias("turn"), F.concat(F.col("scenario_id"), F.lit(f"-t{turn}-b{no}")).alias("message_id"), text.alias("text"), offset.alias("offset_seconds"), action.alias("action"), missing.alias("missing"))
    last = cell(2, 1, F.concat(F.lit("Untuk wilayah administrasinya berada di "), F.concat_ws(", ", "jurisdiction", "city")), F.lit(0), F.lit("EXECUTE"), F.lit(""))
    bubbles = F.array(cell(1, 1, noisy(one, 0), F.lit(0), ask, lack), cell(1, 2, noisy(two, 1), F.when(F.col("multi"), 2).otherwise(3), ask, lack))
    bubbles = F.when(F.col("multi"), F.concat(bubbles, F.array(last))).otherwise(bubbles)
    return s.select("scenario_id", "family_id", "category", "split", "persona", "noise", F.explode(bubbles).alias("b")).select("scenario_id", "family_id", "category", "split", "persona", "noise", "b.*")


# Provenances, and what claims to be human or real.
INDEPENDENT = "synthetic_independent"
INTERNAL = ["hifi_synthetic", "synthetic_internal", "internal_proxy_synthetic"]
HUMAN = ["human", "human_written", "human_gold", "real", "real_world", "real_user"]


def strict_records(lines: DataFrame, file: str, line: str, value: str, heads: dict[str, tuple[list[str], str]], expected: str = INDEPENDENT, internal: list[str] = INTERNAL, human: list[str] = HUMAN) -> DataFrame:
    """(file, line, reject, text, and a column for each head): records of held-out JSON lines; ``reject`` names what bars one, else null.

    Blank lines go.  A line with _type (or type) `metadata` is a header: its provenance holds for the lines behind
    it.  A record's provenance is its own, that of its world truth, of its metadata, or of
    the header.  ``heads``: for each head its classes and the default for unknown ones.  Texts are the
    joined bubbles of turns, or the text field.
    """
    v = F.col(value)
    get = lambda *paths: F.coalesce(*(F.get_json_object(v, f"$.{p}") for p in paths))
    rows = lines.where(F.trim(value) != "").select(F.col(file), F.col(line), v.alias(value), (F.try_parse_json(v).isNotNull() & F.trim(v).startswith("{")).alias("_object"))
    is_head = F.col("_object") & (F.coalesce(get("_type", "type"), F.lit("")) == "metadata")
    # Headers are few: those of a file travel as one list.
    headers = rows.where(is_head).select(F.col(file).alias("_f"), F.struct(F.col(line).alias("line"), get("provenance").alias("p")).alias("h")).groupBy("_f").agg(F.array_sort(F.collect_list("h")).alias("_heads"))
    both = rows.where(~is_head).join(headers, F.col(file) == F.col("_f"), "left")
    above = F.try_element_at(F.filter("_heads", lambda h: (h["line"] < F.col(line)) & h["p"].isNotNull()), F.lit(-1))["p"]
    source = F.coalesce(get("provenance", "world_truth.provenance", "metadata.provenance"), above)
    claims = F.lit(False)
    for k in ("human_written", "is_human_written", "real_world", "is_real_world"):
        claims = claims | F.coalesce(get(k) == "true", F.lit(False))
    bubbles = F.flatten(F.transform(F.from_json(get("turns"), "array<struct<bubbles:array<struct<text:string>>>>"), lambda t: F.coalesce(t["bubbles"], F.array().cast("array<struct<text:string>>"))))
    joined = F.array_join(F.filter(F.transform(bubbles, lambda b: F.trim(b["text"])), lambda t: t != ""), "\n")
    text = F.when(get("turns").isNotNull(), joined).otherwise(F.trim(get("text")))
    reject = (
        F.when(~F.col("_object"), "invalid_json")
        .when(claims | F.coalesce(source.isin(human), F.lit(False)), "human_claim")
        .when(source.isNull() | (source == ""), "missing_provenance")
        .when(source.isin(internal), "internal_provenance")
        .when(source != expected, "invalid_provenance")
        .when(get("turns").isNull() & get("text").isNull(), "unrecognized")
    )
    head = lambda name, classes, default: F.when(get(f"world_truth.{name}", name).isin(classes), get(f"world_truth.{name}", name)).otherwise(default)
    return both.select(file, line, reject.alias("reject"), F.when(F.col("_object"), text).alias("text"), *(F.when(F.col("_object"), head(k, c, d)).alias(k) for k, (c, d) in heads.items()))


def modular_records(rows: DataFrame, family: Column, variant: Column, issue: Column, places: list[str], area: Column, openings: list[str], intents: list[str], risks: list[str], times: list[str], completeness: list[str]) -> DataFrame:
    """Rows with text, completeness, action, missing and spans (``placed``): parts are taken from pools by indices modulo their size."""
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    street, full = pick(places, family * 7 + variant), pick(completeness, variant)
    place = F.when(full == "SUFFICIENT", F.concat_ws(", ", street, area)).when(full == "INCOMPLETE", area).otherwise(F.concat(street, F.lit(" (patokannya belum jelas)")))
    at = pick(times, family + variant * 2)
    text = F.concat(pick(openings, family + variant), F.lit(", "), pick(intents, family + variant), F.lit(". Ada "), issue, F.lit(" di "), place, F.lit(". Terlihat "), at, F.lit(". Kondisinya "), pick(risks, variant), F.lit("."))
    cell = lambda v, label: F.struct(v.alias("text"), F.lit(label).alias("label"))
    parts = F.when(full == "SUFFICIENT", F.array(cell(street, "LOC"), cell(area, "LOC"))).when(full == "INCOMPLETE", F.array(cell(area, "LOC"))).otherwise(F.array(cell(street, "LOC")))
    action = F.when(full == "SUFFICIENT", "EXECUTE").when(full == "INCOMPLETE", "REQUEST_CLARIFICATION").otherwise("RE_EVALUATE")
    missing = F.when(full == "SUFFICIENT", "").when(full == "INCOMPLETE", "location_detail").otherwise("ambiguous_context")
    made = rows.select("*", text.alias("text"), full.alias("completeness"), action.alias("action"), missing.alias("missing"), F.concat(F.array(cell(issue, "OBJ")), parts, F.array(cell(at, "TIME"))).alias("_values"))
    return made.withColumn("spans", placed(F.col("text"), F.col("_values"))).drop("_values")


def threshold(name: Column, explicit: Column, overrides: Column, config: Column, default: dict[str, float]) -> Column:
    """The threshold of a metric: the explicit field, the override map, the JSON config's target_metric_thresholds, the default; null for none."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in default.items() for x in kv)), name)
    configured = F.try_element_at(F.from_json(F.get_json_object(config, "$.target_metric_thresholds"), "map<string,double>"), name)
    return F.coalesce(explicit, F.try_element_at(overrides, name), configured, known)


def valid_spans(spans: Column) -> Column:
    """Normalised spans struct(start, end, label): B-/I- prefixes go, invalid ones are dropped."""
    clean = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["label"], "^[BI]-", "").alias("label")))
    return F.filter(clean, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["label"] != ""))
