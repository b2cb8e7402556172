import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import bpe, decontaminate, fm, langid, licenses, outliers, queries, records, sharding, simhash, store, warc

from .cases import WORDS, empty, frame, prose
from .test_text_kernels import RANKS, brute_fingerprint, reference


def key(row):
    return tuple((x is not None, x) for x in row)


def test_op1_licenses(spark):
    apache = licenses.TEMPLATES["apache-2.0-notice"]
    rows = [(1, "x y z " + apache + " tail"), (2, apache.replace("express", "any") + " " + apache), (3, "licensed under the law of the land"), (4, None), (5, ""), (6, prose(3, 20_000) + "\nReleased under the MIT License.\n" + prose(4, 9)), (6, "all RIGHTS (reserved)")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license")
    got = Counter((r.doc_id, r.license, round(r.coverage, 2)) for r in licenses.scan(df).collect())
    assert got == {(1, "apache-2.0-notice", 1.0): 1, (2, "apache-2.0-notice", 0.99): 1, (2, "apache-2.0-notice", 1.0): 1, (6, "mit", 1.0): 1, (6, "all-rights-reserved", 1.0): 1}
    assert licenses.scan(empty(spark)).count() == 0


def test_op2_round_trip(spark):
    df, enc = frame(spark), reference()
    want = []
    for r in df.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(df, RANKS).collect()), key=key) == sorted(want, key=key)
    coded = bpe.encode(df, RANKS)
    assert coded.columns[-1] == "ids_" and len(coded.columns) == len(df.columns) + 1
    back = bpe.decode(coded, RANKS, ids="ids_").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.round_trip(empty(spark), RANKS).count() == 0


def test_op3_shards(spark):
    rows = frame(spark)
    got = sharding.shards(rows, bins=4).collect()
    assert len(got) == rows.count() and {r.law for r in got} == {"bytes"}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (5, 6)}) == 1
    want = Counter((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows.collect())
    assert Counter((r["size"], r.text_crc32) for r in got) == want
    assert sharding.shards(empty(spark)).count() == 0


def test_best_fit_decreasing_is_the_plain_one():
    classes = [(7, 5), (5, 9), (3, 11), (2, 4), (1, 6)]

    def plain(capacity):
        left = []
        for size, n in classes:
            for _ in range(n):
                fits = [(c, b) for b, c in enumerate(left) if c >= size]
                if fits:
                    left[min(fits)[1]] -= size
                else:
                    left.append(capacity - size)
        return sorted(left)

    for capacity in (7, 10, 13, 40):
        used = Counter()
        for size, b, n in sharding.pack(classes, capacity):
            used[b] += size * n
        assert sorted(capacity - u for u in used.values()) == plain(capacity)
    with pytest.raises(ValueError):
        sharding.pack([(8, 1)], 7)


def _filled(classes, bins):
    used = Counter()
    for size, b, n in sharding.level(classes, bins):
        used[b] += size * n
    assert Counter({s: sum(n for x, _, n in sharding.level(classes, bins) if x == s) for s, _ in classes}) == Counter(dict(classes))
    return sorted((used[b] for b in range(bins)), reverse=True)


def test_op3_shards_are_level_beside_a_large_group(spark):
    top, *rest = _filled([(50_000, 1), (10, 5_000), (7, 3_000), (3, 9_000)], 16)
    assert top == 50_000 and min(rest) >= 0.98 * max(rest)
    first, second, *rest = _filled([(60_000, 1), (20_000, 1), (100, 800)], 16)
    assert (first, second) == (60_000, 20_000) and min(rest) >= 0.98 * max(rest)
    assert _filled([(1, 17)], 16) == [2] + [1] * 15
    assert _filled([(5, 3)], 16) == [5] * 3 + [0] * 13
    rows = [(i, "copy " * 40) for i in range(100)] + [(i, f"{i:0100d}") for i in range(100, 500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), bins=16).groupBy("shard").sum("size").collect()
    top, *rest = sorted((r["sum(size)"] for r in got), reverse=True)
    assert len(got) == 16 and top == 100 * 201 and min(rest) >= 0.9 * max(rest)


def test_op4_records(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    marked = [(k, t, None, None, 1, "", "", "", "") for k, t in ((70, "a<|endoftext|>b"), (71, "<|endoftext|><|endoftext|> x"), (-(1 << 62), "far"), ((1 << 63) - 1, "farthest"))]
    df = frame(spark).union(spark.createDataFrame(marked, frame(spark).schema))
    t = Tokenizer.from_file(path)  # untouched
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, len(r.text or "")))
    want, start = [], 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    folder = store.new_folder(spark, "records-test")
    manifest = records.write_records(df, folder, path, roll=1 << 16)
    assert manifest.count() > 1  # the long text rolls the file
    assert sorted(map(tuple, records.read_records(manifest, folder).collect()), key=lambda x: x[1]) == want
    first = manifest.orderBy("shard", "seq").first()
    at, ids = records.read_one(folder, first.file, 2)
    assert at == 0 and ids.tolist() == [0]  # after the row without a key and the least key
    assert records.token_records(empty(spark), path).count() == 0


def test_op5_leaks(spark):
    items = [(1, prose(10, 30)), (2, prose(11, 12)), (3, "too short"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = items[0][1].split()
    edited = " ".join(w for i, w in enumerate(words) if i % 7 != 3)  # 4 of 30 deleted
    far = " ".join(w if i % 2 else "other" for i, w in enumerate(words))
    rows = [(1, prose(5, 400) + " " + items[0][1].upper() + " " + prose(6, 10)), (2, edited), (3, far), (4, None), (5, ""), (6, prose(12, 25_000) + " " + items[1][1]), (6, "x")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == {(1, 1, 0), (2, 1, 4), (6, 2, 0)}
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(frame(spark), bench.limit(0)).count() == 0


def test_op5_recall_at_the_bound():
    import random

    r = random.Random(9)
    items = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(r.randint(15, 50))) for _ in range(60)]
    bench = decontaminate.Items(list(range(60)), items, 0.8)
    found = total = 0
    for i, text in enumerate(items):
        for _ in range(5):
            words = text.split()
            for _ in range(int(0.2 * len(words))):
                k, kind = r.randrange(len(words)), r.randrange(3)
                words[k : k + 1] = [] if kind == 0 else ["new"] if kind == 1 else [words[k], "new"]
            import pyarrow as pa

            hits = bench.matches(*decontaminate._words(pa.array([prose(i, 40) + " " + " ".join(words) + " " + prose(i + 1, 40)])))
            found, total = found + any(h[1] == i for h in hits), total + 1
    assert found / total >= 0.995


def test_op5_finds_every_long_leak_at_the_bound():
    import random

    import pyarrow as pa

    r = random.Random(4)
    items = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(n)) for n in (100, 150, 200, 300) for _ in range(25)]
    bench = decontaminate.Items(list(range(len(items))), items, 0.8)
    texts = []
    for i, text in enumerate(items):
        words = text.split()
        # Edits at distinct words, an equal number apart: as many as the budget allows.
        for k in range(len(words) - 3, 0, -5):
            words[k : k + 1] = [[], ["new"], [words[k], "new"]][r.randrange(3)]
        texts.append(prose(i, 40) + " " + " ".join(words) + " " + prose(i + 1, 40))
    hits = bench.matches(*decontaminate._words(pa.array(texts)))
    assert {(h[0], h[1]) for h in hits} == {(i, i) for i in range(len(items))}
    assert all(h[2] <= len(items[h[1]].split()) // 5 and h[3] < h[4] for h in hits)


@pytest.mark.parametrize("few", [10_000, 0])
def test_op6_statistics_and_verdicts(spark, monkeypatch, few):
    monkeypatch.setattr(outliers, "FEW_GROUPS", few)
    import re

    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 120)) + f" u{i}", "en", "a") for i in range(300)]
    rows += [(300, " ".join(w + "%%%" for w in prose(1, 120).split()), "en", "a"), (301, "a b c d e f g h i j k\n" * 4, None, None), (302, None, "en", None), (303, "", None, "a"), (304, prose(5, 20_000), "en", "a"), (0, rows[0][1], "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS grp", "3 AS x0")
    got = {(r.doc_id, r.n_words): r for r in outliers.quality(df).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if c[g] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if x.strip()]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    verdict = {i: r.kept for (i, _), r in got.items()}
    assert not any(verdict[i] for i in (300, 301, 302, 303))
    assert all(verdict[i] for i in range(300))
    assert outliers.quality(empty(spark)).count() == 0


def test_op6_rejects_for_repeated_lines_alone(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 120)) + f" u{i}", "en", "a") for i in range(300)]
    lines = [x for k in range(40) for x in (f"line{k} of{k} its{k} own{k}", "again")]
    rows += [(300, "\n".join(lines), "en", "a"), (301, "\n".join(x for x in lines if x != "again"), "en", "a")]
    got = {r.doc_id: r for r in outliers.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[300].n_dup_lines, got[300].n_repeat_words, got[300].base_failed, got[300].kept) == (39, 0, False, False)
    assert got[301].kept and all(got[i].kept for i in range(300))
    bounds = [math.log1p(100) / outliers.FLOORS[3], math.log1p(20) / outliers.FLOORS[4]]
    assert all(b * b > outliers.chi_square_at(1 - 1e-6, 5) for b in bounds)


def test_chi_square():
    assert outliers.chi_square(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert outliers.chi_square_at(0.5, 5) == pytest.approx(4.35146, abs=1e-4)


def test_op7_language(spark):
    en, fr = "the house of the king and his sons ", "la maison du roi et de ses fils "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr", f"h{i % 3}") for i in range(60)] + [(90, None, None, None), (91, "", "en", None), (92, "12 34 !!", None, "h0"), (93, "中文字 " * 40, None, "h0"), (94, en * 4000, None, None), (1, en * 3, "en", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS _row", "3 AS ll")
    out = langid.identify(df.withColumn("domain", df.source.substr(1, 1)), langid.fit(df), host="source", domain="domain")
    got = {r.doc_id: (r.language, r.kept_) for r in out.collect()}
    assert all(got[i] == ("en" if i % 2 else "fr", True) for i in range(60))
    assert got[94] == ("en", True) and all(got[i] == ("und", False) for i in (90, 91, 92, 93))
    assert out.count() == len(rows)
    assert langid.identify(empty(spark), langid.fit(empty(spark)), host="source").count() == 0


def test_op7_declared_language_decides_short_texts(spark):
    assert spark.range(1).select(langid.declared_language(langid.F.lit("<html class=a lang='FR-be'>")), langid.host_of(langid.F.lit("https://u@A.Example.org:80/x"))).first()[:] == ("fr", "a.example.org")


def test_op8_classifier(spark):
    rows = [(i, prose(i, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 80).split()), 5 if i % 4 else None) for i in range(400)] + [(900, None, None), (901, "", 0), (902, prose(7, 30_000), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 AS _k", "2 AS score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    machine = fm.fit(docs, labels.where(~fm.held_out()))
    got = {r.doc_id: r.s for r in fm.score(docs, machine, out="s").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= got[i] <= 1 for i in (900, 901, 902))
    assert fm.keep(docs, machine).columns == docs.columns
    assert fm.score(empty(spark).drop("score"), fm.fit(empty(spark), labels)).count() == 0


def test_op8_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = fm.Machine(0.3, rng.normal(size=(fm.WORDS + 2 * fm.LEVELS, 1 + fm.FACTORS)).astype(np.float32))
    word, x, structure = np.array([3, 9, 4]), np.array([0.5, 0.5, 1.0], np.float32), np.array([[fm.WORDS, fm.WORDS + 30]] * 2)
    raw, _ = m.raw(word, np.array([0, 2, 3]), x, structure)
    for row, (ids, values) in enumerate([([3, 9, *structure[0]], [0.5, 0.5, 1, 1]), ([4, *structure[1]], [1, 1, 1])]):
        v = m.table[ids, 1:].astype(float)
        pairs = sum(v[i] @ v[j] * values[i] * values[j] for i in range(len(ids)) for j in range(i))
        assert raw[row] == pytest.approx(0.3 + m.table[ids, 0] @ values + pairs, rel=1e-4)


def test_op1_tells_versions_and_names_apart():
    import pyarrow as pa

    known = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE)

    def found(text):
        return {known.names[m[1]] for m in known.matches(*licenses.words(pa.array([text])))}

    want = {
        "Released under the BSD License.": {"bsd"},
        "This work is licensed under the GNU General Public License, version 2.": {"gpl-2.0"},
        "GNU General Public License, version 2": set(),
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "Licensed under CC BY-ND 4.0.": {"cc-by-nd-4.0"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa-4.0"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": set(),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
        "Licensed under the Apache License, Version 2.1.": set(),
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "released under the old license of the town council": set(),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 License": {"cc-by-sa-3.0-notice"},
    }
    assert {t: found(t) for t in want} == want
    plain = {n: re.sub(r"[{}]", "", t) for n, t in licenses.TEMPLATES.items()}
    assert {n: found(t) for n, t in plain.items()} == {n: {n} for n in plain}


def test_op5_equals_brute_force_through_the_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id, r.edits) for r in queries.op5_decontamination(spark, sf).collect()}
    words = lambda t: re.findall(r"(?:[0-9a-z\x00-\x08\x0e-\x1f\x7f]|[^\x00-\x7f])+", (t or "").lower())
    items = [(r.item_id, words(r.text)) for r in store.table(spark, sf, "benchmark").collect()]
    want = set()
    for r in store.table(spark, sf, "documents").collect():
        text = words(r.text)
        for i, w in items:
            d = decontaminate.edits(w, text)[0]
            if d <= math.floor(0.2 * len(w) + 1e-9):
                want.add((r.doc_id, i, d))
    assert got == want and want


def test_op5_items_of_few_words_and_repeated_items(spark):
    bench = spark.createDataFrame([(1, "Two Words"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "..."), (4, None), (None, "one")], "item_id long, text string").selectExpr("*", "1 AS edits")
    docs = spark.createDataFrame([(7, "so two, words!"), (8, "two other words"), (9, "x a b c X d e f"), (10, "one"), (None, "two words")], "doc_id long, text string").selectExpr("*", "2 AS edits")
    got = Counter(map(tuple, decontaminate.leaks(docs, bench).select("doc_id", "item_id", "edits").collect()))
    assert got == {(7, 1, 0): 1, (9, 1, 1): 1, (9, 2, 1): 1, (10, None, 0): 1, (None, 1, 0): 1}


def test_op6_texts_that_begin_or_end_in_f_or_form_feed(spark):
    texts = ["f", "\f a b c", "for one two three four mid for one two three four", "cor one two three four mid cor one two three four", "\f\f", "a f", "nbsp\u00a0x\u2003y \x1f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in outliers.statistics(df).collect()}
    assert got == {0: (1, 1, 0), 1: (3, 3, 0), 2: (11, 39, 10), 3: (11, 39, 10), 4: (0, 0, 0), 5: (2, 2, 0), 6: (2, 9, 0)}


def test_op9_archives(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i % 4}</html>" * (1 + i % 4)) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "http://long/", "x" * 300_000), (3, "http://h/3", rows3 := "<html>3</html>" * 4), (None, "http://none/", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS shard")
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    want = sorted(((i, len(h or ""), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i is None or best[h or ""] == i else ("revisit", best[h or ""]))) for i, _, h in rows), key=key)
    folder = store.new_folder(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, roll=400)
    assert manifest.count() > 3
    got = warc.read_archives(manifest, folder).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=key) == want and rows3
    again = warc.write_archives(pages.repartition(7), store.new_folder(spark, "warc-test"), roll=400)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))  # names carry digests
    assert warc.archived(pages.limit(0)).count() == 0


def test_op9_record_ids_are_unique_and_addresses_stay(spark):
    rows = [(1, "http://a/x  y", "same"), (1, "http://a/x  y", "same"), (1, "http://a/x  y", "other"), (2, "http://a/é%20z", "same"), (None, "u", "n"), (None, "u", "n"), (2, "http://a/é%20z", "same")]
    folder = store.new_folder(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    fs, base = warc.filesystem(folder)
    ids, urls, refers = [], Counter(), []
    for r in manifest.collect():
        with fs.open_input_stream(f"{base}/{r.file}", compression=None) as f:
            for fields, _ in map(warc.parsed, warc.members(f)):
                ids.append(fields["WARC-Record-ID"])
                urls[fields.get("WARC-Target-URI")] += 1
                refers += [fields["WARC-Refers-To"]] if "WARC-Refers-To" in fields else []
    assert len(set(ids)) == len(ids) == len(rows) + manifest.count()
    assert urls["http://a/x%20%20y"] == 3 and urls["http://a/%C3%A9%20z"] == 2
    assert len(refers) == 2 and set(refers) <= set(ids)


def test_op10_components(spark):
    df = frame(spark)
    fp = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in df.collect()}
    nodes = list(fp)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for n in nodes:
        if n[0] is not None:
            least[find(n)] = min(least.get(find(n), n[0]), n[0])
    want = Counter((r.doc_id, f"{fp[r.doc_id, r.text]:016x}", least.get(find((r.doc_id, r.text)))) for r in df.collect())
    got = simhash.near_duplicates(df).select("doc_id", simhash.fingerprint_hex("fp").alias("f"), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_op10_dense_and_chained_fingerprints(spark):
    import random

    r = random.Random(4)
    center = r.getrandbits(64)
    fps = {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(64)}
    x = r.getrandbits(64)
    for _ in range(60):  # a long chain
        fps.add(x)
        x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    fps |= {r.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=64)
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {row.u: row.root for row in simhash.components(edges).collect()}
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}
    assert edges.count() < 40 * len(fps)


@pytest.mark.parametrize("keys", [[i * 7 - 50 for i in range(40)], [i * 7 - 50 for i in range(900)], [*range(1000), 10**12], [-(1 << 63), *range(200), (1 << 63) - 1], [5] * 300 + list(range(100)), [None] * 300 + list(range(9)), [4]])
def test_key_shards_follow_from_the_rows(spark, keys):
    from pyspark.sql import functions as F

    from caseloom.llm.ranges import key_shards

    df = spark.createDataFrame([(k, i % 5, i) for i, k in enumerate(keys)] + [(None, 1, -1), (keys[-1], 3, -2)], "key long, n long, t long")
    put, n = key_shards(df, "key", F.col("n"), F.xxhash64("t"), least=8)
    got = put(df, F.xxhash64("t")).collect()
    assert len(got) == len(keys) + 2 and {r.shard for r in got} <= set(range(n)) and n <= len(keys)
    order = sorted(got, key=lambda r: (r.shard, r.key is not None, r.key))
    assert [r.key for r in order] == sorted((r.key for r in got), key=lambda k: (k is not None, k))  # ascending ranges
    size = Counter()
    for r in got:
        size[r.shard] += r.n + 1
    share = max(8, math.isqrt(sum(size.values()) << 20))
    assert n == 1 or max(size.values()) <= 2 * share + 8
    put_again, m = key_shards(df.repartition(5), "key", F.col("n"), F.xxhash64("t"), least=8)
    assert m == n and sorted(map(str, put_again(df, F.xxhash64("t")).collect())) == sorted(map(str, got))
