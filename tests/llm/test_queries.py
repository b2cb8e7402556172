"""The registered queries over whole small tables, against brute force, the libraries themselves, or SQL."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import langid, licenses, outliers, queries, store

from .test_text_kernels import brute_fingerprint, reference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"(?:[0-9a-z\x00-\x08\x0e-\x1f\x7f]|[^\x00-\x7f])+")


@pytest.fixture(scope="module")
def docs(spark):
    return store.table(spark, SF, "documents").collect()


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_op1_finds_what_stands_in_the_texts(spark, docs):
    text = {r.doc_id: WORD.findall((r.text or "").lower()) for r in docs}
    templates = {n: WORD.findall(re.sub("[{}]", " ", t).lower()) for n, t in licenses.TEMPLATES.items()}
    got = queries.op1_license_scan(spark, SF).collect()
    for r in got:  # each alignment is one: its words are a common subsequence of both
        part, t = text[r.doc_id][r.first_word : r.end_word], templates[r.license]
        d = [0] * (len(t) + 1)
        for w in part:
            d = [0, *(d := [max(d[j + 1], d[j] + (w == t[j])) if w == t[j] else d[j + 1] for j in range(len(t))])]
            d = list(np.maximum.accumulate(d))
        assert r.aligned_words <= d[-1] and r.aligned_words >= licenses.COVERAGE * len(t) - 1e-9
    want = Counter()
    for i, w in text.items():
        for n, t in templates.items():
            want[i, n] += sum(w[k : k + len(t)] == t for k in range(len(w)))
    found = Counter((r.doc_id, r.license) for r in got if r.coverage == 1.0)
    assert found == +want and found


def test_op2_and_op4_equal_the_libraries(spark, docs):
    enc = reference()
    want = []
    for r in docs:
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows(queries.op2_byte_bpe(spark, SF)) == sorted(want)
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert rows(queries.op4_token_records(spark, SF)) == sorted(want)


def test_op3_law(spark, docs):
    got = {r.doc_id: r for r in queries.op3_sharding(spark, SF).collect()}
    assert len(got) == len(docs) and {r.law for r in got.values()} == {"bytes"} and all(r.grown_shard is None for r in got.values())
    shard_of, filled, slots = {}, Counter(), defaultdict(list)
    for r in docs:
        g, data = got[r.doc_id], (r.text or "").encode()
        assert (g["size"], g.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert shard_of.setdefault(r.text, g.shard) == g.shard
        filled[g.shard] += g["size"]
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    group = Counter()
    for r in docs:
        group[r.text] += got[r.doc_id]["size"]
    mean = sum(filled.values()) / 16
    assert max(filled.values()) <= max(max(group.values()), 1.15 * mean)


def _statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if c[g] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def _estimates(groups, share=0.75, steps=6):
    """The estimates of all groups, by plain arrays: two starts, concentration steps until all settle, scale, reweighting, scale."""
    floors = np.array(outliers.FLOORS)

    def grid_median(v):
        v = np.sort(np.floor(np.abs(v) * 256 + 0.5) * np.sign(v))
        return v[math.ceil(len(v) * 0.5) - 1] / 256

    bins = lambda d: np.floor(np.log1p(d) * outliers.BINS)
    at = lambda b, q: np.sort(b)[math.ceil(len(b) * q - 1e-9) - 1]

    def fit(v):
        cov = np.cov(v.T, bias=True).reshape(len(floors), -1) + np.diag(floors**2)
        return v.mean(axis=0), np.linalg.inv(np.linalg.cholesky(cov)), np.linalg.slogdet(cov)[1]

    distance = lambda x, m, w: (((x - m) @ w.T) ** 2).sum(axis=1)
    scale = lambda d: max(1.0, math.expm1((at(bins(d), 0.5) + 0.5) / outliers.BINS) / outliers.chi_square_at(0.5, 5))
    now = {}
    for g, x in groups.items():
        c = np.array([grid_median(v) for v in x.T])
        mad = np.array([grid_median(np.abs(v - m)) for v, m in zip(x.T, c, strict=True)])
        now[g, 0] = c, np.diag(1 / (1.4826 * mad + floors)), math.inf
        now[g, 1] = *fit(x)[:2], math.inf
    for _ in range(steps):
        old = now
        now = {}
        for (g, s), (m, w, _) in old.items():
            b = bins(distance(groups[g], m, w))
            now[g, s] = fit(groups[g][b <= at(b, share)])
        if max(abs(now[k][2] - old[k][2]) for k in now) <= outliers.TOLERANCE:
            break
    out = {}
    for g, x in groups.items():
        m, w, _ = min((now[g, 0], now[g, 1]), key=lambda e: e[2])
        d = distance(x, m, w)
        m, w, _ = fit(x[d / scale(d) <= outliers.chi_square_at(0.975, 5)])
        out[g] = m, w, scale(distance(x, m, w))
    return out


def test_op6_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op6_outliers(spark, SF).collect()}
    stats = {r.doc_id: _statistics(r.text) for r in docs}
    vectors = {}
    for r in docs:
        n, chars, symbols, lines, words = stats[r.doc_id]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == stats[r.doc_id]
        assert g.base_failed == (n < 10 or 100 * words > 20 * n)
        if not g.base_failed:
            vectors[r.doc_id] = np.array([math.log(n), math.log(chars / n), *(math.log1p(100 * a / b) for a, b in ((symbols, chars), (lines, n), (words, n)))])
    groups = defaultdict(list)
    for r in docs:
        if r.doc_id in vectors:
            for g in ((), (r.lang,), (r.lang, r.source)):
                groups[g].append(r.doc_id)
    known = _estimates({g: np.array([vectors[i] for i in ids]) for g, ids in groups.items() if len(ids) >= 100 or g == ()})
    cut = outliers.chi_square_at(1 - 1e-6, 5)
    for r in docs:
        if r.doc_id in vectors:
            m, w, scale = next(known[g] for g in ((r.lang, r.source), (r.lang,), ()) if len(groups[g]) >= 100 or g == ())
            d = (((vectors[r.doc_id] - m) @ w.T) ** 2).sum() / scale
            assert got[r.doc_id].distance == pytest.approx(d, rel=1e-6, abs=1e-6) and got[r.doc_id].kept == (d <= cut)
        else:
            assert not got[r.doc_id].kept


def _trigrams(text):
    b = [int(x) for x in (text.lower() if isinstance(text, str) else text).encode()] if isinstance(text, str) else list(text)
    b = [x if 97 <= x < 123 or x >= 128 else 0 for x in b]
    return [((x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF) >> 17 for x, y, z in zip(b, b[1:], b[2:], strict=False) if (x > 0) + (y > 0) + (z > 0) >= 2]


def test_op7_equals_brute_force(spark, docs):
    names = sorted({r.lang for r in docs if r.lang is not None and r.text is not None})
    table = {n: Counter() for n in names}
    for r in docs:
        if r.lang is not None and r.text is not None:
            table[r.lang].update(_trigrams(r.text))
    size = {n: sum(c.values()) + 0.05 * langid.BUCKETS for n, c in table.items()}
    log = lambda n, b: math.log((table[n][b] + 0.05) / size[n])
    items = [(r.doc_id, None, r.text, None, f"source:{r.source}" if r.source is not None else None, None, None) for r in docs]
    for r in store.table(spark, SF, "pages").collect():
        html = r.html or ""
        bare = re.sub(r"<[^>]*>|&#?[A-Za-z0-9_]{1,8};", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html))
        lang = re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", html)
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url or "")
        host = host[1].lower() if host else None
        items.append((None, r.page_id, bare, lang[1].lower() if lang else None, host, host and host.split(".")[-1], host and ".".join(host.split(".")[-2:])))
    k, w = len(names), langid.WEIGHT

    def soft(s):
        e = np.exp(np.array(s) - max(s))
        return e / e.sum()

    data = []
    for i, p, text, *marks in items:
        grams = _trigrams(text or "")
        ll = np.array([sum(log(n, b) for b in grams) for n in names])
        data.append((i, p, len(grams), ll, soft(ll * w), *marks))
    voters = [x for x in data if x[2]]
    total = (sum(x[4] for x in voters) + 1) / (len(voters) + k)

    def sums(at):
        out = defaultdict(lambda: [0, np.zeros(k)])
        for x in voters:
            if at(x) is not None:
                out[at(x)][0] += 1
                out[at(x)][1] = out[at(x)][1] + x[4]
        return out

    by_host, by_domain = sums(lambda x: (x[6], x[8]) if x[6] is not None else None), sums(lambda x: x[8])
    declared, suffix = sums(lambda x: x[5]), sums(lambda x: x[7])
    got = {(r.doc_id, r.page_id): r for r in queries.op7_language_id(spark, SF).collect()}
    assert len(got) == len(data)
    differ = 0
    for i, p, n, ll, own, dec, host, suf, dom in data:
        own, one = (own, 1) if n else (np.zeros(k), 0)
        less = lambda t, key: (t[key][0] - one, t[key][1] - own) if key in t else (0, np.zeros(k))  # noqa: B023, E731
        nd, pd_ = less(by_domain, dom)
        nh, ph = less(by_host, (host, dom) if host is not None else None)
        above = (np.maximum(pd_, 0) + langid.SHRINK * total) / (nd + langid.SHRINK)
        score = ll * w + np.log((np.maximum(ph, 0) + langid.SHRINK * above) / (nh + langid.SHRINK))
        for t, key in ((declared, dec), (suffix, suf)):
            if key is not None and key in t:
                score = score + np.log((t[key][1] + langid.SHRINK * total) / (t[key][0] + langid.SHRINK) / total)
        s = soft(score)
        best = int(np.argmax(s))
        kept = bool(n) and ll[best] / n >= -math.log(langid.BUCKETS) and s[best] >= 0.5
        r = got[i, p]
        differ += (r.kept, r.language) != (kept, names[best] if kept else "und")
        assert r.confidence == pytest.approx(s[best], abs=2e-3)
    assert differ == 0


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in store.table(spark, sf, "labels").collect()}
    got = {r.doc_id: r for r in queries.op8_quality_classifier(spark, sf).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.97 and len(held) > 300


def test_op9_equals_sql_and_brute_force(spark):
    pages = store.table(spark, SF, "pages").collect()
    best = {}
    for r in pages:
        best[r.html or ""] = max(best.get(r.html or "", -1), r.page_id)
    want = [(r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), *(("response", None) if best[r.html or ""] == r.page_id else ("revisit", best[r.html or ""]))) for r in pages]
    got = rows(queries.op9_warc(spark, SF))
    assert got == sorted(want)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(c.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.ORACLE_SQL['op9_warc']})").fetchall()) == got


def test_op10_equals_brute_force(spark, docs):
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert rows(queries.op10_simhash(spark, SF)) == sorted((i, f"{f:016x}", find(i)) for i, f in fp.items())
