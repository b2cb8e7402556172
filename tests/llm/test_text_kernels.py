import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from caseloom.llm import bpe, flat, licenses, pretokens, records, simhash, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "s", "'", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "²", "!", "--", "　", "中", "😀", "aaaa", "aaaaaaa", "\x1c", "\x85", "don't", " it's", "x'"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def encoded(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, ids, counts in bpe.windows(iter([batch]), "text", bpe.merges(RANKS).replay):
        at = np.append(0, np.cumsum(counts))
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def test_merge_replay_equals_the_library():
    texts = [*some_texts(3000, 1), None, ""]
    enc = reference()
    assert encoded(texts) == [enc.encode_ordinary(t or "") for t in texts]


def test_merge_replay_decodes():
    texts = some_texts(500, 2)
    m = bpe.merges(RANKS)
    ids = encoded(texts)
    data, offs = m.decode(np.array(sum(ids, []), np.int32), np.array([len(x) for x in ids]))
    assert [bytes(data[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)] == [t.encode() for t in texts]


def test_words_as_bytes_split_them():
    texts = ["", " a  b\x0bc", "é x y", "\n"]
    buf, offs = flat.flat(pa.array(texts))
    starts, ends, first = flat.spans(buf, offs)
    got = [[bytes(buf[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [t.encode().split() for t in texts]


def test_equal_spans_have_equal_keys_wherever_they_stand():
    buf, offs = flat.flat(pa.array(["abc x abc", "abc"]))
    starts, ends, _ = flat.spans(buf, offs)
    h = flat.hashes(buf, starts, ends)
    assert h[0] == h[2] == h[3] != h[1]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_fingerprints_equal_brute_force():
    texts = ["", "One", "one two", "a b c d E F g", "x " * 50, "é È b"]
    got = simhash._fingerprints(*flat.flat(pa.array(texts)), 3, 42)
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_forest_connects_what_links_connect():
    fps = np.array([0, 7, 7 << 3, 1 << 60, (1 << 60) | 1, 255], np.uint64)
    edges = {frozenset(e) for e in simhash._forest(fps, 3)}
    roots = {x: x for x in fps.tolist()}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for e in edges:
        a, b = (find(x) for x in e)
        roots[a] = b
    assert len({find(x) for x in fps.tolist()}) == 2


def test_common_subsequence_and_alignment():
    r = random.Random(3)

    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(500):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in range(2))
        c = licenses.common(a, b)
        assert len(c) == length(a, b) and all(a[i] == b[j] for i, j in c)
        p = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))


def test_increasing_is_a_longest_one():
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    got = [values[i] for i in licenses.increasing(values)]
    assert len(got) == 4 and got == sorted(set(got))


def test_damaged_records_raise():
    import io

    one = records.framed(b"payload")
    assert list(records.unframed(io.BytesIO(one * 2))) == [b"payload"] * 2
    for at in range(len(one)):
        bad = bytearray(one)
        bad[at] ^= 1
        with pytest.raises((ValueError, MemoryError, OverflowError)):
            list(records.unframed(io.BytesIO(bytes(bad))))


def test_archive_members_and_damage():
    import io

    data = warc.record(1, "http://a/", b"hello")
    assert [x for x in warc.members(io.BytesIO(warc.packed(data) * 3))] == [data] * 3
    fields, block = warc.parsed(data)
    assert fields["WARC-Type"] == "response" and block.endswith(b"hello")
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"hello", b"hellx"))
    assert zlib.decompress(warc.packed(data), 31) == data


def test_pretokens_that_share_a_key_keep_their_bytes(monkeypatch):
    real = flat.hashes
    monkeypatch.setattr(pretokens, "hashes", lambda *a: real(*a) % np.uint64(3))
    texts = [*some_texts(300, 5), "x" * 200 + " " + "y" * 200, "x" * 199 + "z"]
    enc = reference()
    assert encoded(texts) == [enc.encode_ordinary(t) for t in texts]
    pool = pretokens.Pool()
    seen = {}
    for text in (b"ab cd ab", b"cd ef cd", b"ab ab gh"):  # over several calls
        buf = np.frombuffer(text, np.uint8)
        starts, _ = pretokens.cuts(buf, np.array([0, len(buf)]))
        for code, a, b in zip(pool.codes(buf, starts).tolist(), starts, [*starts[1:], len(buf)], strict=True):
            assert seen.setdefault(code, text[a:b]) == text[a:b]
    assert len(seen) == len(pool)
    data, lens = pool.take_new()
    ends = np.cumsum(lens)
    assert {i: data[e - n : e].tobytes() for i, (e, n) in enumerate(zip(ends, lens, strict=True))} == seen
