"""The corpus pipeline: every stage on rows of every kind, and the whole run against its operators one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from caseloom.llm import decontaminate, fm, store

from .cases import SCHEMA, empty, prose, texts
from .test_text_kernels import brute_fingerprint, reference

ITEM = prose(77, 30)


def documents():
    rows = texts()
    add = lambda i, t, lang="en", source="src": rows.append((i, t, lang, source, len(t or ""), "x", "y", "z", "s"))
    base = prose(50, 120)
    add(20, prose(51, 90) + "\n" + ITEM + " " + prose(52, 40))
    add(21, ITEM.upper())
    for k in range(5):
        add(30 + k, base)
    add(30, base)  # the same id and text
    add(30, "quite another text of the same id " + prose(53, 60))
    add(None, prose(54, 70))
    add(None, base)
    add(40, "中文字" * 50, None, None)
    add(41, "la maison du chat est là et le chien court dans les rues de la ville " * 3, "fr", "deux")
    for k in range(60):
        add(100 + k, prose(200 + k, 80) if k % 3 else " ".join(w.upper() + "!!" for w in prose(200 + k, 80).split()))
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + k, int(k % 3 > 0), 0) for k in range(60)] + [(None, 1, 0), (41, 1, 0), (20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "")


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "decontamination", "byte_bpe"]
    docs = store.table(spark, sf, "documents")
    for name, run in pipeline.STAGES:
        none = run(spark, empty(spark), sf)
        assert none.count() == 0
        if name != "byte_bpe":
            assert none.columns == docs.columns and run(spark, docs, sf).columns == docs.columns


def test_language_stage(spark, sf):
    docs = store.table(spark, sf, "documents")
    kept = stage("language_id")(spark, docs, sf).collect()
    assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in kept)
    gone = sorted({r.doc_id for r in docs.collect()} - {r.doc_id for r in kept})
    assert {0, 1, 2} <= set(gone) and not {5, 9, 12, 20, 21, 30, 41, *range(100, 160)} & set(gone)
    assert sum(r.doc_id == 30 for r in kept) == 3 and sum(r.doc_id is None for r in kept) == 2


def test_quality_stage_keeps_what_the_score_keeps(spark, sf):
    docs, labels = store.table(spark, sf, "documents"), store.table(spark, sf, "labels")
    machine = fm.fit(docs, labels.where(~fm.held_out()))
    scores = fm.score(docs.withColumnRenamed("score", "other"), machine, keep=("doc_id", "text")).where("score >= 0.3")
    want = sorted((r.doc_id or -1, r.text or "") for r in scores.collect())
    got = stage("quality_classifier")(spark, docs, sf).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == want
    assert not any("!!" in (r.text or "") for r in got) and sum(100 <= (r.doc_id or 0) < 160 for r in got) == 40


def test_near_duplicate_stage_equals_brute_force(spark, sf):
    docs = store.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {f: None for _, t in rows for f in [brute_fingerprint(t)]}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            g = find(brute_fingerprint(t))
            least[g] = min(least.get(g, i), i)
    named = {i: any(least.get(find(brute_fingerprint(u))) == i for j, u in rows if j == i) for i, _ in rows}
    want = sorted({(-1 if i is None else i, t or "") for i, t in rows if named[i]})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in stage("near_duplicates")(spark, docs, sf).collect())
    assert got == want and sum(i == 30 for i, _ in got) == 2 and not any(31 <= i <= 34 for i, _ in got)


def test_decontamination_stage(spark, sf):
    docs = store.table(spark, sf, "documents")
    got = stage("decontamination")(spark, docs, sf).collect()
    all_rows = docs.collect()
    item = ITEM.lower().split()
    leaks = lambda t: t is not None and decontaminate.edits(item, t.lower().split())[0] <= 6
    assert sorted(map(key, got)) == sorted(key(r) for r in all_rows if not leaks(r.text))
    assert {r.doc_id for r in all_rows if leaks(r.text)} == {20, 21}


def test_whole_run(spark, sf):
    got = pipeline.run(spark, sf).collect()
    docs = store.table(spark, sf, "documents")
    for name, run in pipeline.STAGES[:-1]:
        docs = store.written(run(spark, docs, sf), name)
    enc = reference()
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    order = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    ids = {r.doc_id for r in got}
    assert {30, 41} <= ids and not {0, 1, 2, 20, 21, 31, 32} & ids and not any(i in ids for i in range(100, 160, 3))
    assert docs.where(F.col("doc_id").isin(20, 21)).count() == 0
