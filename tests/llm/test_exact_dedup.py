"""Exact duplicates: the filter alone, then the index against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.llm import cuckoo

DOCS = "doc_id bigint, text string"


def hashes(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def test_filter_adds_finds_and_drops():
    keys = np.unique(hashes(5000))
    made = cuckoo.rebuilt(keys, cuckoo.FIRST_BUCKETS)
    assert made.has(keys).all()
    assert (made.slots != 0).sum() == len(keys)
    strangers = hashes(100_000, 2)
    assert made.has(strangers).mean() < 0.001
    made.drop(keys[:2500])
    assert made.has(keys[2500:]).all()
    assert (made.slots != 0).sum() == len(keys) - 2500
    assert made.has(keys[:2500]).mean() < 0.01


def test_filter_reports_overflow():
    keys = np.unique(hashes(400))
    assert not cuckoo.Filter().add(keys)  # 256 slots
    assert len(cuckoo.rebuilt(keys, cuckoo.FIRST_BUCKETS).slots) > cuckoo.FIRST_BUCKETS


def test_hits_are_those_of_single_insertions():
    h = np.concatenate([hashes(60), hashes(60)[:30], hashes(20, 3)])
    one, said = cuckoo.Filter(), []
    for x in h:
        x = np.array([x])
        said.append(bool(one.has(x)[0]))
        if not said[-1]:
            assert one.add(x)
    assert cuckoo.Filter().hits(h).tolist() == said


def plain(rows):
    """rows in order; the last of the largest ids stays."""
    out, by = [], {}
    for i, (key, text) in enumerate(rows):
        by.setdefault(text or "", []).append((key is not None, key or 0, i))
    for i, (key, text) in enumerate(rows):
        own = by[text or ""]
        out.append((key, rows[max(own)[2]][0], len(own), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def told(index):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256)
                   for r in cuckoo.groups(index).collect()), key=str)


def crowd(n, seed=5):
    rng = random.Random(seed)
    texts = [f"text {i}" for i in range(n // 3)] + ["", None, "é" * 40_000, "text 1 "]
    return [(i, "hot" if i % 3 == 0 else rng.choice(texts)) for i in range(n)]


def test_whole_table(spark):
    rows = [*crowd(900), (None, "hot"), (None, "text 1"), (7, "hot"), (7, "hot")]
    df = spark.createDataFrame(rows, DOCS).withColumn("address", F.lit(1)).withColumn("row", F.lit(2))
    got = cuckoo.digest(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    for text in {t or "" for _, t in rows}:
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [r.doc_id for r in got if r.text_sha256 == sha and r.kept]
        assert kept == [next(r.keep_id for r in got if r.text_sha256 == sha)]


def test_empty_table(spark):
    out = cuckoo.digest(spark.createDataFrame([], DOCS))
    assert out.count() == 0
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("address", [cuckoo.digest_of, lambda t: F.substring(F.md5(t), 1, 2)],
                         ids=["sha256", "two digits"])
def test_insert_and_delete(spark, address):
    """With an address of 256 values nearly every lookup is a false alarm."""
    rows = crowd(600)
    index = cuckoo.empty(spark, 3)
    live = []
    for part in (rows[:200], rows[200:450]):
        index = cuckoo.insert(index, spark.createDataFrame(part, DOCS), address)
        live += part
        if address is cuckoo.digest_of:
            assert told(index) == plain(live)
        assert [(a, b, c) for a, b, c, _ in told(index)] == [(a, b, c) for a, b, c, _ in plain(live)]
    gone = {i for i, t in live if i % 4 == 1 or t == "hot"}
    index = cuckoo.delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    live = [r for r in live if r[0] not in gone]
    assert [x[:3] for x in told(index)] == [x[:3] for x in plain(live)]
    marks = sum(int((np.frombuffer(r["slots"], np.uint16) != 0).sum()) for r in index.filters.collect())
    assert marks == index.members.select("address").distinct().count()
    # Deleted texts come back as new ones, live ones as copies.
    again = [*rows[450:], *((i + 10_000, t) for i, t in rows[:200])]
    index = cuckoo.insert(index, spark.createDataFrame(again, DOCS), address)
    assert [x[:3] for x in told(index)] == [x[:3] for x in plain(live + again)]
