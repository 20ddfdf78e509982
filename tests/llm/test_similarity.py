"""Joins, neighbours and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from worktrail.llm import ann, jaccard, packing, pii, quality
from worktrail.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- components --------------------------------------------------------------------

def roots(edges):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(up)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(7, i) for i in range(8, 60)] + [(3, 7), (1, 60), (60, 2)],
    [(a * 37 % 101, a * 53 % 97) for a in range(60)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = [(r.u, r.root) for r in components(df).collect()]
    assert sorted(got) == sorted(roots([e for e in edges if e[0] != e[1]]).items())


# --- Jaccard -----------------------------------------------------------------------

def slow_link(rows, k, num, den):
    """{row number: (set size, smallest id of its component)}."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
             if a and b and den * len(a & b) >= num * len(a | b)]
    up = roots([*links, *((i, i) for i in range(len(rows)))])
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(up[i], []).append(key)
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(key, len(sets[i]), name[up[i]]) for i, (key, _) in enumerate(rows)]


def near_texts(seed, n=40):
    r = random.Random(seed)

    def text(m):
        return [r.choice("abcdefghijklmnop") + r.choice("qrstuvwxyz") + r.choice("0123") for _ in range(m)]

    common, out = text(25), []
    for _ in range(n):
        base = text(r.choice([2, 9, 11, 12, 20, 40, 120]))
        if r.random() < 0.5:
            base += common
        out.append(base)
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = r.choice("XYZ")
            out.append(copy)
    chain = text(100)
    for i in range(12):  # neighbours link, ends don't
        chain = chain[2:] + text(2)
        out.append(chain)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_against_all_pairs(spark, k, num, den):
    rows = list(enumerate(near_texts(k)))
    r = random.Random(2)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id)
                 for r in jaccard.link(df, k, num, den).collect())
    assert got == sorted(slow_link(rows, k, num, den))


def test_matrix_finds_what_groups_miss(spark, monkeypatch):
    """Without any group of similar documents the matrix alone must find all links."""
    monkeypatch.setattr(jaccard, "bands", lambda tokens: [jaccard.class_id(tokens) + i
                                                         for i in range(jaccard.BANDS)])
    rows = list(enumerate(near_texts(9, 25)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    leaders = jaccard.leaders
    monkeypatch.setattr(jaccard, "leaders", lambda classes: leaders(classes).limit(0))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect())
    assert got == sorted(slow_link(rows, 3, 90, 100))


def test_open_blocks(monkeypatch):
    """Edges connect just what all pairs connect; members of one core aren't compared."""
    r = random.Random(4)
    sets = [(i // 2, np.array(sorted(r.sample(range(60), r.choice([3, 40]))), np.uint64).tobytes())
            for i in range(40)]
    for num in (50, 60, 70, 80):
        for mine, theirs in ((sets[:15], sets[15:]), (sets, sets)):
            pairs = [(a, b) for a, x in mine for b, y in theirs if a != b and
                     100 * (o := jaccard.overlap(x, y)) >= num * ((len(x) + len(y)) // 8 - o)]
            for chunk in (7, 4096):
                monkeypatch.setattr(jaccard, "CHUNK", chunk)
                found = jaccard.open_blocks(mine, theirs, num, 100)
                assert set(found) <= set(pairs)
                assert roots(found) == roots(pairs)
                assert len(found) == len(roots(pairs)) - len(set(roots(pairs).values()))


def family(seed, n=60):
    """Texts of one family, most of which miss the threshold, and cores of near copies among them."""
    r = random.Random(seed)
    base = [f"{r.choice('abcdefgh')}{r.randrange(1000)}" for _ in range(120)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(r.choice([3, 6, 9])):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        out.append(text[:r.choice([120, 110, 95])])
        for j in range(12 if i % 20 == 0 else r.randrange(2)):
            copy = list(out[-1])
            copy[r.randrange(len(copy))] = f"y{j}"
            out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("size", [(256, 1 << 20), (4, 4000)])
def test_a_family_below_the_threshold(spark, monkeypatch, size):
    """One group of many cores: blocks of several, large cores and neighbouring size classes."""
    monkeypatch.setattr(jaccard, "BLOCK", size[0])
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size[1])
    rows = list(enumerate(family(1)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect())
    want = sorted(slow_link(rows, 3, 90, 100))
    assert 5 < len({x for _, _, x in want}) < len(rows) - 20
    assert got == want


def test_jaccard_edges(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \n "), (8, "a b"), (9, "A  b"), (8, "a b"), (10, "b a"),
            (3, long), (4, long + " end"), (1, "x"), (2, "y")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, text string, c int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect())
    assert got == sorted(slow_link(rows, 3, 90, 100))
    assert jaccard.link(df.limit(0)).count() == 0
    assert jaccard.link(df.filter("doc_id in (5, 6)")).count() == 2


def test_one_of_each_keeps_one_row(spark):
    same = "a b c d e f g h i j k"
    rows = [(None, same, "en", "s", 1), (None, same, "en", "s", 1), (4, same, "en", "s", 1),
            (4, same, "en", "s", 1), (5, None, "en", "s", 0), (5, None, None, None, None),
            (6, "other words are here now and then again", "en", "s", 2)]
    df = spark.createDataFrame(rows, DOCS)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [same, None, None, rows[-1][1]]))


# --- neighbours --------------------------------------------------------------------

def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        scores = (v * v[ids.index(q)]).sum(1)
        rows = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out[q] = [i for _, i in rows]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None] * rng.uniform(0.5, 1.5, (3000, 1)).astype(np.float32)
    v[100:160] = v[100]
    ids = list(range(3000))
    df = spark.createDataFrame([(i, x.tolist(), "l") for i, x in zip(ids, v, strict=True)],
                               "vec_id bigint, embedding array<float>, score string")
    out = {}
    for r in ann.digest(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    wide = v.astype(np.float64)
    truth = brute(ids, wide, [i for i in ids if i % 20 == 0], 20)
    assert out.keys() == truth.keys()
    hits = 0
    for q, rows in out.items():
        assert [a for a, _, _ in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - wide[q] @ wide[i]) < 1e-12 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(truth[q]))
    assert hits / (20 * len(truth)) >= 0.9
    # Ties: of sixty equal vectors the smaller ids come first.
    assert [i for _, i, _ in out[100]][:20] == list(range(101, 121))


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [None, 1.0]), (80, [nan, 1.0]),
            (100, [inf, 1.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.digest(df).collect()]
    assert got == [(0, 1, 1, 0.5)]
    assert ann.digest(df.limit(0)).count() == 0
    assert ann.digest(df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("crowd", [40, 400, 1400])
def test_neighbours_recall_beside_a_crowd(spark, crowd):
    """Near copies of one row must not narrow the search of the other rows' queries."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4200, 64))
    v[:crowd] = v[0] + 0.002 * rng.standard_normal((crowd, 64))
    v = v[rng.permutation(len(v))]
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = list(range(len(v)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)],
                               "vec_id bigint, embedding array<double>")
    out = {}
    for r in ann.digest(df).collect():
        out.setdefault(r.query_id, set()).add(r.vec_id)
    truth = brute(ids, v, [i for i in ids if i % 20 == 0], 20)
    assert out.keys() == truth.keys()
    recall = [len(out[q] & set(truth[q])) / 20 for q in truth]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


# --- pipeline ----------------------------------------------------------------------

def corpus():
    r = random.Random(8)

    def text(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))

    rows = [(i, text(60)) for i in range(20)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(200 + i, rows[5 + i][1] + " more words") for i in range(5)]  # near copies
    rows += [(300, "too short"), (301, None), (302, ""), (303, " ".join(["again and again now"] * 30))]
    rows += [(400, text(40) + " mail me.you@site.example.com or +1 (212) 555-0199 " + text(5))]
    rows += [(500, text(9000)), (500, text(50)), (None, text(50)), (None, text(50))]
    return [(i, x, "en", "s", len(x or "")) for i, x in rows]


def test_pipeline_against_plain(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    first = sorted(kept.collect(), key=str)
    want = [x for x in rows if x[0] not in (300, 301, 302, 303)]
    assert sorted(map(tuple, first), key=str) == sorted(want, key=str)

    one = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(first, DOCS), str(tmp_path))
    second = one.collect()
    want = [x for x in want if not 100 <= (x[0] or 0) < 300]
    assert sorted(map(tuple, second), key=str) == sorted(want, key=str)

    clean = corpus_pipeline.personal_data(spark, spark.createDataFrame(second, DOCS), str(tmp_path))
    third = clean.collect()
    assert clean.columns == docs.columns and len(third) == len(second)
    assert all(r.n_chars == len(r.text) for r in third)
    masked = next(r.text for r in third if r.doc_id == 400)
    assert "[EMAIL]" in masked and "[PHONE]" in masked and "@" not in masked and "555" not in masked
    plain = {x[1] for x in want if x[0] != 400}
    assert {r.text for r in third if r.doc_id != 400} == plain

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in out:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    coded = packing.words(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in third:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(coded.encode([r.text])[0]) // 4 + 1
    assert tokens == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_masked_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("a@b.co x",)], "text string")
    model = pii.train(df, steps=1)
    got = {r[0] for r in df.select(pii.masked(F.col("text"), model)).collect()}
    assert got == {None, "[EMAIL] x"}


def test_quality_stage_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a " * 30, "h", 5)], "doc_id int, text string, source string, n_words int")
    assert quality.kept(df).columns == df.columns
