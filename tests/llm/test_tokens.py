"""Encoding, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worktrail.llm import bpe, packing, pretokens, tokencount
from worktrail.llm.common import Cache

RANKS, BYTE_JSON, WORD_JSON = (P.path(x) for x in (
    "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "a", "a  b <|endoftext|>\n\n x", "it's 12 ١² x\x1c\x85y  \n",
         "<|endoftext|><|startoftext|>", "word " * 4000, "x" * 9000, "ab" * 2500, "ŐΣΣ é́ ﬁ İ",
         "\n a", "漢字 ab😀", "Éà ÿ ß µ Àé, été. don't", "  lead", "tail  ", "a\tb\u00a0c"]


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS),
                             special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 4 else None, x, "host") for i, x in enumerate([*TEXTS, *TEXTS[:6]])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def words_of(texts, path, **more):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False, **more).ids for x in texts]


@given(st.text(alphabet=st.sampled_from(list(" \n\t  'slt.,aéZß9٣_%€\x1c\x85漢😀")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_parts_have_the_pretokens_of_the_whole(text):
    found = [p for k in pretokens.chunks(text) for p in pretokens.pieces(k)]
    assert found == pretokens.pattern().findall(text)


def test_encode_is_exact(exact):
    r = random.Random(5)
    texts = [x for x in TEXTS if x] + [
        "".join(r.choice(" ab'sé9€漢\n") for _ in range(r.randrange(60))) for _ in range(500)]
    e = bpe.encoder(RANKS)
    for x, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(x)
        assert e.decode(ids) == x.encode()


def test_long_and_short_merges_agree():
    e = bpe.encoder(RANKS)
    for w in (b"ab" * 300, b"aaaaaaa" * 90, bytes(range(256)) * 3, b"thethethe" * 50):
        assert e.merge_long(w) == e.merge_block([w])[0]


def test_cache_forgets_but_stays_right():
    cache, made = Cache(3), []

    def make(new):
        made.extend(new)
        return {k: k * 2 for k in new}

    for keys in (["a", "b", "a"], ["c", "d"], ["a", "e"], ["a"], [], ["f", "b", "a"]):
        assert cache.rows([keys], make) == [[k * 2 for k in keys]]
        assert len(cache.young) + len(cache.old) <= 12


def test_op1_digest(docs, exact):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.digest(docs).collect())
    want = []
    for row in docs.collect():
        ids = exact.encode_ordinary(row.text or "")
        want.append((row.doc_id or -1, len(ids),
                     hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_to_array_and_empty_table(spark, docs, exact):
    some = docs.filter("text = 'a  b <|endoftext|>\n\n x'").select(
        bpe.ids_to_array(bpe.encode(F.col("text"), RANKS)).alias("ids")).first()
    assert some.ids == exact.encode_ordinary(TEXTS[4])
    assert bpe.digest(docs.limit(0)).count() == 0


def test_op6_counts(docs):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in tokencount.count_tokens(docs).collect())
    rows = docs.collect()
    want = [(r.doc_id or -1, len((r.text or "").encode()), len(ids), len(ids) > 512)
            for r, ids in zip(rows, words_of([r.text for r in rows], BYTE_JSON), strict=True)]
    assert got == sorted(want)
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_op6_tells_many_rows_without_id_apart(spark):
    """150,000 texts that 31 bits of a hash would have mixed up."""
    rows = spark.range(150_000).select(F.lit(None).cast("bigint").alias("doc_id"),
                                       F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    got = tokencount.count_tokens(rows).agg(F.count("*"), F.sum("n_bytes")).first()
    assert tuple(got) == tuple(rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first())


def test_op6_without_hot_pieces(docs, monkeypatch):
    monkeypatch.setattr(tokencount, "hot_pieces", lambda pieces: {})
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tokencount.count_tokens(docs).collect())
    rows = docs.collect()
    assert got == sorted((r.doc_id or -1, len(ids)) for r, ids in zip(
        rows, words_of([r.text for r in rows], BYTE_JSON), strict=True))


def test_cuts_are_powers_of_two():
    for n in [*range(1, 300), 4095, 4096, 4097, 12288, 70001]:
        found = packing.cuts(n)
        assert [s for s, _ in found] == [sum(k for _, k in found[:i]) for i in range(len(found))]
        assert sum(k for _, k in found) == n
        assert all(k & (k - 1) == 0 and k <= 4096 for _, k in found)


def test_op9_pieces(docs, tmp_path):
    kept = docs.withColumn("row", F.monotonically_increasing_id())
    rows = {r.row: r.text for r in kept.collect()}
    ids = dict(zip(rows, words_of(rows.values(), WORD_JSON), strict=True))
    found = packing.pieces(kept, keep=("row", "n_tokens")).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    assert {r.offset for r in found} == {0}
    own = {}
    for r in sorted(found, key=lambda r: (r.row, r.start)):
        got = own.setdefault(r.row, [])
        assert r.start == len(got) and r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length
        got += np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens == len(ids[r.row]) + 1
    assert own == {k: [*v, 2] for k, v in ids.items()}
    for r in packing.digest(docs).filter("doc_id = 3").collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*words_of(["a"], WORD_JSON)[0], 2], "<u4").tobytes())
    packing.write_buckets(packing.pieces(docs), str(tmp_path / "b"))
    assert (tmp_path / "b" / "length=1").exists()


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_words_stand_for_themselves(text):
    got = np.frombuffer(packing.words(WORD_JSON).encode([text])[0], "<u4").tolist()
    assert got == words_of([text], WORD_JSON)[0]
