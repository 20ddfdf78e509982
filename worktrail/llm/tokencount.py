"""Token counts by joining pre-token frequencies to a dictionary of counted pre-tokens.

A token never crosses a pre-token, so a text's count is the sum over its
pre-tokens. Each distinct pre-token is tokenized once, into a stored dictionary
(piece, n_tokens, freq). A text then gives its pre-token frequencies, which are
joined to the dictionary and summed; no id is ever made for a document.

Frequent pieces are looked up before the shuffle: a piece that makes up at
least ``1/HOT`` of all pieces is hot, of which there cannot be more than
``HOT``, so that part of the dictionary is broadcast. All other pieces go
through the join, where no key can hold more than ``1/HOT`` of the rows.

Null counts as the empty text (0 tokens). Rows are told apart by id and text,
and equal rows are counted and given back as often as they came, so repeated
ids, null ids and exact copies keep their rows. Other columns are not read. Texts of any
length are counted whole; ties play no part. An empty table gives no rows.
"""

import functools
import os
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm import pretokens
from worktrail.llm.common import Cache, stored

HOT = 1 << 20
FLUSH = 400_000  # distinct parts that one task counts before it hands them on
ROWS = 20_000  # rows of one outgoing batch
CACHED = 400_000  # text parts kept per task and generation


@functools.cache
def tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.cache
def specials(path):
    """A pattern of the strings that the library itself takes for one token."""
    import regex
    found = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()),
                   key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def segments(text, path):
    """Ordinary parts of a text, and how many special strings stand between them."""
    special = specials(path)
    if special is None or "<|" not in text:
        return [text], 0
    parts = special.split(text)
    return parts, len(parts) - 1


def keys_of(text, path):
    """Part keys of a text (see ``pretokens``), and the number of special strings in it."""
    parts, n = segments(text or "", path)
    return [k for p in parts for k in pretokens.chunks(p)], n


def _batches(rows, names, types):
    for i in range(0, len(rows), ROWS):
        columns = zip(*rows[i:i + ROWS], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def piece_counts(docs, path, text="text"):
    """How often each pre-token occurs: piece, freq."""
    def rows(parts):
        total = Counter()
        for key, n in parts.items():
            for piece in pretokens.pieces(key):
                total[piece] += n
        return _batches(list(total.items()), ["piece", "freq"], [pa.string(), pa.int64()])

    def run(batches):
        parts = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                parts.update(keys_of(x, path)[0])
                if len(parts) > FLUSH:
                    yield from rows(parts)
                    parts = Counter()
        yield from rows(parts)

    found = docs.select(text).mapInArrow(run, "piece string, freq bigint")
    return found.groupBy("piece").agg(F.sum("freq").alias("freq"))


def piece_tokens(piece, path):
    """Tokens of a pre-token column by the library."""
    @F.arrow_udf("int")
    def run(values: pa.Array) -> pa.Array:
        found = tokenizer(path).encode_batch_fast(values.to_pylist(), add_special_tokens=False)
        return pa.array([len(x.ids) for x in found], pa.int32())
    return run(piece)


def dictionary(docs, path, text="text"):
    """Each distinct pre-token once: piece, freq, n_tokens (stored)."""
    counted = piece_counts(docs, path, text)
    return stored(counted.withColumn("n_tokens", piece_tokens(F.col("piece"), path)), "pieces")


def hot_pieces(pieces):
    """piece -> tokens of the pieces with at least 1/HOT of all occurrences: HOT at most."""
    total = pieces.agg(F.sum("freq")).first()[0] or 0
    rows = pieces.filter(F.col("freq") * HOT >= F.lit(total)).select("piece", "n_tokens").collect()
    return dict(rows)


# No pre-token holds a space between letters, so this key is never in the dictionary.
MARK = "a {} b"


def frequencies(docs, path, hot, id_column="doc_id", text="text"):
    """One row per document (with its hot sum) and one per other piece in it."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = docs.select(id_column).schema[0].dataType.simpleString()

    def run(batches):
        known, cache = shared.value, Cache(CACHED)

        def split(key):
            """Tokens of the hot pieces of a part; with its other pieces, if it has any."""
            tokens, other = 0, []
            for piece in pretokens.pieces(key):
                n = known.get(piece)
                if n is None:
                    other.append(piece)
                else:
                    tokens += n
            return (tokens, other) if other else tokens

        for batch in batches:
            ids, hashes, checks, texts = (batch.column(i).to_pylist() for i in range(4))
            for i in range(0, len(texts), 256):
                keys, marks = zip(*[keys_of(x, path) for x in texts[i:i + 256]], strict=True)
                found = cache.rows(keys, lambda new: {k: split(k) for k in new})
                rows = []
                for key, h, check, x, n, own in zip(
                        *(c[i:i + 256] for c in (ids, hashes, checks, texts)), marks, found, strict=True):
                    cold = [v for v in own if type(v) is tuple]
                    n += sum([v for v in own if type(v) is int]) + sum(t for t, _ in cold)
                    rows += [(key, h, check, piece, f, None, None) for piece, f in Counter(
                        [p for _, other in cold for p in other]).items()]
                    rows.append((key, h, check, MARK.format(h % 9973), None, len((x or "").encode()), n))
                yield from _batches(rows, ["id", "hash", "check", "piece", "freq", "n_bytes", "hot"],
                                    [batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.int32(),
                                     pa.int64(), pa.int64()])

    # Two hashes of 96 bits in all tell rows without or with the same id apart.
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"),
                       F.hash(text).alias("check"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, hash bigint, check int, piece string, freq int, n_bytes bigint, hot bigint")


def count_tokens(docs, path=None, id_column="doc_id", text="text", limit=512):
    """Per row: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = dictionary(docs, path, text)
    rows = frequencies(docs, path, hot_pieces(pieces), id_column, text)
    joined = rows.join(pieces.select("piece", "n_tokens"), "piece", "left")
    per = (joined.groupBy("id", "hash", "check")
           .agg(F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"),
                F.max("hot").alias("hot"),
                F.coalesce(F.sum(F.col("freq") * F.col("n_tokens")), F.lit(0)).alias("cold")))
    total = F.col("hot") + (F.col("cold") / F.col("copies")).cast("bigint")
    return (per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.col("id").alias(id_column), "n_bytes", total.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
