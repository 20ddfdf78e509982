"""Packing by power-of-two decomposition.

A document of n ids is cut into n // 4096 pieces of 4096 and one piece for each
binary digit of the rest, largest first. Each piece is a sequence of its own:
no sequence crosses documents, none is padded, and sequences of one length are
trained together (``write_buckets`` lays them out by length).

Null is the empty text (one id, the end mark). Rows keep their own pieces
whatever ids they repeat; other columns pass through ``pieces`` untouched. Texts of any
length are packed whole; ties play no part. An empty table gives no rows.
"""

import functools
import os
import re
from array import array

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm.common import Cache, runs

MOST = 4096
END = 2
CACHED = 350_000  # words kept per worker and generation


# Letters of Latin-1 (two bytes, C3 80 to C3 BF without the two signs), and one mark at most:
# the vocabulary's steps leave such a word whole, in lower case.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,])?")


def byte_letters():
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


class Words:
    """Ids of texts. The vocabulary drops white space, so each word stands for itself."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Cache(CACHED)

    def make(self, new):
        """word -> ids as bytes. Plain words go to the model at once, others through all steps."""
        known, rest, model = {}, [], self.tokenizer.model
        for w in new:
            m = PLAIN.fullmatch(w)
            if m:
                word = m[1].decode().lower().encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in model.tokenize(word)]
                if m[2]:
                    ids += [t.id for t in model.tokenize(m[2].decode())]
                known[w] = array("I", ids).tobytes()
            else:
                rest.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest],
                                                 add_special_tokens=False)
        known.update((w, array("I", x.ids).tobytes()) for w, x in zip(rest, found, strict=True))
        return known

    def encode(self, texts):
        rows = self.cache.rows([(x or "").encode().split() for x in texts], self.make)
        return [b"".join(row) for row in rows]


@functools.cache
def words(path):
    return Words(path)


def cuts(n, most=MOST):
    """(start, length) of the pieces of n ids."""
    out, start = [], 0
    while n - start >= most:
        out.append((start, most))
        start += most
    while start < n:
        size = 1 << ((n - start).bit_length() - 1)
        out.append((start, size))
        start += size
    return out


PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("doc_tokens", pa.int64())])


def cut(text, path, end=END, most=MOST):
    """The pieces of a text column, each with its ids as little-endian 32-bit integers."""
    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids:binary,doc_tokens:bigint>>")
    def run(values: pa.Array) -> pa.Array:
        tail, out = end.to_bytes(4, "little"), []
        for texts in runs(values):
            own = []
            for ids in words(path).encode(texts):
                ids += tail
                n = len(ids) // 4
                own.append([{"start": s, "length": k, "ids": ids[4 * s:4 * (s + k)],
                             "doc_tokens": n} for s, k in cuts(n, most)])
            out.append(pa.array(own, pa.list_(PIECE)))
        return pa.concat_arrays(out or [pa.array([], pa.list_(PIECE))])
    return run(text)


def pieces(docs, path=None, text="text", keep=("doc_id",), end=END, most=MOST):
    """One row per piece, with the columns in ``keep``; ``sequence_id`` is unique.

    Sequence numbers hold for one run of the plan: write the pieces before they
    are read more than once.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    found = docs.select(*keep, F.explode(cut(F.col(text), path, end, most)).alias("__piece"))
    return (found.select(*keep, "__piece.*")
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("bigint")))


def write_buckets(packed, path):
    """Sequences laid out by length: a reader takes batches of equal lengths from one folder."""
    packed.write.partitionBy("length").parquet(path)


def digest(docs, path=None, id_column="doc_id", text="text"):
    return (pieces(docs, path, text, (id_column,))
            .select(id_column, "start", "length", F.crc32("ids").alias("ids_crc32"),
                    "doc_tokens", "sequence_id", "offset"))
