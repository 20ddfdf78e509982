"""Byte-level BPE encoding and decoding by merges over padded matrices.

Distinct pre-tokens of a batch are put into matrices by length; each round,
every row merges its leftmost pair of least rank. Ranks of pairs come from an
open-addressing hash table in numpy; rows without a pair left are taken out
and the matrix gets one column narrower per round.

``encode`` and ``decode`` are column functions: ids are the little-endian
unsigned 32-bit integers of a text in one binary value (``ids_to_array`` turns
them into an array). Null encodes as the empty text; repeated rows, ties and
other columns play no part, as each value depends on its own text alone. Texts of
any length are encoded whole; an empty table gives no rows.
"""

import base64
import functools
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm import pretokens
from worktrail.llm.common import Cache

NONE = np.int32(2**31 - 1)
CELLS = 1 << 18  # matrix cells per block of rows
LONG = 1024  # bytes; beyond it a pre-token is merged by a heap in n log n steps
CACHED = 500_000  # text parts kept per worker and generation
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that two tokens make together, by open addressing."""

    def __init__(self, left, right, rank):
        self.bits = max(4, int(len(left) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slots[rest]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]] = keys[put]
            self.ranks[slots[put]] = rank[put]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Ranks of the pairs; NONE where they make no token or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NONE)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        out = out.reshape(left.shape)
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    def __init__(self, path):
        self.ranks = read_ranks(path)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(*(np.array(x, np.int32) for x in (left, right, rank)))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        self.tokens = [b""] * (by_id[-1][1] + 1)
        for token, r in by_id:
            self.tokens[r] = token
        self.cache = Cache(CACHED)

    def merge_block(self, words):
        """Ids of byte strings of at most LONG bytes, as bytes each."""
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[
            np.frombuffer(b"".join(words), np.uint8)]
        out, where = [b""] * n, np.arange(n)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), NONE)
        while len(where):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(where)), at]
            done = least == NONE
            if done.any():
                rows = ids[done]
                sizes = (rows >= 0).sum(1)
                flat, end = rows[rows >= 0].astype("<u4").tobytes(), np.cumsum(sizes) * 4
                for i, e, s in zip(where[done].tolist(), end.tolist(), (sizes * 4).tolist(),
                                   strict=True):
                    out[i] = flat[e - s:e]
                going = ~done
                ids, ranks, where = ids[going], ranks[going], where[going]
                at, least = at[going], least[going]
                if not len(where):
                    break
            row = np.arange(len(where))
            ids[row, at] = least
            # Each row that goes on gets one id shorter, so the last column falls free.
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            if ids.shape[1] == 1:
                ranks = np.full((len(where), 1), NONE, np.int32)
                continue
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            here, width = ids[row, at], ids.shape[1]
            before, behind = at > 0, at < width - 1
            ranks[row[before], at[before] - 1] = self.pairs.find(
                ids[row[before], at[before] - 1], here[before])
            ranks[row[behind], at[behind]] = self.pairs.find(
                here[behind], ids[row[behind], at[behind] + 1])
        return out

    def merge_long(self, word):
        """The same merges for one very long pre-token, by a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i):
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, words):
        """Ids of distinct byte strings, as bytes each."""
        out, short = [None] * len(words), []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self.merge_long(w)
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        i = 0
        while i < len(short):
            # One block: lengths within a factor of 1.25, and a bounded number of cells.
            most = len(words[short[i]]) * 5 // 4
            j = i
            while j < len(short) and len(words[short[j]]) <= most and (j - i) * most < CELLS:
                j += 1
            for k, ids in zip(short[i:j], self.merge_block([words[k] for k in short[i:j]]),
                              strict=True):
                out[k] = ids
            i = j
        return out

    def parts(self, new):
        """part -> ids as bytes, for a set of text parts."""
        split = [pretokens.pieces(x) for x in new]
        distinct = list(set().union(*split))
        ids = dict(zip(distinct, self.merge([p.encode() for p in distinct]), strict=True))
        return {x: ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])
                for x, own in zip(new, split, strict=True)}

    def encode(self, texts):
        keys = [pretokens.chunks(x) if x else [] for x in texts]
        return [b"".join(row) for row in self.cache.rows(keys, self.parts)]

    def decode(self, ids):
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def encoder(path):
    return Encoder(path)


def slices(values, most=4 << 20):
    """Runs of values of about ``most`` bytes in all, so a batch of long texts stays small."""
    run, size = [], 0
    for x in values:
        run.append(x)
        size += len(x) if x else 0
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(text, path):
    """Ids of a text column by the ranks at ``path``; null counts as empty."""
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([y for xs in slices(texts.to_pylist()) for y in enc.encode(xs)],
                        pa.binary())
    return run(text)


def decode(ids, path):
    """Bytes of an ids column; null decodes as empty."""
    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.decode(x or b"") for x in values.to_pylist()], pa.binary())
    return run(ids)


def ids_to_array(ids):
    """An ids column as array<int>."""
    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x or b"", "<i4") for x in values.to_pylist()],
                        pa.list_(pa.int32()))
    return run(ids)


def digest(docs, path=None, id_column="doc_id", text="text"):
    """Per row: tokens, hash of the ids, and hash of the bytes decoded from them."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return (docs.select(id_column, encode(F.col(text), path).alias("ids"))
            .select(id_column, "ids", decode(F.col("ids"), path).alias("decoded"))
            .select(id_column, (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))
