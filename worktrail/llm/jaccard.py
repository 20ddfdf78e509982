"""Self join of documents by Jaccard similarity of word shingles, with a token-group matrix.

Texts with the same shingle set form a class. What follows works on classes.

1. Grouping. Classes that agree in two minhashes at once, in one of three bands,
   are compared with one leader per band bucket: as many comparisons as members.
   Those at least half alike hang together in a group of similar documents; all
   others are groups of one. Those that link make up the cores of a group.
2. Token-group matrix. Tokens (shingles) have one global order, frequent ones
   last: those counted as frequent, and those whose words are, as the product of
   their words' shares tells how often they meet by chance. For any count l, two sets that link have at least l tokens in common
   within the first n - ceil(t n) + l tokens of the larger one and the first
   m - ceil(2 t m / (1 + t)) + l tokens of the smaller one: otherwise too many
   tokens would have come before the common ones. l is 2 and SHARE of the
   smaller size, so that a passage which two texts share does not bring them
   together. The matrix has a cell for each such token and group, the union over
   the group's members by size class. Pairs of groups with fewer common cells
   hold no link. A family of texts that miss the threshold is one group, so its
   cells are counted once, not once per pair of its texts.
3. Qualifying pairs of groups, and groups of more than one core, are opened in
   blocks of members of one size class; only classes whose sizes fit meet. A
   document's overlap with a block's token union bounds its overlap with any
   member; what is left is counted as a product of 0/1 matrices, some thousand
   tokens at a time.

Members of one core are connected already; a core of BLOCK or more has blocks of
its own, which are never compared with each other. So a large set of near copies
costs one comparison per member. Every two cores that hold a link are found, so
components are exact. Only bounded data is broadcast: at most HOT frequent
tokens and WORDS frequent words, and a filter of fixed size.

Sets and classes are told apart by 64-bit hashes; for ten million documents
the chance that any two classes clash is about 3 in a million.

Null or empty texts have an empty set and link with nothing. Repeated or null
ids keep their rows; a component's id is the smallest id in it, null where all its
ids are null. Other columns are not read. Texts of any length are read whole. Of texts
that could lead a group the one with most copies, then the smallest id, does. An empty
table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from worktrail.llm import urls
from worktrail.llm.common import Cache, runs, small_batches, stored
from worktrail.llm.components import components
from worktrail.operators.ranking import salted_lookup

SHARE = 0.02  # of the smaller set, to be found in common among the first tokens
BANDS, ROWS = 3, 2
HOT, WORDS = 1 << 20, 1 << 18  # frequent tokens and words at most: those with as great a share
FAINT = 8  # tokens expected 2 ** -FAINT times or less are all equally rare
FLUSH, REPEATS = 2_000_000, 4  # shingles counted at a time; repeats within them to be reported
BLOCK, BLOCK_BYTES = 256, 1 << 20  # sets, and bytes of their tokens, expected in a block
CHUNK = 4096  # common tokens per matrix product
SALTS = 8  # tasks over which the members of one group are spread
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PERM = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD,
                  0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def word_hashes(text):
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def windows(w, k):
    """Hashes of all k-word shingles of the words ``w``, of all words where these are fewer."""
    n, size = len(w), min(k, len(w))
    if not n:
        return w
    x = w[:n - size + 1] + np.uint64(size)
    for j in range(1, size):
        x = mixed(x) * _M1 + w[j:n - size + 1 + j]
    return mixed(x)


def shingles(text, k):
    """Sorted distinct hashes of a text's k-word shingles (A-Z in lower case)."""
    return np.unique(windows(word_hashes(text), k))


def found_in(table, keys):
    """Places of ``keys`` in the sorted ``table``, and which of them are in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def rated_shingles(text, k, words, share):
    """``shingles`` and for each the logarithm (base 2) of the product of its words' shares."""
    w = word_hashes(text)
    tokens, first = np.unique(windows(w, k), return_index=True)
    at, known = found_in(words, w)
    each = np.full(len(w), -np.log2(2.0 * WORDS))
    each[known] = share[at[known]]
    size = min(k, len(w))
    total = np.zeros(len(w) - size + 1)
    for j in range(size):
        total += each[j:len(w) - size + 1 + j]
    return tokens, total[first]


def class_id(tokens):
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(),
                          "little", signed=True)


def bands(tokens):
    least = [int((mixed(tokens * p)).min()) for p in _PERM[:BANDS * ROWS]]
    return [xxhash.xxh64_intdigest(repr((i, least[i * ROWS:(i + 1) * ROWS]))) >> 1
            for i in range(BANDS)]


def _signed(x):
    return np.ascontiguousarray(x).view(np.int64)


def outline(docs, k, id_column, text):
    """Stored: per document id, n, c (class) and bands; and repeated tokens and words with counts.

    Rows of the second sort have n null, the token or word in c, its count in ``count``
    and in ``word`` which of them it is.
    """
    id_type = docs.select(id_column).schema[0].dataType.simpleString()
    names = ["id", "n", "c", "bands", "count", "word"]

    def out(kinds, ids, n, c, b, count, word):
        return pa.RecordBatch.from_arrays([
            pa.array(ids, kinds), pa.array(n, pa.int64()), pa.array(c, pa.int64()),
            pa.array(b, pa.list_(pa.int64())), pa.array(count, pa.int64()),
            pa.array(word, pa.bool_())], names)

    def repeats(kinds, held, word):
        held.sort()
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        count = np.diff(np.r_[first, len(held)])
        tokens, count = held[first[count >= REPEATS]], count[count >= REPEATS]
        none = [None] * len(tokens)
        return out(kinds, none, none, _signed(tokens), none, count, [word] * len(tokens))

    def run(batches):
        Cache.release()
        # What is counted: tokens and words, each with room for FLUSH of them.
        held, sizes, kinds = (np.empty(FLUSH, np.uint64), np.empty(FLUSH, np.uint64)), [0, 0], None
        for batch in batches:
            kinds = batch.column(0).type
            rows = []
            for x in (x for xs in runs(batch.column(1)) for x in xs):
                words = word_hashes(x)
                tokens = np.unique(windows(words, k))
                if len(tokens):
                    rows.append((len(tokens), class_id(tokens), bands(tokens)))
                else:
                    rows.append((0, None, None))
                for i, new in enumerate((tokens, words)):
                    while len(new):
                        part, new = new[:FLUSH - sizes[i]], new[FLUSH - sizes[i]:]
                        held[i][sizes[i]:sizes[i] + len(part)] = part
                        sizes[i] += len(part)
                        if sizes[i] == FLUSH:
                            yield repeats(kinds, held[i], i == 1)
                            sizes[i] = 0
            if rows:
                n, c, b = zip(*rows, strict=True)
                none = [None] * len(n)
                yield out(kinds, batch.column(0), n, c, b, none, none)
        for i, size in enumerate(sizes):
            if size:
                yield repeats(kinds, held[i][:size], i == 1)

    return stored(docs.select(id_column, text).mapInArrow(
        run, f"id {id_type}, n bigint, c bigint, bands array<bigint>, count bigint, word boolean"),
        "outline")


def frequent(rows, total, most, word):
    """Sorted tokens or words with 1 / ``most`` of ``total`` or more, and the log2 of their counts.

    The ``most`` most frequent are enough: they only set the order of tokens.
    """
    found = (rows.filter(F.col("word") == word).groupBy("c").agg(F.sum("count").alias("count"))
             .filter(F.col("count") * most >= F.lit(total))
             .orderBy(F.desc("count"), "c").limit(most).toPandas())
    keys = found["c"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log2(found["count"].to_numpy(np.int64)[order].astype(float))


def rarity(rows):
    """What orders tokens: frequent ones, frequent words' shares, log2 of the number of tokens."""
    total = max(rows.agg(F.sum("n")).first()[0] or 0, 1)
    words, count = frequent(rows, total, WORDS, True)
    return *frequent(rows, total, HOT, False), words, np.minimum(count - np.log2(total), 0), np.log2(total)


def needed(n):
    """Common first tokens that a pair must have whose smaller set has n tokens."""
    return 2 + int(SHARE * n)


def prefix_sizes(n, num, den):
    """How many first tokens count when a set is the larger, and when it is the smaller one."""
    return (min(n, n - -(-num * n // den) + needed(n)),
            min(n, n - -(-2 * num * n // (den + num)) + needed(n)))


def prefixes(docs, k, num, den, hot, text):
    """(c, n, tokens, short): the first tokens of every set that can link with another set.

    The first ``short`` of them count when the set is the smaller one of a pair.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    least = -(-num // (den - num))

    def run(batches):
        Cache.release()
        hot_, count, words, share, total = shared.value
        for batch in batches:
            for texts in runs(batch.column(0)):
                rated = [r for x in texts
                         if len((r := rated_shingles(x, k, words, share))[0]) >= least]
                if not rated:
                    continue
                sets = [s for s, _ in rated]
                whole = np.concatenate(sets)
                # The greater of the number expected by chance and the number counted.
                level = np.concatenate([e for _, e in rated]) + total
                at, known = found_in(hot_, whole)
                level[known] = np.maximum(level[known], count[at[known]])
                level = np.clip(level + FAINT, 0, 31).astype(np.uint64)
                order = (mixed(whole * _M1) >> np.uint64(5)) | (level << np.uint64(59))
                out, end = [], 0
                for s in sets:
                    own = order[end:end + len(s)]
                    end += len(s)
                    m, short = prefix_sizes(len(s), num, den)
                    first = np.argpartition(own, m - 1)[:m]
                    first = first[np.argsort(own[first])]
                    out.append((class_id(s), len(s), _signed(s[first]), short))
                c, n, first, short = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(first, pa.list_(pa.int64())), pa.array(short, pa.int32())],
                    ["c", "n", "tokens", "short"])

    return docs.select(text).mapInArrow(
        run, "c bigint, n bigint, tokens array<bigint>, short int")


def whole_sets(docs, wanted, k, id_column, text):
    """``wanted`` (c, id of a member, and more) with the classes' sets as ``tokens``.

    A filter of fixed size on the ids keeps other texts out of the join.
    """
    def key(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    @F.arrow_udf("struct<c:bigint,tokens:binary>")
    def sets(texts: pa.Array) -> pa.Array:
        Cache.release()
        kind = pa.struct([("c", pa.int64()), ("tokens", pa.binary())])
        out = [pa.array([{"c": class_id(s), "tokens": s.tobytes()}
                         for s in (shingles(x, k) for x in xs)], kind) for xs in runs(texts)]
        return pa.concat_arrays(out or [pa.array([], kind)])

    more = [c for c in wanted.columns if c not in ("c", "id")]
    wanted = wanted.select("c", key("id").alias("key"), *more)
    rows = docs.select(key(id_column).alias("key"), F.col(text).alias("text"))
    block, words = urls.bits("key")
    rows = rows.withColumn("block", block).join(
        F.broadcast(urls.bloom(wanted.select("key").distinct(), "key")), "block")
    for i, w in enumerate(words):
        rows = rows.filter(F.col(f"w{i}").bitwiseAND(w) == w)
    # Rows that repeat an id and a text count once; the join has brought them together.
    return (rows.select("key", "text").join(wanted, "key")
            .select("key", "c", *more, sets(F.col("text")).alias("s"))
            .filter(F.col("s.c") == F.col("c"))
            .select("key", "c", *more, F.col("s.tokens").alias("tokens"))
            .dropDuplicates(["key", "c"]).drop("key"))


def overlap(a, b):
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64),
                              assume_unique=True))


def compared_with_leaders(docs, classes, pairs, num, den, k, id_column, text):
    """``pairs`` (u, v) with ``alike``: 2 where the whole sets link, 1 where half alike, else 0.

    A set travels once to each of its leaders, of which it has one per band.
    """
    @F.arrow_udf("int")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = x.as_py(), y.as_py()
            both, total = overlap(x, y), (len(x) + len(y)) // 8
            out.append(2 if den * both >= num * (total - both) else int(3 * both >= total))
        return pa.array(out, pa.int32())

    to = (pairs.select(F.col("u").alias("c"), F.col("v").alias("t"))
          .union(pairs.select(F.col("v").alias("c"), F.col("v").alias("t"))).distinct()
          .groupBy("c").agg(F.collect_set("t").alias("to")))
    wanted = classes.select("c", "id").join(to, "c")
    sets = stored(whole_sets(docs, wanted, k, id_column, text), "sets")
    rows = sets.select("c", F.explode("to").alias("v"), "tokens")
    lead = rows.filter("c = v").select("v", F.col("tokens").alias("b"))
    return (rows.filter("c <> v").select(F.col("c").alias("u"), "v", F.col("tokens").alias("a"))
            .join(lead, "v").select("u", "v", alike(F.col("a"), F.col("b")).alias("alike")))


def leaders(classes):
    """(u, v): each class with the leader of its band buckets."""
    each = classes.select("c", "copies", "id", F.posexplode("bands").alias("i", "band"))
    lead = (each.groupBy("i", "band")
            .agg(F.min_by("c", F.struct(-F.col("copies"), "id", "c")).alias("v"),
                 F.count("*").alias("size")).filter("size > 1").select("i", "band", "v"))
    return (each.join(lead, ["i", "band"]).filter("c <> v")
            .select(F.col("c").alias("u"), "v").distinct())


def size_step(num, den):
    return float(np.log(den / num) * 1.000001)


def size_class(n, num, den):
    """Sets that link are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / size_step(num, den)).cast("int")


def common_cells(cells):
    """The cells of tokens that can bring two groups together, in one shuffle.

    ``short`` tells whether the token counts for a smaller set of the group.
    """
    own = Window.partitionBy("token")
    return (cells.repartition("token").groupBy("token", "g", "size")
            .agg(F.max("short").alias("short"))
            .withColumn("a", F.min("g").over(own)).withColumn("b", F.max("g").over(own))
            .withColumn("any", F.max("short").over(own))
            .filter("a <> b and any").select("token", "g", "size", "short"))


def qualifying(common, num, den):
    """(g, own, h, size): size classes of two groups with as many common cells as a link needs.

    ``own`` is ``size`` or the next smaller class; of equal ones g < h.
    """
    smaller = common.filter("short").select("token", "g", F.col("size").alias("own"), F.explode(
        F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    larger = common.select("token", F.col("g").alias("h"), "size")
    least = F.exp(F.col("own") * size_step(num, den)) * (1 - 1e-9)  # size of the class's sets
    swap = (F.col("own") == F.col("size")) & (F.col("g") > F.col("h"))
    return (smaller.join(larger, ["token", "size"]).filter("g <> h")
            .groupBy("g", "own", "h", "size").agg(F.count("*").alias("cells"))
            .filter(F.col("cells") >= 2 + F.floor(least * SHARE))
            .select(F.when(swap, F.col("h")).otherwise(F.col("g")).alias("g"), "own",
                    F.when(swap, F.col("g")).otherwise(F.col("h")).alias("h"), "size").distinct())


def placed(classes, groups, cores, num, den):
    """(c, id, n, g, r, size, kin): each class's group, core and size class.

    ``kin`` is the core where it has BLOCK classes or more, else 0.
    """
    large = (cores.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("many"))
             .filter(F.col("many") >= BLOCK))
    own = (classes.select("c", "id", "n")
           .join(groups.select(F.col("u").alias("c"), F.col("root").alias("g")), "c", "left")
           .join(cores.select(F.col("u").alias("c"), F.col("root").alias("r")), "c", "left")
           .select("c", "id", "n", F.coalesce("g", "c").alias("g"), F.coalesce("r", "c").alias("r"),
                   size_class(F.col("n"), num, den).alias("size")))
    return salted_lookup(own, large, ["r"], ["c"], "left", SALTS).select(
        "c", "id", "n", "g", "r", "size",
        F.when(F.col("many").isNotNull(), F.col("r")).otherwise(F.lit(0)).alias("kin"))


def within(places):
    """(g, own, h, size) with h = g: size classes of one group that hold more than one core."""
    each = places.groupBy("g", "size").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    # A group has as many rows here as size classes: about 100 at most.
    next_one = F.lead(F.struct("size", "lo", "hi")).over(Window.partitionBy("g").orderBy("size"))
    each = each.withColumn("b", next_one)
    alone = each.filter("lo <> hi").select("g", F.col("size").alias("own"), F.col("g").alias("h"),
                                           "size")
    two = each.filter("b.size = size + 1 and least(lo, b.lo) <> greatest(hi, b.hi)").select(
        "g", F.col("size").alias("own"), F.col("g").alias("h"), F.col("b.size").alias("size"))
    return alone.unionByName(two)


def overlaps(mine, theirs, num, den):
    """How many tokens each two of the sets share, 0 where a union's bound rules out a link."""
    common = np.intersect1d(np.concatenate(mine), np.concatenate(theirs))
    out = np.zeros((len(mine), len(theirs)), np.int64)

    def found(sets):
        tokens, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        own = np.repeat(np.arange(len(sets)), sizes)
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        near = common[at] == tokens
        near &= (den * np.bincount(own[near], minlength=len(sets)) >= num * sizes)[own]
        at, own = at[near], own[near]
        order = np.argsort(at, kind="stable")
        return at[order], own[order]

    if not len(common):
        return out
    (at, a), (to, b) = found(mine), found(theirs)
    if not len(at) or not len(to):
        return out
    for start in range(0, len(common), CHUNK):
        x, y = (np.searchsorted(v, [start, start + CHUNK]) for v in (at, to))
        left = np.zeros((len(mine), CHUNK), np.float32)
        right = np.zeros((len(theirs), CHUNK), np.float32)
        left[a[x[0]:x[1]], at[x[0]:x[1]] - start] = 1
        right[b[y[0]:y[1]], to[y[0]:y[1]] - start] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def open_blocks(mine, theirs, num, den):
    """Edges between cores of two blocks, enough to connect all that hold a link.

    ``mine`` and ``theirs`` are lists of (core, tokens).
    """
    (r, a), (s, b) = ((np.array([c for c, _ in z], np.int64),
                       [np.frombuffer(t, np.uint64) for _, t in z]) for z in (mine, theirs))
    both = overlaps(a, b, num, den)
    total = np.add.outer([len(x) for x in a], [len(x) for x in b])
    i, j = np.nonzero((den * both >= num * (total - both)) & (r[:, None] != s[None, :]))
    up, edges = {}, []

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for u, v in set(zip(r[i].tolist(), s[j].tolist(), strict=True)):
        x, y = top(u), top(v)
        if x != y:
            up[x] = y
            edges.append((u, v))
    return edges


def opened(docs, near, places, num, den, k, id_column, text):
    """Edges (u, v) between cores that hold a link, of the size classes in ``near``.

    The members of a group, size class and large core are dealt into blocks, and
    each two blocks that may hold a link of two cores are compared on their own.
    """
    box, keys = ["g", "size", "kin"], ["g", "size"]
    open_ids = near.select("g", F.col("own").alias("size")).union(near.select("h", "size")).distinct()
    members = stored(salted_lookup(places, open_ids, keys, ["c"], "left_semi", SALTS), "members")
    boxes = members.groupBy(*box).agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    wanted = (salted_lookup(members, boxes, box, ["c"], "inner", SALTS)
              .select("c", "id", "r", *box, F.pmod(F.xxhash64("c"), "blocks").alias("block")))
    held = (whole_sets(docs, wanted, k, id_column, text).groupBy(*box, "block")
            .agg(F.collect_list(F.struct("r", "tokens")).alias("sets")))

    @F.arrow_udf("array<struct<u:bigint,v:bigint>>")
    def edges(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            found = open_blocks(*([(q["r"], q["tokens"]) for q in z.as_py()] for z in (x, y)),
                                num, den)
            out.append([{"u": u, "v": v} for u, v in found])
        return pa.array(out, pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())])))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    ours = boxes.withColumnRenamed("size", "own")
    other = boxes.select(F.col("g").alias("h"), "size", F.col("kin").alias("kind"),
                         F.col("blocks").alias("others"))
    two = (near.join(ours, ["g", "own"]).join(other, ["h", "size"])
           .filter("g <> h or kin <> kind or kin = 0")
           .select("g", "own", "kin", "h", "size", "kind", "others", numbers("blocks").alias("block"))
           .select("g", "own", "kin", "block", "h", "size", "kind", numbers("others").alias("other"))
           .filter("g <> h or own <> size or kin < kind or (kin = kind and block <= other)"))
    left = held.withColumnRenamed("size", "own").withColumnRenamed("sets", "a")
    right = held.select(F.col("g").alias("h"), "size", F.col("kin").alias("kind"),
                        F.col("block").alias("other"), F.col("sets").alias("b"))
    return (two.join(left, ["g", "own", "kin", "block"])
            .select("h", "size", "kind", "other", "a").join(right, ["h", "size", "kind", "other"])
            .select(F.explode(edges(F.col("a"), F.col("b"))).alias("e")).select("e.*"))


def link(docs, k=3, num=90, den=100, id_column="doc_id", text="text"):
    """Per document: id, n_shingles, c (class), component_id.

    Documents link when den * intersection >= num * union of their shingle sets.
    Arrow batches are bounded in the session from here on.
    """
    small_batches(docs.sparkSession)
    rows = outline(docs, k, id_column, text)
    own = rows.filter("n is not null")
    classes = stored(own.filter("n > 0").groupBy("c").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.count("*").alias("copies")), "classes")

    # 1. Groups of similar documents around leaders, and their cores of linked ones.
    least = -(-num // (den - num))
    able = classes.filter(F.col("n") >= least)
    pairs = stored(leaders(able), "pairs")
    compared = stored(compared_with_leaders(
        docs, classes, pairs, num, den, k, id_column, text), "compared")
    cores = stored(components(compared.filter("alike = 2")), "cores")
    groups = stored(components(compared.filter("alike > 0")), "groups")
    places = stored(placed(able, groups, cores, num, den), "places")

    # 2. The matrix of tokens and groups.
    first = prefixes(docs, k, num, den, rarity(rows), text).dropDuplicates(["c"])
    cells = (first.join(places.select("c", "g", "size"), "c")
             .select("g", "size", "short", F.posexplode("tokens").alias("at", "token"))
             .withColumn("short", F.col("at") < F.col("short")).drop("at"))
    near = qualifying(stored(common_cells(cells), "cells"), num, den)
    near = stored(near.unionByName(within(places)), "near")

    # 3. Open what qualifies.
    edges = stored(opened(docs, near, places, num, den, k, id_column, text), "links")

    # Components of all links, and the smallest id in each.
    every = (cores.select("u", F.col("root").alias("v")).filter("u <> v")
             .unionByName(edges.select("u", "v")))
    roots = components(every).withColumnRenamed("u", "c")
    of = (classes.select("c", "id").join(roots, "c", "left")
          .select("c", "id", F.coalesce("root", "c").alias("root")))
    names = of.groupBy("root").agg(F.min("id").alias("component_id"))
    of = of.join(names, "root").select("c", "component_id")
    return (own.select("id", "n", "c").join(of, "c", "left")
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "c",
                    F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def one_of_each(docs, k=5, num=80, den=100, id_column="doc_id", text="text"):
    """The documents without those that link, also by others, with one of a smaller id.

    Rows are told apart by id and text; of rows that repeat both, one stays.
    Documents without words all stay. Only rows that may go are shuffled.
    """
    mark = F.xxhash64(text)

    def key(value, hashed):
        return F.concat(F.coalesce(value.cast("string"), F.lit("null")), F.lit(":"),
                        hashed.cast("string"))

    named = docs.select(F.struct(F.col(id_column).alias("id"), mark.alias("mark")).alias("key"),
                        F.col(text).alias("text"))
    found = stored(link(named, k, num, den, "key", "text").filter("c is not null"), "linked")
    gone = found.filter("key <> component_id").select("key").distinct()
    again = (found.filter("key = component_id").groupBy("key").agg(F.count("*").alias("n"))
             .filter("n > 1").select("key"))
    of = key(F.col("key.id"), F.col("key.mark")).alias("key")
    gone, again = gone.select(of), stored(again.select(of), "again")
    own = key(F.col(id_column), mark)
    once = docs.withColumn("__key", own).join(
        again.withColumnRenamed("key", "__key"), "__key", "left_semi")
    once = once.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return urls.without(docs, own, gone.union(again)).unionByName(once)


def digest(docs):
    return link(docs).select("doc_id", "n_shingles", "component_id")
