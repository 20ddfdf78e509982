"""The stored text index: segments of posting blocks, one manifest.

A segment numbers its documents in order of id and keeps, per term, blocks of at
most ``BLOCK`` postings: document numbers as offsets from the block's first one,
token counts, term frequencies and places. A term's postings are cut into blocks in
order of their weight, so a block's best possible score lies near its real ones and a
top-k query reads only blocks that can still reach the k-th score. Documents carry
their event's date and time, so a hit is fetched from its own day and row groups.

Blocks are made by the task that numbers their documents, so postings aren't shuffled;
tasks are as many as the size of the texts asks for, so a term found in every document
is spread over them. Merging deals blocks, not postings. Removed
documents are listed by number, with the document counts their terms lose. Segments
are merged by levels; a merge leaves removed documents out.
"""

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions import porter, times
from worktrail.operators import search as X
from worktrail.sources.manifest import Entry, Manifest, due, facts, read_parts

BLOCK, TIERS, SPAN_BITS = 128, 16, 20
FANOUT = 8
#: Document numbers: segment, task and place within the task.
SEGMENT_BITS, TASK_BITS = 40, 24
#: Up to so many postings are scored at once; beyond, blocks are pruned first.
SCORED_AT_ONCE = 65_536
FIRST_BLOCKS = 64
#: A segment of so few tokens is one sorted table. Of a larger one each task that numbers
#: documents writes a sorted table, and merging partitions it by bucket.
FLAT_TOKENS = 2_000_000
#: A merge opens the blocks of about so many tokens in one task, at least a bucket's.
SHARE_TOKENS = 4_000_000
KNOWN_TERMS = 10_000
#: Texts of so many bytes are numbered and cut into blocks by one task.
TASK_BYTES = 32_000_000
#: Stemmed words are short (the stemmer leaves long ones alone), so this many are a few MB.
BROADCAST_STEMS = 200_000

DOCS = "doc bigint, id string, event_date date, timestamp timestamp"
BLOCKS = ("term string, first bigint, last bigint, n int, max_tf int, min_tokens int, "
          "docs array<int>, tokens array<int>, tfs array<int>, spots array<array<int>>, term_bucket int")
ADJUST = "term string, df bigint"
GONE = "doc bigint"


def weight(tf, n_tokens, avg):
    """What a posting scores but for the term's rarity; grows with tf, falls with length."""
    return tf * (X.K1 + 1) / (tf + X.K1 * (1 - X.B + X.B * n_tokens / avg))


def tasks_for(docs):
    """Tasks that number ``docs``, by the size of their texts; at least the session's."""
    size = docs.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in X.COLUMNS))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // TASK_BYTES)


def numbered_docs(docs, number, columns, tasks):
    """``columns`` of each document with its number, ``doc``, and the ``task`` that gives it.

    Documents are dealt by a hash of the id and sorted by it, so the numbers are the
    same whenever and for whichever columns they are made, and rise with id within a
    task. The plan knows that a task holds all of its documents.
    """
    dealt = docs.select("id", *columns, F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int").alias("task"))
    ordered = dealt.repartitionById(tasks, "task").sortWithinPartitions("id")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    doc = F.lit(number << SEGMENT_BITS) + F.shiftleft(F.col("task").cast("bigint"), TASK_BITS) + place
    return ordered.select(doc.alias("doc"), "id", *columns, "task")


def n_tokens():
    return sum((F.size(X.written_tokens(F.col(c))) for c in X.COLUMNS[1:]),
               F.size(X.written_tokens(F.col(X.COLUMNS[0]))))


def document_words(texts):
    """(doc, n_tokens, word, spots): places of a word in a document, as 2 * place + column.

    A document's words are grouped within its row: sorted, and cut where a new word
    begins. Each step is its own projection, so no array is built more than once.
    """
    kept = ["doc", *(c for c in texts.columns if c == "task")]
    split = texts.select(*kept, *[X.tokens(F.col(c)).alias(c) for c in X.COLUMNS])
    total = sum((F.size(c) for c in X.COLUMNS[1:]), F.size(X.COLUMNS[0]))

    def placed(number, name):
        return F.transform(name, lambda t, i: F.struct(
            t.alias("word"), (2 * i + number).alias("spot")))

    spots = F.array_sort(F.concat(*[placed(n, c) for n, c in enumerate(X.COLUMNS)]))
    rows = split.select(*kept, total.alias("n_tokens"), spots.alias("places"))
    begins = F.transform("places", lambda p, i: F.when(
        (i == 0) | (p["word"] != F.get("places", i - 1)["word"]), i))
    rows = rows.withColumn("begins", F.filter(begins, lambda i: i.isNotNull()))
    words = F.transform("begins", lambda at, i: F.struct(
        F.get("places", at)["word"].alias("word"),
        F.transform(F.slice("places", at + 1, F.coalesce(F.get("begins", i + 1), F.size("places")) - at),
                    lambda p: p["spot"]).alias("spots")))
    return rows.select(*kept, "n_tokens", F.inline(words))


def changed_words(words):
    """(word, stem) of each distinct word whose stem differs: Python sees the vocabulary once."""
    return (words.select("word").distinct().withColumn("stem", porter.stem_terms("word"))
            .filter("stem <> word"))


def with_terms(words, stems, n_stems):
    """``words`` with their ``term`` for ``word``. Words of one stem are rows apart."""
    if n_stems <= BROADCAST_STEMS:
        stems = F.broadcast(stems)
    kept = [c for c in words.columns if c not in ("word", "spots")]
    return words.join(stems, "word", "left").select(
        *kept, F.coalesce("stem", "word").alias("term"), "spots")


def blocks_of(rows, avg, apart=False):
    """Blocks from (doc, n_tokens, term, spots); ``apart`` where a term of a document may have many rows.

    A block lies within a span. Rows with a ``task`` by which they are dealt already, all
    rows of a term and span to one, aren't moved.
    """
    keys = ["term_bucket", "span", "term"]
    whole = rows.withColumn("term_bucket", X.term_bucket("term")).withColumn("span", F.shiftright("doc", SPAN_BITS))
    if "task" in rows.columns:
        keys = ["task", *keys]
    else:
        whole = whole.repartition("term_bucket", "span")
    if apart:
        whole = whole.groupBy(*keys, "doc", "n_tokens").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    whole = whole.select(*keys, "doc", "n_tokens", "spots", F.size("spots").alias("tf"))
    tier = F.floor(weight(F.col("tf").cast("double"), F.col("n_tokens"), F.lit(max(float(avg), 1.0)))
                   / (X.K1 + 1) * TIERS)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("tier"), "doc"))
    cut = whole.withColumn("tier", tier).withColumn("block", F.floor((place - 1) / BLOCK))
    made = cut.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct("doc", "n_tokens", "tf", "spots"))).alias("p"),
        F.max("tf").alias("max_tf"), F.min("n_tokens").alias("min_tokens"))
    first, last = F.element_at("p", 1)["doc"], F.element_at("p", -1)["doc"]
    return made.select(
        "term", first.alias("first"), last.alias("last"), F.size("p").alias("n"), "max_tf", "min_tokens",
        F.transform("p", lambda x: (x["doc"] - first).cast("int")).alias("docs"),
        F.transform("p", lambda x: x["n_tokens"]).alias("tokens"),
        F.transform("p", lambda x: x["tf"]).alias("tfs"),
        F.transform("p", lambda x: x["spots"]).alias("spots"), "term_bucket")


def dealt_blocks(blocks, n_tokens):
    """Blocks dealt as they are, with their ``task``: a bucket, or a share of its spans where it is large."""
    shares = max(1, int(n_tokens) // (X.BUCKETS * SHARE_TOKENS))
    span = F.shiftright("first", SPAN_BITS)
    task = F.col("term_bucket") * shares + F.pmod(F.xxhash64(span), F.lit(shares)).cast("int")
    return (blocks.select("term", "term_bucket", "first", "docs", "tokens", "spots", task.alias("task"))
            .repartitionById(X.BUCKETS * shares, "task"))


def unpacked(blocks, spots=False):
    """One row per posting: term, term_bucket, doc, n_tokens, tf and perhaps spots."""
    columns = ["docs", "tokens", "tfs"] + ["spots"] * spots
    rows = blocks.select("term", "term_bucket", "first", F.inline(F.arrays_zip(*columns)))
    return rows.select("term", "term_bucket", (F.col("first") + F.col("docs")).alias("doc"),
                       F.col("tokens").alias("n_tokens"), F.col("tfs").alias("tf"), *["spots"] * spots)


@dataclass(frozen=True)
class StoredIndex:
    """What a manifest version names. ``gone`` and ``adjust`` are None without removals."""

    docs: DataFrame
    blocks: DataFrame
    gone: DataFrame | None
    adjust: DataFrame | None
    n_docs: int
    n_tokens: int
    known: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def avg_tokens(self):
        return self.n_tokens / self.n_docs if self.n_docs else 0.0

    def but_gone(self, rows):
        return rows if self.gone is None else rows.join(self.gone, "doc", "left_anti")

    def live_docs(self):
        return self.but_gone(self.docs)

    def as_index(self):
        """The postings of all live documents, with numbers as ids, for any kind of query."""
        rows = self.but_gone(unpacked(self.blocks, spots=True)).withColumnRenamed("doc", "id")
        places = F.transform("spots", lambda s: F.struct(
            (s % 2).alias("col"), F.floor(s / 2).cast("int").alias("pos")))
        lengths = self.live_docs().select(F.col("doc").alias("id"))
        return X.TextIndex(rows.select("term", "id", "n_tokens", "tf", places.alias("places"), "term_bucket"),
                           lengths, (self.n_docs, self.avg_tokens))

    def counts(self, terms=None):
        """(term, df) of live documents, of all or of the given terms."""
        rows = of_terms(self.blocks, terms).select("term", F.col("n").cast("bigint").alias("df"))
        if self.adjust is not None:
            adjust = self.adjust if terms is None else self.adjust.filter(F.col("term").isin(terms))
            rows = rows.unionByName(adjust)
        return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def df(self, terms):
        """{term: documents} of a query's few terms; those asked before are kept."""
        if len(self.known) > KNOWN_TERMS:
            self.known.clear()
        new = [t for t in terms if t not in self.known]
        if new:
            found = {r["term"]: r["df"] for r in self.counts(new).collect()}
            self.known.update((t, found.get(t, 0)) for t in new)
        return {t: self.known[t] for t in terms if self.known.get(t)}


def of_terms(blocks, terms):
    """Blocks of the terms, pruned to their buckets."""
    if terms is None:
        return blocks
    return blocks.filter(X.in_buckets(terms) & F.col("term").isin(list(terms)))


@dataclass(frozen=True)
class TextStore:
    root: str

    @cached_property
    def manifest(self):
        return Manifest(self.root)

    def _path(self, part, table):
        return f"{self.root}/{table}/segment={part}"

    def _read(self, spark, entries, table, schema, fact):
        paths = [self._path(e.part, table) for e in entries if e.fact(fact)]
        return read_parts(spark, schema, paths, f"{self.root}/{table}").drop("segment")

    def _index(self, spark, entries):
        some = lambda fact: any(e.fact(fact) for e in entries)
        table = lambda *of: self._read(spark, entries, *of)
        blocks = table("blocks", BLOCKS, "parted").unionByName(table("flat", BLOCKS, "flat"))
        return StoredIndex(
            table("docs", DOCS, "held"), blocks,
            table("gone", GONE, "gone") if some("gone") else None,
            table("adjust", ADJUST, "adjusted") if some("adjusted") else None,
            sum(e.fact("docs") for e in entries), sum(e.fact("tokens") for e in entries))

    def load(self, spark):
        return self._index(spark, self.manifest.live(spark, "text"))

    def _next(self, live):
        return max((e.fact("number") for e in live), default=-1) + 1

    def _known(self, spark, part):
        live = self.manifest.live(spark, "text")
        return live, any(e.part == part for e in live)

    def add(self, docs, part=None, stemmed=True, fresh=False):
        """Index ``docs`` (id, timestamp, label, content); a part written before stays as it is.

        Ids already present are left alone, unless the caller knows that all are
        ``fresh``.
        """
        spark = docs.sparkSession
        part = part or f"added-{os.urandom(8).hex()}"
        live, done = self._known(spark, part)
        if done:
            return
        tasks = tasks_for(docs)
        if not fresh and live:
            docs = docs.join(self.load(spark).live_docs().select("id"), "id", "left_anti")
        number = self._next(live)
        # The lengths are read for the sum only: postings hold them too.
        dated = docs.withColumn("event_date", times.utc_date(F.col("timestamp"))).withColumn("n_tokens", n_tokens())
        (numbered_docs(dated, number, ["event_date", "timestamp", "n_tokens"], tasks).drop("task")
         .write.mode("overwrite").parquet(self._path(part, "docs")))
        held, tokens = (spark.read.schema("n_tokens bigint").parquet(self._path(part, "docs"))
                        .agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first())
        rows = self._terms(document_words(numbered_docs(docs, number, X.COLUMNS, tasks)), part, stemmed)
        where = self._write_blocks(rows, part, held, tokens, apart=stemmed)
        self.manifest.commit(spark, [Entry("text", part, None, 0, facts(
            number=number, held=held, docs=held, tokens=tokens, **where))])

    def _terms(self, words, part, stemmed):
        if not stemmed:
            return words.withColumnRenamed("word", "term")
        path = self._path(part, "stems")
        changed_words(words).write.mode("overwrite").parquet(path)
        stems = words.sparkSession.read.schema("word string, stem string").parquet(path)
        return with_terms(words, stems, stems.count())

    def _write_blocks(self, rows, part, held, tokens, apart=False, by_bucket=False):
        """Write the blocks; the facts of where they are.

        Few are gathered in few files. Else each task writes its own: one sorted file
        of all its terms, or ``by_bucket`` if that is how the rows are dealt.
        """
        made, parted = blocks_of(rows, tokens / held if held else 1.0, apart), by_bucket and tokens > FLAT_TOKENS
        if tokens <= FLAT_TOKENS:
            made = made.hint("rebalance")
        writer = (made.sortWithinPartitions("term_bucket", "term", "first")
                  .write.mode("overwrite").option("compression", "zstd"))
        if parted:
            writer.partitionBy("term_bucket").parquet(self._path(part, "blocks"))
        else:
            writer.parquet(self._path(part, "flat"))
        return {"flat": 0, "parted": held} if parted else {"flat": held, "parted": 0}

    def remove(self, docs, part=None, stemmed=True):
        """Remove ``docs`` (id, label, content as they were indexed)."""
        spark = docs.sparkSession
        part = part or f"removed-{os.urandom(8).hex()}"
        live, done = self._known(spark, part)
        if done or not live:
            return
        there = self.load(spark).live_docs().join(docs.select("id").distinct(), "id", "left_semi")
        there.select("doc", "id").write.mode("overwrite").parquet(self._path(part, "gone"))
        found = spark.read.schema("doc bigint, id string").parquet(self._path(part, "gone"))
        texts = docs.select("id", *X.COLUMNS).dropDuplicates(["id"]).join(found, "id")
        words = document_words(texts).persist(StorageLevel.DISK_ONLY)
        rows = self._terms(words, part, stemmed)
        (rows.groupBy("term").agg((-F.count_distinct("doc")).alias("df"))
         .write.mode("overwrite").parquet(self._path(part, "adjust")))
        n, tokens = found.count(), _tokens(words)
        words.unpersist()
        self.manifest.commit(spark, [Entry("text", part, None, 0, facts(
            number=self._next(live), gone=n, adjusted=n, docs=-n, tokens=-tokens))])

    def replace(self, docs, before, stemmed=True):
        """Index documents anew; ``before`` are the same documents as they were."""
        self.remove(before, stemmed=stemmed)
        self.add(docs, stemmed=stemmed)

    def merge(self, spark, fanout=FANOUT):
        """Merge a level's segments once there are ``fanout`` of them; tells whether it did."""
        live = self.manifest.live(spark, "text")
        old = due(live, fanout)
        if not old:
            return False
        number = self._next(live)
        part = f"merged-{number}"
        all_gone, mine = self._index(spark, live).gone, self._index(spark, old)
        rows = dealt_blocks(mine.blocks, mine.n_tokens).select(
            "term", "task", "first", F.inline(F.arrays_zip("docs", "tokens", "spots")))
        rows = rows.select("term", "task", (F.col("first") + F.col("docs")).alias("doc"),
                           F.col("tokens").alias("n_tokens"), "spots")
        docs = mine.docs
        lost = spark.createDataFrame([], ADJUST)
        if all_gone is not None:
            lost = (unpacked(mine.blocks).join(all_gone, "doc", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
            rows, docs = rows.join(all_gone, "doc", "left_anti"), docs.join(all_gone, "doc", "left_anti")
        docs.hint("rebalance").sortWithinPartitions("doc").write.mode("overwrite").parquet(
            self._path(part, "docs"))
        kept = spark.read.schema(DOCS).parquet(self._path(part, "docs"))
        held = kept.count()
        where = self._write_blocks(rows, part, held, mine.n_tokens, by_bucket=True)
        # Removals of documents in other segments go on; counts add up over all segments.
        left = gone = 0
        if mine.gone is not None:
            rest = mine.gone.join(mine.docs.select("doc"), "doc", "left_anti")
            rest.write.mode("overwrite").parquet(self._path(part, "gone"))
            gone = spark.read.schema(GONE).parquet(self._path(part, "gone")).count()
        if all_gone is not None:
            adjust = lost if mine.adjust is None else lost.unionByName(mine.adjust)
            (adjust.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
             .write.mode("overwrite").parquet(self._path(part, "adjust")))
            left = spark.read.schema(ADJUST).parquet(self._path(part, "adjust")).count()
        self.manifest.commit(spark, [Entry("text", part, None, old[0].level + 1, facts(
            number=number, held=held, gone=gone, adjusted=left, docs=mine.n_docs, tokens=mine.n_tokens,
            **where))], old)
        return True


def _tokens(words):
    return words.select("doc", "n_tokens").distinct().agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


# --- queries -----------------------------------------------------------------

def term_stats(index):
    return index.counts().select("term", "df", F.lit(index.n_docs).cast("bigint").alias("n_docs"),
                                 F.lit(index.avg_tokens).alias("avg_tokens"))


def _words(query):
    """The query's words with how often each counts, if it asks for single whole words only."""
    if any(len(p.terms) > 1 or p.prefix for p in query.phrases):
        return None
    words = {}
    for p in query.phrases:
        words[p.terms[0]] = words.get(p.terms[0], 0) + 1
    return words


class WordQuery:
    """Scores of single words over stored blocks, pruned by what a block can reach."""

    def __init__(self, index, query):
        self.index, self.any_of = index, query.any_of
        self.order = [p.terms[0] for p in query.phrases]
        self.terms = sorted(set(self.order))
        self.blocks = of_terms(index.blocks, self.terms)
        self.df = index.df(self.terms)
        self.idf = {t: X.idf(index.n_docs, self.df.get(t, 0)) for t in self.terms}

    def empty(self):
        return not self.df or not self.any_of and len(self.df) < len(self.terms)

    def per_term(self, values):
        return F.create_map(*[x for t in self.terms for x in (F.lit(t), F.lit(float(values[t])))])[F.col("term")]

    def reach(self):
        """The most that a posting of this block can add to a document's score."""
        times_asked = {t: self.order.count(t) * self.idf[t] for t in self.terms}
        return self.per_term(times_asked) * weight(
            F.col("max_tf").cast("double"), F.col("min_tokens"), F.lit(self.index.avg_tokens))

    def scored(self, blocks):
        """(doc, score) of documents that the query finds in these blocks."""
        rows = self.index.but_gone(unpacked(blocks))
        own = self.per_term(self.idf) * weight(F.col("tf").cast("double"), F.col("n_tokens"),
                                               F.lit(self.index.avg_tokens))
        per = rows.select("doc", "term", own.alias("own")).groupBy("doc").agg(*[
            F.max(F.when(F.col("term") == t, F.col("own"))).alias(f"s{i}") for i, t in enumerate(self.terms)])
        if not self.any_of:
            per = per.dropna()
        place = {t: F.coalesce(f"s{i}", F.lit(0.0)) for i, t in enumerate(self.terms)}
        return per.select("doc", sum((place[t] for t in self.order[1:]), place[self.order[0]]).alias("score"))

    def kth(self, blocks, k):
        """The k-th best score in these blocks, a bound from below for the whole index."""
        best = self.scored(blocks).select("score").orderBy(F.desc("score")).limit(k).collect()
        return best[-1]["score"] if len(best) == k else None

    def threshold(self, k):
        """A score that the k best documents reach, found in the most promising blocks."""
        heads = self.blocks.select("term", self.reach().alias("reach"))
        ranked = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("reach")))
        cut = (heads.withColumn("at", ranked).filter(F.col("at") <= FIRST_BLOCKS)
               .groupBy("term").agg(F.max("reach").alias("most"), F.min("reach").alias("least")).collect())
        self.most = {r["term"]: r["most"] for r in cut}
        least = {t: next((r["least"] for r in cut if r["term"] == t), 0.0) for t in self.terms}
        return self.kth(self.blocks.filter(self.reach() >= self.per_term(least)), k)

    def worth(self, score):
        """Blocks of which some document may reach ``score``."""
        total = sum(self.most.values())
        others = {t: total - self.most.get(t, 0.0) for t in self.terms}
        return self.blocks.filter((self.reach() + self.per_term(others)) * (1 + 1e-9) >= score)

    def candidates(self, k):
        """Blocks that hold the k best documents with all their words."""
        if sum(self.df.values()) <= SCORED_AT_ONCE:
            return self.blocks
        score = self.threshold(k)
        return self.blocks if score is None else self.worth(score)


def top(index, query, k):
    """The best ``k`` hits as rows (doc, id, event_date, timestamp, bm25_rank), best first.

    At most the search limit's few rows reach the driver. Ties go by id.
    """
    words = _words(query)
    if words is None:
        ranked = X.rank(index.as_index(), query).select(F.col("id").alias("doc"), "bm25_rank")
    else:
        asked = WordQuery(index, query)
        if asked.empty():
            return []
        ranked = asked.scored(asked.candidates(k)).select("doc", (-F.col("score")).alias("bm25_rank"))
    best = ranked.orderBy("bm25_rank").limit(k + 1).collect()
    if len(best) > k and best[k]["bm25_rank"] == best[k - 1]["bm25_rank"]:
        # Equal scores around the last place: ids decide.
        found = ranked.filter(F.col("bm25_rank") <= best[k]["bm25_rank"]).join(index.docs, "doc")
        return found.orderBy("bm25_rank", "id").limit(k).collect()
    ranks = {r["doc"]: r["bm25_rank"] for r in best[:k]}
    found = index.docs.filter(F.col("doc").isin(list(ranks))).collect()
    rows = [r.asDict() | {"bm25_rank": ranks[r["doc"]]} for r in found]
    return sorted(rows, key=lambda r: (r["bm25_rank"], r["id"]))


def fetch(events, hits):
    """The events of the hits, from their own days and, within these, row groups."""
    found = events.filter(F.col("id").isin([h["id"] for h in hits])
                          & F.col("timestamp").isin([h["timestamp"] for h in hits]))
    if "event_date" in events.columns:
        found = found.filter(F.col("event_date").isin([h["event_date"] for h in hits]))
    return found


def _ranks(hits):
    return F.create_map(*[x for h in hits for x in (F.lit(h["id"]), F.lit(h["bm25_rank"]))])[F.col("id")]


def search(events, index, query, limit=None):
    """Ranked full events; a query without words finds nothing."""
    hits = top(index, query, S.clamp(limit, S.SEARCH_LIMIT)) if query.phrases else []
    if not hits:
        return events.limit(0).withColumn("bm25_rank", F.lit(0.0))
    return fetch(events, hits).withColumn("bm25_rank", _ranks(hits))


def search_snippets(events, index, query, limit=None):
    """Ranked hits with a marked excerpt instead of the content."""
    hits = top(index, query, S.clamp(limit, S.SNIPPET_LIMIT)) if query.phrases else []
    fields = ["id", "label", "source", "timestamp"]
    if not hits:
        return events.limit(0).select(*fields, F.lit("").alias("snippet_text"), F.lit(0.0).alias("bm25_rank"))
    numbers = [h["doc"] for h in hits]
    near = F.exists(F.array(*map(F.lit, numbers)), lambda d: d.between(F.col("first"), F.col("last")))
    part = StoredIndex(index.docs, index.blocks.filter(near), None, None, index.n_docs, index.n_tokens)
    whole = part.as_index()
    some = X.TextIndex(whole.postings.filter(F.col("id").isin(numbers)), whole.lengths, whole.known)
    names = F.create_map(*[x for h in hits for x in (F.lit(h["doc"]), F.lit(h["id"]))])
    marked = X.phrase_hits(some, query).select(
        names[F.col("id")].alias("id"), X.content_hits(query).alias("hits"))
    found = fetch(events, hits).select(*fields, "content").withColumn("bm25_rank", _ranks(hits))
    # At most the search limit's few rows.
    return X.with_snippet(found.join(F.broadcast(marked), "id"), len(query.phrases)).select(
        *fields, "snippet_text", "bm25_rank")
