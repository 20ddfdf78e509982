"""Quality rules: counts within a document and line frequency across documents.

Base rules fail a document of fewer than 20 words, or one in which more than
30 % of the words lie in 8-word windows that occur twice or more.

Cross-document rule. Lines are normalised (A-Z in lower case, white space
collapsed) and hashed, and a host's (source's) distinct documents that hold a
line are counted; equal texts are one document. Lines in more than
``MAX_DOCS`` documents of a host are removed from its documents, and a document
left with less than ``MIN_LEFT`` of its words is rejected as depleted.

Copies with small changes are not many documents: their lines repeat because
the whole text does. So among documents of which frequent lines make up more
than half, those are taken as one that agree in the smallest of their other
frequent lines. A page that is nothing but boilerplate is still depleted,
because that boilerplate is counted on all the other pages.

Null text has no words (and fails); a null source is a host of its own. Equal
rows, null or repeated ids keep their rows. Other columns are passed through. Texts of any
length are counted whole; ties play no part, as every line over the limit goes. An empty
table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm import urls
from worktrail.llm.common import Cache, numbered, runs, stored
from worktrail.operators.ranking import salted_lookup

MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
MAX_DOCS = 20
MIN_LEFT = 30  # percent of the words that must be left
ALIKE = 50  # percent of the words in frequent lines, from which on documents are compared as copies
SALTS = 16  # tasks over which the rows of one line of one host are spread
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


def repeated_words(words, window=WINDOW):
    """Words that lie in windows which occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    known = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    # Windows are numbered exactly: pairs of numbered halves, no hash that could clash.
    size, span = 1, ids
    while size < window:
        step = min(size, window - size)
        pairs = span[:len(span) - step] * (int(span.max()) + 1) + span[step:]
        _, span = np.unique(pairs, return_inverse=True)
        size += step
    twice = np.bincount(span)[span] >= 2
    edge = np.zeros(n + 1, np.int64)
    edge[:len(span)] += twice
    edge[window:window + len(span)] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_hash(line):
    """63 bits of MD5, which SQL can compute too."""
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big") >> 1


def measure(text):
    """Counts of one text, and its lines as (hash, words in all its occurrences)."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    shared = {}
    for line in raw.lower().split(b"\n"):
        own = line.split()
        if own:
            key = b" ".join(own)
            shared[key] = shared.get(key, 0) + len(own)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(text.count(c) for c in SPACES),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "text_hash": hashlib.sha256(raw).digest(),
        "lines": [{"line": line_hash(k), "words": n} for k, n in shared.items()]}


LINE = pa.struct([("line", pa.int64()), ("words", pa.int64())])
MEASURES = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                      ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                      ("text_hash", pa.binary()), ("lines", pa.list_(LINE))])


def measured(text):
    """The measures of a text column."""
    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
                 "n_repeat_words:bigint,text_hash:binary,"
                 "lines:array<struct<line:bigint,words:bigint>>>")
    def run(texts: pa.Array) -> pa.Array:
        Cache.release()
        return pa.concat_arrays([pa.array([measure(x or "") for x in xs], MEASURES)
                                 for xs in runs(texts)] or [pa.array([], MEASURES)])
    return run(text)


def frequent_lines(docs, most=MAX_DOCS):
    """(host, line) of the lines in more than ``most`` distinct documents of a host.

    ``docs`` has __row, __host, text_hash, n_words and lines.
    """
    lines = docs.select("__row", "__host", "text_hash", "n_words",
                        F.explode("lines").alias("__line")).select(
        "__row", "__host", "text_hash", "n_words", "__line.line", "__line.words")
    seen = (lines.groupBy("__host", "line", "text_hash")
            .agg(F.max("n_words").alias("n_words"), F.max("words").alias("words")))
    per_line = seen.groupBy("__host", "line").agg(F.count("*").alias("docs"))
    candidates = per_line.filter(F.col("docs") > most).select("__host", "line")

    # A document's own frequent lines, smallest first: no more than the document has lines.
    # One line of one host may be in a large part of all documents: the lookup is salted.
    held = (salted_lookup(seen, candidates, ["__host", "line"], ["text_hash"], "left_semi", SALTS)
            .groupBy("__host", "text_hash")
            .agg(F.max("n_words").alias("n_words"),
                 F.sum("words").alias("shared"), F.array_sort(F.collect_list("line")).alias("own")))
    alike = (F.col("shared") * 100 > F.col("n_words") * ALIKE) & (F.size("own") > 1)
    per = held.select("__host", "text_hash", "own", alike.alias("alike"),
                      F.explode("own").alias("line"))
    other = F.when(F.col("line") == F.col("own")[0], F.col("own")[F.when(
        F.size("own") > 1, 1).otherwise(0)]).otherwise(F.col("own")[0])
    family = F.when(F.col("alike"), other.cast("string")).otherwise(F.hex("text_hash"))
    return (per.select("__host", "line", family.alias("family")).distinct()
            .groupBy("__host", "line").agg(F.count("*").alias("docs"))
            .filter(F.col("docs") > most).select("__host", "line"))


def host_key(host):
    """A host as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def rate(docs, text="text", host="source", most=MAX_DOCS, least_left=MIN_LEFT, keep=None):
    """The columns in ``keep`` (all) and __n_words, ..., __base_failed, __words_left, __kept.

    New columns start with two underscores, so they don't clash with those passed through.
    """
    keep = docs.columns if keep is None else keep
    rows = numbered(docs.select(
        host_key(host).alias("__host"),
        measured(F.col(text)).alias("m"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__kept_columns")))
    rows = stored(rows.select("__row", "__host", "m.*", "__kept_columns"), "quality")
    gone = frequent_lines(rows, most)
    lines = rows.select("__row", "__host", F.explode("lines").alias("x")).select(
        "__row", "__host", "x.line", "x.words")
    lost = (salted_lookup(lines, gone, ["__host", "line"], ["__row"], "left_semi", SALTS)
            .groupBy("__row").agg(F.sum("words").alias("__lost")))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))
    left = F.col("n_words") - F.coalesce("__lost", F.lit(0))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (rows.join(lost, "__row", "left")
            .select("__kept_columns.*", F.col("__host"), F.col("text_hash").alias("__text_hash"), *[F.col(c).alias(f"__{c}") for c in counts],
                    failed.alias("__base_failed"), left.alias("__words_left"),
                    (~failed & (left * 100 >= F.col("n_words") * least_left)).alias("__kept")))


def digest(docs, id_column="doc_id"):
    rated = rate(docs, keep=[id_column])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "words_left", "kept"]
    return rated.select(id_column, *[F.col(f"__{c}").alias(c) for c in names])


def kept(docs, text="text", host="source"):
    """The documents that pass, with their own columns.

    A verdict hangs on host and text alone, so the texts themselves are neither
    stored nor, but for those that may have failed, shuffled.
    """
    rated = rate(docs, text, host, keep=[host])
    failed = rated.filter("not __kept").select(
        F.concat("__host", F.lit(":"), F.lower(F.hex("__text_hash"))).alias("key"))
    own = F.concat(host_key(host), F.lit(":"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return urls.without(docs, own, stored(failed.distinct(), "failed"))


SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as text, source,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    string_split(coalesce(text, ''), chr(10)) as parts from documents
), filled as (
  select *, list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as full_lines from base
), spans as (
  select doc_id, words, unnest(range(1, len(words) - 6)) as pos from base where len(words) >= 8
), keyed as (
  select doc_id, pos, count(*) over (partition by doc_id, array_to_string(words[pos:pos + 7], ' ')) as n
  from spans
), covered as (
  select doc_id, count(distinct w) as n_repeat_words from (
    select doc_id, unnest(range(pos, pos + 8)) as w from keyed where n >= 2) group by doc_id
), lines as (
  select doc_id, text, source, len(words) as n_words, array_to_string(own, ' ') as line, len(own) as line_words
  from (select doc_id, text, source, words, unnest(list_transform(full_lines, lambda x:
    regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'))) as own from filled)
), hashed as (
  select doc_id, text, source, n_words, line_words,
    (('0x' || substr(md5(line), 1, 16))::ubigint >> 1)::bigint as line from lines
), seen as (
  select text, source, line, max(n_words) as n_words, max(w) as words from (
    select doc_id, text, source, line, max(n_words) as n_words, sum(line_words) as w
    from hashed group by all) group by text, source, line
), held as (
  select * from seen where (source, line) in (
    select (source, line) from seen group by source, line having count(*) > 20)
), ranked as (
  select *, min(line) over w as first, sum(words) over w as shared,
    min(line) filter (line <> f) over w as second from (
      select *, min(line) over (partition by source, text) as f from held)
  window w as (partition by source, text)
), families as (
  select distinct source, line, case when shared * 100 > n_words * 50
      and (case when line = first then second else first end) is not null
    then (case when line = first then second else first end)::varchar else 'text ' || text end as family
  from ranked
), gone as (
  select source, line from families group by source, line having count(*) > 20
), lost as (
  select doc_id, sum(line_words) as lost from hashed
  where (source, line) in (select (source, line) from gone) group by doc_id
), rated as (
  select b.doc_id, len(b.words) as n_words,
    length(b.text) - length(regexp_replace(b.text, '[^\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(b.text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(full_lines) - len(list_distinct(full_lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(b.words) - coalesce(lost, 0) as words_left
  from filled b left join covered using (doc_id) left join lost using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  words_left::bigint as words_left,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and words_left * 100 >= n_words * 30 as kept
from rated
"""
