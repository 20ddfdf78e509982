"""URL filters: rules by host and path, and a list of canonical URLs behind a Bloom filter.

All work is done by column functions. The filter is blocked: one hash picks a
block of 256 bits, a second one picks eight bits in it, two per 64-bit word.
It has at most ``BLOCKS`` rows whatever the list holds, so it is broadcast; a
list too long for it lets more URLs through to the exact join and loses none.
URLs that pass are joined to the list by hash, which removes false hits; one
frequent URL's rows are split by Spark's skewed-join handling.

A null URL, or one without ``://``, has an empty host and path, fits no rule and
is on no list. An empty list blocks nothing. Repeated rows keep their rows. URLs of any
length are read whole. An empty table gives no rows.
"""

from pyspark.sql import functions as F

BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (host, path, verdict); fixed values of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# First labels of hosts whose pages make up the query's list; fixed values.
BAD_LABELS = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]


def with_parts(df, url="url"):
    """Add host, path and query of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return (df.withColumn("host", F.translate(raw, UPPER, LOWER))
            .withColumn("path", F.regexp_extract(after, "^[^?#]*", 0))
            .withColumn("query", F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)))


def canonical():
    """Host without www. or m., path without a last slash or .html, other parameters sorted."""
    host = F.regexp_replace("host", r"^(www|m)\.", "")
    path = F.regexp_replace("path", r"(/|\.html)$", "")
    kept = F.array_sort(F.filter(
        F.split("query", "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref)(=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.col("host") != "", F.concat(host, path, query))


def rule_columns(rules):
    """The longest fitting rule's text and verdict."""
    text = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (((F.col("host") == host) | F.endswith("host", F.lit("." + host)))
                & F.startswith("path", F.lit(path)))
        text = F.when(fits, host + path).otherwise(text)
        verdict = F.when(fits, what).otherwise(verdict)
    return text, verdict


def bits(name):
    """Block number and the four words of a key's bits."""
    spread = F.xxhash64(name, F.lit(1))
    words = []
    for i in range(4):
        first = F.shiftrightunsigned(spread, 12 * i).bitwiseAND(63).cast("int")
        second = F.shiftrightunsigned(spread, 12 * i + 6).bitwiseAND(63).cast("int")
        one = F.lit(1).cast("bigint")
        words.append(F.call_function("shiftleft", one, first)
                     .bitwiseOR(F.call_function("shiftleft", one, second)))
    return F.pmod(F.xxhash64(name), F.lit(BLOCKS)), words


def bloom(listed, key="canonical"):
    """The filter: one row per used block, with four 64-bit words."""
    block, words = bits(key)
    return (listed.filter(F.col(key).isNotNull())
            .select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]))


def passes(words):
    """Whether a row joined to the filter by block has all bits of its key set."""
    hit = F.col("block").isNotNull()
    for i, w in enumerate(words):
        hit = hit & F.coalesce(F.col(f"w{i}").bitwiseAND(w) == w, F.lit(False))
    return hit


def without(docs, key, gone):
    """The rows of ``docs`` whose ``key`` (a string column) isn't in ``gone`` (column key).

    Only rows that the filter lets through are shuffled, so most texts stay where they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), key.alias("key"))
    block, words = bits("key")
    rows = (rows.withColumn("__block", block)
            .join(F.broadcast(bloom(gone, "key")), F.col("__block") == F.col("block"), "left")
            .select("own", "key", passes(words).alias("hit")))
    kept = rows.filter("hit").join(gone.select("key").distinct(), "key", "left_anti")
    return rows.filter("not hit").select("own.*").unionByName(kept.select("own.*"))


def judge(pages, listed, rules, url="url", keep=("page_id",)):
    """Columns in ``keep`` and host, path, rule, verdict and listed (is the URL on the list).

    ``listed`` has a column ``canonical``; see ``canonical``.
    """
    listed = listed.select("canonical").filter("canonical is not null").distinct()
    rule, verdict = rule_columns(rules)
    rows = (with_parts(pages.select(*keep, F.col(url).alias("__url")), "__url")
            .withColumn("__key", canonical()).withColumn("rule", rule)
            .withColumn("__verdict", verdict))
    block, words = bits("__key")
    rows = (rows.withColumn("__block", F.when(F.col("__key").isNotNull(), block))
            .join(F.broadcast(bloom(listed)), F.col("__block") == F.col("block"), "left"))
    rows = rows.select(*keep, "host", "path", "rule", "__verdict", "__key",
                       passes(words).alias("__hit"))
    exact = listed.hint("shuffle_hash").withColumn("listed", F.lit(True))
    possible = rows.filter("__hit").join(
        exact, F.col("__key") == F.col("canonical"), "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False))).drop("canonical")
    out = possible.unionByName(rows.filter("not __hit").withColumn("listed", F.lit(False)))
    found = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select(*keep, "host", "path", "rule",
                      F.coalesce("__verdict", found).alias("verdict"), "listed")


def bad_host_urls(pages, labels=BAD_LABELS, url="url"):
    """A list of canonical URLs: those whose host has a label of the given ones."""
    parts = with_parts(pages.select(url), url).withColumn("canonical", canonical())
    return parts.filter(F.arrays_overlap(
        F.split("host", r"\."), F.array(*[F.lit(x) for x in labels]))).select("canonical")


SQL = """
with parts as (
  select page_id, case when instr(url, '://') > 0
    then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, regexp_extract(rest, '^[^/?#]*', 0) as raw, rest from parts
), named as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(rest, length(raw) + 1) as after_host from cut
), split as (
  select page_id, host, regexp_extract(after_host, '^[^?#]*', 0) as path,
    regexp_extract(after_host, '^[^?#]*\\?([^#]*)', 1) as query from named
), keyed as (
  select *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
    and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) as kept from split
), canon as (
  select page_id, host, path, case when host <> '' then
    regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '')
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as key
  from keyed
), listed as (
  select distinct key from canon where list_has_any(string_split(host, '.'),
    ['ads-track', 'free-bets', 'cheap-pills', 'spam-farm', 'casino-win', 'adult-x'])
), ruled as (
  select canon.*, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from canon
)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when rule is not null then 'block'
    when ruled.key in (select key from listed where key is not null) then 'block' else 'allow' end as verdict,
  coalesce(ruled.key in (select key from listed where key is not null), false) as listed
from ruled
"""
