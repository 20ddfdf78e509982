"""Text helpers for previews, labels, paths and markdown."""

from functools import reduce

from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions import times

# Source paths with known extensions; a match consumes the
# delimiter on either side.
PATH_RE = (r"(?U)(?:^|[\s`'\"(])([a-zA-Z0-9_./\-]+\."
           r"(?:rs|ts|js|tsx|jsx|py|go|toml|json|yaml|yml|md|sql|sh|lock|env))"
           r"(?:[\s`'\",;:)]|\z)")
# The same without consuming delimiters: adjacent paths are all found.
PATH_LOOKAROUND_RE = (r"(?U)(?<![^\s`'\"(])([a-zA-Z0-9_./\-]+\."
                      r"(?:rs|ts|js|tsx|jsx|py|go|toml|json|yaml|yml|md|sql|sh|lock|env))"
                      r"(?=[\s`'\",;:)]|\z)")

SLUG_MAX = 40
SLUG_EMPTY = "review"


def utrim(c):
    """Trim Unicode white space (Spark's own trim removes only spaces)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def is_blank(c):
    return F.coalesce(utrim(c), F.lit("")) == ""


def basename(c):
    return F.substring_index(c, "/", -1)


def source_code(c):
    """Exact-case alias to stored code; unknown gives null."""
    table = F.create_map(*[F.lit(x) for kv in S.SOURCE_ALIASES.items() for x in kv])
    return table[c]


def source_name(code):
    table = F.create_map(*[F.lit(x) for kv in S.SOURCE_NAMES.items() for x in kv])
    return table[code]


def source_badge(c):
    """Display form: any case accepted, unknown upper-cased, empty is ``???``."""
    folded = {alias.lower(): code for alias, code in S.SOURCE_ALIASES.items()}
    table = F.create_map(*[F.lit(x) for kv in folded.items() for x in kv])
    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit("???"))
            .otherwise(F.coalesce(table[F.lower(c)], F.upper(c))))


def preview_context(c, size=400):
    """Beyond ``size`` bytes, the first ``size`` characters."""
    return F.when(F.octet_length(c) > size, F.substring(c, 1, size)).otherwise(c)


def preview_list(c, size=200):
    return F.substring(c, 1, size)


def first_lines(c, n):
    return F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")


def cursor_context(c, line, around=3):
    """Lines around the zero-based ``line``, the line itself marked."""
    lines = F.split(c, "\n")
    start = F.greatest(F.lit(0), line - around)
    stop = F.least(F.size(lines) - 1, line + around)
    near = F.slice(lines, start + 1, F.greatest(stop - start + 1, F.lit(0)))
    marked = F.transform(near, lambda text, i: F.concat(
        F.when(i + start == line, F.lit("» ")).otherwise(F.lit("  ")), text))
    return F.array_join(marked, "\n")


def selection_text(selected, c, line, size=2000):
    """The selection up to ``size`` characters, or the cursor's surroundings."""
    return (F.when(F.coalesce(F.length(selected), F.lit(0)) == 0, cursor_context(c, line))
            .otherwise(F.substring(selected, 1, size)))


def capture_label(kind, path, line=None):
    name = basename(path)
    labels = {
        "open": F.concat(F.lit("Opened: "), name),
        "save": F.concat(F.lit("Saved: "), name),
        "focus": F.concat(F.lit("Focused: "), name),
    }
    if line is not None:
        labels["selection"] = F.concat(
            F.lit("Editing: "), name, F.lit(" L"), (line + 1).cast("string"))
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]),
                  labels.items(), F.when(F.lit(False), F.lit("")))


def extract_paths(text, lookaround=False):
    """Paths named in a text, without build output, VCS folders and lock files."""
    found = F.regexp_extract_all(
        text, F.lit(PATH_LOOKAROUND_RE if lookaround else PATH_RE), F.lit(1))
    return F.filter(found, lambda p: ~(
        F.contains(p, F.lit("target/")) | F.contains(p, F.lit(".git/"))
        | F.coalesce(F.regexp_like(p, F.lit(r"(?i)[^/]\.lock\z")), F.lit(False))))


def event_markdown(df):
    """One markdown block per event in column ``markdown``."""
    flag = F.when(F.col("was_redacted"), F.lit(" ⚠️ redacted")).otherwise(F.lit(""))
    return df.withColumn("markdown", F.concat(
        F.lit("**["), F.col("source"), F.lit("] "), F.col("label"), F.lit("** _"),
        times.stamp(F.col("timestamp")), flag, F.lit("_\n```\n"),
        preview_context(F.col("content")), F.lit("\n```")))


def slugify(c, size=SLUG_MAX):
    words = F.regexp_replace(utrim(F.lower(c)), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(words, r"(?U)[\s_-]+", "-")
    slug = F.regexp_replace(F.substring(dashed, 1, size), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(SLUG_EMPTY))


# Reference lines removed from generated text, in order. Product
# names and hosts are the caller's: see ``reference_patterns``.
_EXPLORE_RE = (r"(?imUd)^Wiki pages? you might want to explore:[^\n]*"
               r"(?:\n[ \t]*[-*]\s*[^\n]+)*")
_COVERAGE_RE = r"(?imUd)^.*?Note on indexing coverage.*$"
_VIEW_RE = (r"(?imUd)^(?:View|Check|Open|See)\s+(?:this|the|our)\s+"
            r"(?:search|result|wiki|page)[^\n]*")
_POWERED_RE = r"(?imUd)Powered by[^\n]*"


def _literal(x):
    """A string as a pattern that matches it alone."""
    return "".join(c if c.isalnum() else "\\" + c for c in x)


def reference_patterns(products=(), hosts=(), vendors=(), lines=()):
    """Delete patterns for a search product, its hosts, vendors and quoted lines."""
    named, hosted, sellers, quoted = (
        [_literal(x) for x in xs] for xs in (products, hosts, vendors, lines))
    return (
        [_EXPLORE_RE]
        + [rf"(?iUd)View this search on {p}:?[^\n]*" for p in named]
        + [rf"(?iUd)\[{p}\]\(.*?\)" for p in named]
        + [rf"(?iUd)https?://(?:www\.)?{h}\S*" for h in hosted]
        + [rf"(?iUd)(?:api\.)?{h}\S*" for h in hosted]
        + [rf"(?iUd){p}\S*" for p in named]
        + [rf"(?iUd){v}(?:'s)?" for v in sellers]
        + [rf"(?imUd)^.*?{x}.*$" for x in quoted]
        + [_COVERAGE_RE, _VIEW_RE, _POWERED_RE]
    )


def strip_refs(c, patterns=None):
    patterns = reference_patterns() if patterns is None else patterns
    return utrim(reduce(lambda acc, p: F.regexp_replace(acc, p, ""), patterns, c))
