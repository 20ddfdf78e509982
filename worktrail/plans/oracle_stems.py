"""SQL for the stemmed queries: suffix stripping over the distinct words, one CTE per step."""

from worktrail.functions.porter import STEP2, STEP3, STEP4
from worktrail.plans.oracle import IDX, ranked_sql, term_hits


def shape(x):
    """Consonants as c, vowels as v; y is a vowel after a consonant. Runs of up to six y."""
    x = rf"regexp_replace({x}, '[^\x00-\x7F]', 'bb', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    x = f"regexp_replace({x}, '^y', 'c')"
    for _ in range(3):
        x = f"replace(replace({x}, 'cy', 'cv'), 'vy', 'vc')"
    return x


def measure(of):
    return f"len(regexp_extract_all({of}, 'v+c'))"


def but(w, n):
    return f"left({w}, length({w}) - {n})"


def short_end(stem, of):
    return f"(right({of}, 3) = 'cvc' AND right({stem}, 1) NOT IN ('w', 'x', 'y'))"


def suffix_step(name, source, rules, least):
    """CTEs that replace the longest suffix of ``rules``, if what stands before it measures enough."""
    ordered = sorted(rules, key=len, reverse=True)
    hit = lambda s: f"ends_with(w, '{s}') AND strlen(w) > {len(s)}"
    size = " ".join(f"WHEN {hit(s)} THEN {len(s)}" for s in ordered)
    new = " ".join(f"WHEN {hit(s)} THEN '{rules[s]}'" for s in ordered)
    fits = f"{measure(shape('stem'))} >= {least}"
    if "ion" in rules:
        fits += " AND (n <> 3 OR NOT ends_with(w, 'ion') OR right(stem, 1) IN ('s', 't'))"
    return (f"{name}_a AS (SELECT word, w, CASE {size} ELSE 0 END AS n, CASE {new} END AS r FROM {source}), "
            f"{name}_b AS (SELECT *, {but('w', 'n')} AS stem FROM {name}_a), "
            f"{name} AS (SELECT word, CASE WHEN n > 0 AND {fits} THEN stem || r ELSE w END AS w FROM {name}_b)")


VOC = ", ".join([
    "words AS (SELECT DISTINCT term AS word FROM place)",
    "fit AS (SELECT word, word AS w FROM words WHERE strlen(word) BETWEEN 3 AND 64)",
    f"""plural AS (SELECT word, CASE WHEN NOT ends_with(w, 's') OR ends_with(w, 'ss') THEN w
      WHEN ends_with(w, 'sses') AND strlen(w) > 4 OR ends_with(w, 'ies') AND strlen(w) > 3
      THEN {but('w', 2)} ELSE {but('w', 1)} END AS w FROM fit)""",
    f"""past_a AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') AND strlen(w) > 3 THEN NULL
      WHEN ends_with(w, 'ed') AND contains({shape(but('w', 2))}, 'v') THEN {but('w', 2)}
      WHEN ends_with(w, 'ing') AND contains({shape(but('w', 3))}, 'v') THEN {but('w', 3)} END
      AS stem FROM plural)""",
    f"past_b AS (SELECT *, {shape('stem')} AS sh FROM past_a)",
    f"""past AS (SELECT word, CASE WHEN stem IS NULL THEN CASE WHEN ends_with(w, 'eed') AND strlen(w) > 3
        AND {measure(shape(but('w', 3)))} > 0 THEN {but('w', 1)} ELSE w END
      WHEN strlen(stem) > 2 AND right(stem, 2) IN ('at', 'bl', 'iz') THEN stem || 'e'
      WHEN length(stem) > 1 AND right(stem, 1) = left(right(stem, 2), 1)
        AND right(stem, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {but('stem', 1)}
      WHEN {measure('sh')} = 1 AND {short_end('stem', 'sh')} THEN stem || 'e' ELSE stem END AS w
      FROM past_b)""",
    f"""ends_y AS (SELECT word, CASE WHEN ends_with(w, 'y') AND contains({shape(but('w', 1))}, 'v')
      THEN {but('w', 1)} || 'i' ELSE w END AS w FROM past)""",
    suffix_step("two", "ends_y", STEP2, 1), suffix_step("three", "two", STEP3, 1),
    suffix_step("four", "three", STEP4, 2),
    f"five_a AS (SELECT word, w, {but('w', 1)} AS stem, {shape(but('w', 1))} AS sh FROM four)",
    f"""five AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({measure('sh')} > 1 OR {measure('sh')} = 1
      AND NOT {short_end('stem', 'sh')}) THEN stem ELSE w END AS w FROM five_a)""",
    f"""stems AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {measure(shape(but('w', 1)))} > 1
      THEN {but('w', 1)} ELSE w END AS stem FROM five)""",
    "voc AS (SELECT word, coalesce(stem, word) AS stem FROM words LEFT JOIN stems USING (word))",
])

STEMMED_PLACE = (f"{VOC}, stem_place AS (SELECT id, col, pos, stem AS term FROM place "
                 "JOIN voc ON place.term = voc.word)")


def stemmed_ranked(hits, how="ALL", n=1):
    """``ranked_sql`` over stems instead of words."""
    return ranked_sql(hits, how, n).replace(", hits AS (", f", {STEMMED_PLACE}, hits AS (", 1).replace(
        "FROM place WHERE", "FROM stem_place WHERE")


STEM_ORACLE = {
    "fts_vocabulary": f"WITH {IDX}, {VOC} SELECT word, stem FROM voc",
    # The words thering and with, stemmed.
    "search_stemmed": f"""WITH {stemmed_ranked(term_hits('there', 'with'), 'ALL', 2)}
      SELECT id, label, round(r, 6) AS bm25_rank FROM ranked JOIN doc USING (id) ORDER BY r, id LIMIT 20""",
}
