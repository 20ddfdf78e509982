"""Metadata exit codes and the JSON form of session cards."""

from pyspark.sql import functions as F

from worktrail.schema import CARD_SCHEMA

# Exit codes in metadata text and in free text.
META_EXIT_RE = r"\"exit_code\"\s*:\s*(-?\d+)"
TEXT_EXIT_RE = r"(?iU)exit(?:ed)?\s+(?:with\s+)?(?:code\s+)?[:\s]?\s*(\d+)"


def exit_code(metadata, content):
    """Integer ``exit_code`` of the metadata, else of its text, else of the content.

    A top-level integer keeps its low 32 bits; a number in text that does not
    fit gives null.
    """
    value = F.try_variant_get(F.try_parse_json(metadata), "$.exit_code", "variant")
    number = F.when(F.schema_of_variant(value) == "BIGINT",
                    F.try_variant_get(F.try_parse_json(metadata), "$.exit_code", "bigint"))
    low32 = F.shiftright(F.shiftleft(number, 32), 32).try_cast("int")
    in_meta = F.regexp_extract(metadata, META_EXIT_RE, 1).try_cast("int")
    in_text = F.regexp_extract(content, TEXT_EXIT_RE, 1).try_cast("int")
    return F.coalesce(low32, in_meta, in_text)


def card_to_json(card):
    return F.to_json(card, {"ignoreNullFields": "false"})


def card_from_json(text):
    """The stored card, or null where the text is no whole card."""
    card = F.from_json(text, CARD_SCHEMA)
    required = [card[f] for f in CARD_SCHEMA.fieldNames()]
    whole = required[0].isNotNull()
    for field in required[1:]:
        whole = whole & field.isNotNull()
    whole = whole & card["result"].isin("completed", "abandoned")
    return F.when(whole, card)
