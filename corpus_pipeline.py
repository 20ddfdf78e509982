"""Corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and the next stage reads it again. All stages
but the last return the columns of their input.

A document is dropped only by the first two stages: when it fails the quality
rules or is left depleted by them, or when a document with a smaller id stays
for its group of near duplicates (five-word shingles, Jaccard 0.8 or more).
Null texts fail the quality rules. Repeated and null ids are told apart by row. Texts
of any length are read whole; columns of any name pass through. An empty table gives no
rows.
SQL cannot express the tagger or the tokenizer, so there is no oracle SQL; the
stages are tested against brute force. Stages bound the rows of an Arrow batch in
the session, as a worker runs one stage's code after another's.
"""

from pyspark.sql import functions as F

from worktrail.llm import jaccard, packing, pii, quality
from worktrail.llm.common import small_batches, stored, table


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and aren't depleted."""
    small_batches(spark)
    return quality.kept(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group."""
    small_batches(spark)
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def personal_data(spark, docs, sf_dir):
    """All documents, with personal data masked and ``n_chars`` of the new text."""
    small_batches(spark)
    model = pii.train(docs)
    return (docs.withColumn("text", pii.masked(F.col("text"), model))
            .withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns))


def pack(spark, docs, sf_dir):
    """Power-of-two sequences with their ids."""
    small_batches(spark)
    return packing.pieces(docs, keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("personal data", personal_data), ("packing", pack)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
