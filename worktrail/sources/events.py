"""Reading and decoding events and tasks; rejected rows go to quarantine."""

from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions import text, times
from worktrail.functions.clean import clean_events

UUID_RE = r"^[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"

# Default labels of notes.
NOTE_LABELS = {"NOTE": "note", "MCP": "AI note"}


def read_requests(spark, path, fmt="json"):
    """Ingest requests from JSON or Parquet with a fixed schema."""
    return spark.read.schema(S.INGEST_SCHEMA).format(fmt).load(path)


def stream_requests(spark, path, fmt="json", max_files=None):
    reader = spark.readStream.schema(S.INGEST_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parse_requests(df, column="value"):
    """Requests from a JSON text column, such as a message queue's value.

    ``malformed`` keeps the text of what is no JSON object, for the quarantine.
    """
    parsed = F.from_json(column, S.INGEST_SCHEMA)
    readable = F.try_parse_json(F.col(column)).isNotNull() & F.ltrim(column).startswith("{")
    return df.select(parsed.alias("r"), F.when(~readable, F.col(column)).alias("malformed")).select(
        "r.*", "malformed")


def split_requests(requests):
    """(valid, rejected): a request is valid when its source alias is known.

    Rejected rows keep their fields, the text of malformed JSON, and a reason.
    """
    if "malformed" not in requests.columns:
        requests = requests.withColumn("malformed", F.lit(None).cast("string"))
    coded = requests.withColumn("code", text.source_code(F.col("source")))
    valid = (coded.filter(F.col("code").isNotNull()).withColumn("source", F.col("code"))
             .drop("code", "malformed"))
    rejected = coded.filter(F.col("code").isNull()).drop("code").withColumn(
        "reason", F.when(F.col("malformed").isNotNull(), "malformed JSON").otherwise(
            F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null")))))
    return valid, rejected


def with_ids(requests, scope, keep=()):
    """Give an id to each request that brings none.

    Equal requests are counted and numbered within ``scope`` (a load or
    micro-batch), so a replay of the same rows yields the same ids while real
    repeats stay apart. Counting first keeps many equal requests from meeting
    in one task. Columns to ``keep`` tell no requests apart and are null where an
    id is given.
    """
    fields = [c for c in requests.columns if c != "id" and c not in keep]
    named = requests.filter(F.col("id").isNotNull())
    counted = (requests.filter(F.col("id").isNull())
               .groupBy(*fields).agg(F.count("*").cast("int").alias("__n")))
    numbered = counted.select(*fields, F.explode(F.sequence(F.lit(1), "__n")).alias("__k"))
    text = F.to_json(F.struct(F.lit(scope).alias("scope"), "__k", *fields))
    hashed = F.md5(text)
    uid = F.concat_ws("-", *[F.substring(hashed, at, size) for at, size in
                             ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return named.unionByName(numbered.withColumn("id", uid).drop("__k"), allowMissingColumns=bool(keep))


def to_events(valid, scope="load", keep=()):
    """Cleaned events from valid requests; ``scope`` numbers those without id.

    Two loads or streams that write to one store need different scopes. A
    request without a time gets the time of this read.
    """
    filled = (with_ids(valid, scope, keep)
              .withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
              .withColumn("label", F.coalesce("label", F.lit("")))
              .withColumn("content", F.coalesce("content", F.lit("")))
              .withColumn("was_redacted", F.coalesce("was_redacted", F.lit(False))))
    return clean_events(filled).select(*S.EVENT_COLUMNS, *keep)


def decode_events(rows, strict_ids=True):
    """(decoded, rejected) from stored text rows.

    An unknown source reads as NOTE and a malformed task id as null; a
    malformed event id or timestamp rejects the row.
    """
    staged = (rows.withColumn("__ts", times.parse_timestamp(F.col("timestamp")))
              .withColumn("__ok", F.col("__ts").isNotNull()
                          & (F.col("id").rlike(UUID_RE) if strict_ids else F.col("id").isNotNull())))
    decoded = (staged.filter(F.col("__ok"))
               .withColumn("timestamp", F.col("__ts"))
               .withColumn("source", F.coalesce(text.source_code(F.col("source")), F.lit("NOTE")))
               .withColumn("task_id", F.when(F.col("task_id").rlike(UUID_RE), F.col("task_id")))
               .withColumn("was_redacted", F.coalesce("was_redacted", F.lit(0)).cast("int") != 0))
    rejected = staged.filter(~F.coalesce("__ok", F.lit(False)))
    return decoded.drop("__ts", "__ok"), rejected.drop("__ts", "__ok")


def decode_tasks(rows):
    """Unknown status reads as active, an unreadable count as zero."""
    return (rows
            .withColumn("started_at", times.parse_timestamp(F.col("started_at")))
            .withColumn("stopped_at", times.parse_timestamp(F.col("stopped_at")))
            .withColumn("status", F.when(F.col("status").isin(*S.TASK_STATUSES), F.col("status"))
                        .otherwise("active"))
            .withColumn("event_count", F.greatest(F.lit(0), F.coalesce(
                F.col("event_count").try_cast("int"), F.lit(0)))))


def note_events(notes, source="NOTE"):
    """Events from (id, timestamp, note, label) rows; a blank agent note is dropped."""
    rows = notes.filter(~text.is_blank(F.col("note"))) if source == "MCP" else notes
    null = F.lit(None).cast("string")
    return clean_events(rows.select(
        "id", "timestamp", F.lit(source).alias("source"),
        F.coalesce("label", F.lit(NOTE_LABELS[source])).alias("label"),
        F.col("note").alias("content"), null.alias("metadata"),
        F.lit(False).alias("was_redacted"), null.alias("cwd"), null.alias("git_repo"),
        null.alias("task_id")))
