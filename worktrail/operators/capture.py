"""Editor capture: noise filters, switches, workspace lookup, burst debounce."""

from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions.text import basename
from worktrail.operators.ranking import newest_per_key, salted_lookup, with_neighbour

# Documents never captured, and the burst length.
SCHEME = "file"
NOISE_PARTS = (".git/", "node_modules/")
NOISE_SUFFIX = ".vsix"
DEBOUNCE_MS = 2000


def keep_document(scheme, path):
    keep = (scheme == SCHEME) & ~path.endswith(NOISE_SUFFIX)
    for part in NOISE_PARTS:
        keep = keep & ~F.contains(path, F.lit(part))
    return keep


def enabled_kinds(df, open=True, save=True, selection=True, focus=True):
    """Keep the kinds whose capture switch is on."""
    on = [k for k, v in {"open": open, "save": save, "selection": selection,
                         "focus": focus}.items() if v]
    return df.filter(F.col("kind").isin(*on))


def parent_dir(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def workspace_context(files, workspaces, key="id"):
    """Add cwd and git_repo: the innermost workspace above each file.

    Each file lists its ancestor folders (as many as its path is deep) and
    meets the workspace roots by equality, so no range or cross join is needed.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                        lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = (salted_lookup(files.select(key, F.explode(above).alias("root")),
                           workspaces.select("root").distinct(), ["root"], salt_on=[key])
             .groupBy(key).agg(F.max_by("root", F.length("root")).alias("root")))
    return (files.join(found, key, "left")
            .withColumn("cwd", F.coalesce("root", parent_dir(F.col("path"))))
            .withColumn("git_repo", basename(F.col("root")))
            .drop("root"))


def debounce(events, keys, delay_ms=DEBOUNCE_MS, bucket="minute"):
    """The last event of each burst: none of its key follows within the delay.

    ``bucket`` is the time unit by which a key's rows spread over tasks.
    """
    near = with_neighbour(events, keys, "timestamp", ["timestamp", "id"],
                          F.col("timestamp"), "next_ts", ahead=True, bucket=bucket)
    quiet = F.unix_micros("next_ts") - F.unix_micros("timestamp") >= delay_ms * 1000
    return near.filter(~F.col("has_next_ts") | quiet).drop("next_ts", "has_next_ts")


def feed_latest(events, keys, size=S.FEED_SIZE):
    """The newest events of each feed."""
    return newest_per_key(events, keys, [F.desc("timestamp"), F.asc("id")], size)
