"""Which folders of a stored table are live, as a sequence of small versions.

Writers put rows into new part folders and then commit a version that names all
live parts; readers take the newest version. A part that no version names is never
read, so a writer that dies half-way leaves nothing behind that counts, and a
repeated write of the same part replaces its own files. A change replaces only
parts that it has read, so parts committed meanwhile stay.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql.utils import AnalysisException

ENTRY = "kind string, part string, day string, level int, facts map<string,bigint>"


@dataclass(frozen=True)
class Entry:
    """One live folder: ``part``, or one day of it."""

    kind: str
    part: str
    day: str | None = None
    level: int = 0
    facts: tuple = ()

    def fact(self, name):
        return dict(self.facts).get(name, 0)


def facts(**named):
    return tuple(sorted((k, int(v)) for k, v in named.items()))


@dataclass
class Manifest:
    root: str
    _known: tuple = field(default=(0, ()), repr=False)

    @property
    def path(self):
        return f"{self.root}/versions"

    def newest(self, spark):
        """(version, entries); reads nothing but names where the version is known already."""
        try:
            names = spark.read.schema(ENTRY).parquet(self.path).inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            names = []  # nothing written there yet
        version = max((int(m[1]) for n in names if (m := re.search(r"version=(\d+)/", n))), default=0)
        if version != self._known[0]:
            rows = spark.read.schema(ENTRY).parquet(f"{self.path}/version={version}").collect()
            self._known = version, tuple(
                Entry(r["kind"], r["part"], r["day"], r["level"], tuple(sorted(r["facts"].items())))
                for r in rows)
        return self._known

    def commit(self, spark, added, replaced=()):
        """A new version with ``added`` in place of ``replaced``; a part that is there stays as it is."""
        while True:
            version, live = self.newest(spark)
            gone = set(replaced)
            kept = [e for e in live if e not in gone]
            names = {(e.kind, e.part, e.day) for e in kept}
            entries = kept + [e for e in added if (e.kind, e.part, e.day) not in names]
            rows = [(e.kind, e.part, e.day, e.level, dict(e.facts)) for e in entries]
            made = spark.createDataFrame(rows, ENTRY).coalesce(1)
            try:
                made.write.mode("error").parquet(f"{self.path}/version={version + 1}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                continue  # another writer was first
            self._known = version + 1, tuple(entries)
            return

    def live(self, spark, kind):
        return [e for e in self.newest(spark)[1] if e.kind == kind]


def read_parts(spark, schema, paths, base=None):
    """One scan over part folders of one schema; an empty frame where there are none."""
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def due(entries, fanout):
    """Entries of the lowest level that has ``fanout`` of them, or none."""
    for level in sorted({e.level for e in entries}):
        same = [e for e in entries if e.level == level]
        if len(same) >= fanout:
            return same
    return []
