"""Streams equal their batch operators; replays and duplicates change nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worktrail.operators import capture, search
from worktrail.operators import tasks as K
from worktrail.plans import inputs as I
from worktrail.sources import events as src
from worktrail.sources import store as stores
from worktrail.sources import textstore
from worktrail.sources.store import EventStore
from worktrail.streaming import ingest, state

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def request_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("requests"))
    r = src.parse_requests(I.requests(spark, D))
    r.repartition(5, "id").write.mode("append").parquet(path)
    r.filter(F.col("label").startswith("click")).coalesce(1).write.mode("append").parquet(path)
    return path


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_ingest_is_idempotent(spark, request_files, tmp_path):
    store, idx = EventStore(str(tmp_path / "store")), str(tmp_path / "index")

    def once(checkpoint):
        stream = src.stream_requests(spark, request_files, "parquet", max_files=3)
        run(ingest.start_ingest(stream, store, str(tmp_path / checkpoint), idx, drain=True))

    once("c1")
    valid, rejected = src.split_requests(src.parse_requests(I.requests(spark, D)))
    want = sorted(map(tuple, src.to_events(valid).collect()), key=str)
    got = lambda: sorted(map(tuple, store.read(spark).drop("event_date").collect()), key=str)
    assert got() == want
    assert spark.read.parquet(f"{store.root}/quarantine").select("id").distinct().count() == \
        rejected.count()
    once("c1")
    once("c2")  # a lost checkpoint replays everything
    assert got() == want

    whole = search.build_index(store.read(spark))
    grown = textstore.TextStore(idx).load(spark)
    assert sorted(textstore.term_stats(grown).collect()) == sorted(search.term_stats(whole).collect())


def test_repeats_without_ids_stay_apart(spark):
    rows = [("terminal", "cargo test", "ok")] * 3 + [("git", "commit", "x")]
    r = spark.createDataFrame(rows, "source string, label string, content string").select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"),
        "source", "label", "content", *[F.lit(None).cast("string").alias(c) for c in (
            "metadata", "cwd", "git_repo", "task_id")], F.lit(None).cast("boolean").alias("was_redacted"))
    ids = lambda scope: sorted(x["id"] for x in src.to_events(
        src.split_requests(r)[0], scope).select("id").collect())
    assert len(set(ids("a"))) == 4
    assert ids("a") == ids("a") != ids("b")


def nameless(spark, rows):
    return spark.createDataFrame(rows, "source string, label string, content string").select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"),
        "source", "label", "content", *[F.lit(None).cast("string").alias(c) for c in (
            "metadata", "cwd", "git_repo", "task_id")], F.lit(None).cast("boolean").alias("was_redacted"))


def test_streams_keep_requests_without_ids(spark, tmp_path):
    """Two streams into one store: real repeats stay apart; the tail gives every event."""
    store = EventStore(str(tmp_path / "store"))
    for k in (1, 2):
        path = str(tmp_path / f"in{k}")
        nameless(spark, [("terminal", "git status", "ok")] * 2).coalesce(1).write.parquet(path)
        stream = src.stream_requests(spark, path, "parquet")
        for _ in range(2):
            run(ingest.start_ingest(stream, store, str(tmp_path / f"c{k}"), drain=True))
        run(ingest.start_tail(stream, str(tmp_path / f"tail{k}"), str(tmp_path / f"t{k}"), drain=True))
        assert spark.read.text(str(tmp_path / f"tail{k}")).count() == 2
    assert store.read(spark).count() == 4


def test_quarantine_keeps_malformed_text(spark):
    raw = spark.createDataFrame([("{broken",), ('{"source":"term"}',), ("[1]",), (None,)], "value string")
    _, rejected = src.split_requests(src.parse_requests(raw))
    got = {(r["malformed"], r["reason"]) for r in rejected.collect()}
    assert ("{broken", "malformed JSON") in got and ("[1]", "malformed JSON") in got
    assert (None, "unknown source: null") in got


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_are_utc_in_any_session(spark, tmp_path, zone):
    from worktrail.functions import times
    from worktrail.operators import events as E
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        e = nameless(spark, [("TERM", "a", "b")]).withColumn(
            "timestamp", F.timestamp_seconds(F.lit(1704074400))).withColumn("id", F.lit("x"))
        store = EventStore(str(tmp_path / "s"))
        store.append(e)
        row = store.read(spark).select("event_date", times.stamp(F.col("timestamp")).alias("s")).first()
        assert str(row["event_date"]) == "2024-01-01" and row["s"] == "2024-01-01 02:00 UTC"
        hit = E.EventFilter(since=datetime(2024, 1, 1), until=datetime(2024, 1, 1, 2))
        assert E.apply_filter(store.read(spark), hit).count() == 1
        miss = E.EventFilter(since=datetime(2024, 1, 1, 2, 0, 1))
        assert E.apply_filter(store.read(spark), miss).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_tail_emits_every_event(spark, request_files, tmp_path):
    stream = src.stream_requests(spark, request_files, "parquet")
    run(ingest.start_tail(stream, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True))
    lines = spark.read.text(str(tmp_path / "out"))
    valid, _ = src.split_requests(src.read_requests(spark, request_files, "parquet"))
    assert lines.count() == valid.count()
    assert '"source":"TERM"' in lines.filter(F.contains("value", F.lit("click"))).first()[0]


def shuffled_stream(spark, rows, schema, path, parts=5):
    """Rows as a stream of micro-batches whose times are mixed."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce_over_shuffled_batches(spark, tmp_path):
    e = I.events(spark, D)
    rows = sorted(e.collect(), key=lambda r: hash(r["id"]))
    day = 86_400_000
    stream = shuffled_stream(spark, rows, e.schema, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for checkpoint in ("cp", "cp"):  # the second run finds nothing new
        run(state.start_debounce(stream, ["source"], 600_000, 60 * day, out,
                                 str(tmp_path / checkpoint), drain=True))
    want = capture.debounce(e, ["source"], 600_000)
    got = state.closed_bursts(spark, out, e.schema).unionByName(
        state.flush_debounce(spark, out, str(tmp_path / "cp"), e, ["source"], 600_000))
    got = got.select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_debounce_closes_bursts_and_keeps_late_rows(spark, tmp_path):
    schema = "id string, timestamp timestamp, source string"
    at = lambda m: datetime(2024, 1, 1, 9, m)
    out, path, seen = str(tmp_path / "out"), str(tmp_path / "in"), []
    for m in (1, 30, 40, 10, 59):
        spark.createDataFrame([(str(m), at(m), None)], schema).coalesce(1).write.mode(
            "append").parquet(path)
        run(state.start_debounce(spark.readStream.schema(schema).parquet(path), ["source"],
                                 300_000, 600_000, out, str(tmp_path / "cp"), drain=True))
        seen.append(sorted(r["id"] for r in state.closed_bursts(spark, out, schema).collect()))
    assert seen == [[], ["1"], ["1"], ["1"], ["1", "30", "40"]]
    late = spark.read.parquet(f"{out}/late")
    assert [r["id"] for r in late.collect()] == ["10"]
    empty = spark.createDataFrame([], schema)
    rest = state.flush_debounce(spark, out, str(tmp_path / "cp"), empty, ["source"], 300_000)
    assert [r["id"] for r in rest.collect()] == ["59"]


def test_running_counts(spark):
    q = (state.running_counts(I.events(spark, D, stream=True), "source").writeStream
         .format("memory").queryName("counts").outputMode("complete")
         .trigger(availableNow=True).start())
    run(q)
    want = {r["source"]: r["count"] for r in I.events(spark, D).groupBy("source").count().collect()}
    assert {r["source"]: r["n_events"] for r in spark.table("counts").collect()} == want


def test_counts_over_batches(spark, tmp_path):
    e = I.events(spark, D)
    stream = shuffled_stream(spark, e.collect(), e.schema, str(tmp_path / "in"), 3)
    run(state.start_counts(stream, ["source"], str(tmp_path / "out"), str(tmp_path / "cp"), drain=True))
    got = state.counts(spark, str(tmp_path / "out"), "source string, n_events bigint", ["source"])
    assert {tuple(r) for r in got.collect()} == {
        tuple(r) for r in e.groupBy("source").count().collect()}


def test_lifecycle_over_shuffled_batches(spark, tmp_path):
    a = I.actions(spark, D)
    rows = sorted(a.collect(), key=lambda r: hash((r["seq"], r["task_id"])))
    stream = shuffled_stream(spark, rows, a.schema, str(tmp_path / "in"))
    run(state.start_lifecycle(stream, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True))
    want, got = K.task_state(a), state.lifecycle(spark, str(tmp_path / "out"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_lifecycle_keeps_state_between_runs(spark, tmp_path):
    path, at = str(tmp_path / "log"), lambda m: datetime(2024, 1, 1, 9, m)
    runs = [[("a", "start", at(1), 1), ("b", "stop", at(1), 1), ("d", "stop", at(5), 2)],
            [("a", "stop", at(2), 2), ("b", "start", at(2), 2), ("c", "start", at(2), 1)],
            [("a", "abandon", at(3), 3), ("b", "abandon", at(3), 3), ("d", "start", at(4), 1)]]
    for rows in runs:
        spark.createDataFrame(rows, state.ACTIONS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(state.ACTIONS).parquet(path)
        run(state.start_lifecycle(stream, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True))
    got = {r["task_id"]: (r["status"], r["started_at"], r["stopped_at"]) for r in
           state.lifecycle(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("completed", at(1), at(2)), "b": ("abandoned", at(2), at(3)),
                   "c": ("active", at(2), None), "d": ("completed", at(4), at(5))}


def plain_events(spark, rows):
    """(id, minutes, label) as stored events."""
    e = spark.createDataFrame(rows, "id string, minutes int, label string").select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("minutes") * 60).alias("timestamp"),
        F.lit("TERM").alias("source"), "label", F.lit("").alias("content"))
    for c in ("metadata", "cwd", "git_repo", "task_id"):
        e = e.withColumn(c, F.lit(None).cast("string"))
    return e.withColumn("was_redacted", F.lit(False))


def test_ledger_reads_own_buckets_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FANOUT", 4)
    store = EventStore(str(tmp_path / "s"))
    seen = []
    for k in range(20):
        rows = [(f"e{i}", i * 50, f"batch {k}") for i in range(k * 10, k * 10 + 20)]  # half known
        store.append(plain_events(spark, rows), part=f"b{k}")
        store.compact(spark, 4)
        parts = store.manifest.live(spark, "ids")
        seen.append((len(parts), len(store.manifest.live(spark, "events"))))
    got = {r["id"]: r["label"] for r in store.read(spark).collect()}
    assert len(got) == store.read(spark).count() == 210
    assert all(got[f"e{i}"] == f"batch {max(0, (i - 10) // 10)}" for i in range(210))
    assert max(n for n, _ in seen) <= 8 and store.read(spark).select("id").distinct().count() == 210
    ids = spark.createDataFrame([("e5",)], "id string")
    probe = store.known_ids(spark, ids)
    assert [r[0] for r in probe.collect()] == ["e5"]
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "id_bucket" in plan.split("PartitionFilters: [")[1][:80]


def test_append_is_repeatable_and_first_arrival_counts(spark, tmp_path):
    store = EventStore(str(tmp_path / "s"))
    rows = plain_events(spark, [("a", 5, "later"), ("a", 1, "earlier"), ("b", 1, "x")]).coalesce(1)
    first = rows.withColumn("arrival", F.monotonically_increasing_id())
    for _ in range(2):
        store.append(first, part="p", order=("arrival",))
    assert {r["id"]: r["label"] for r in store.read(spark).collect()} == {"a": "later", "b": "x"}
    # A write that died before its commit leaves nothing that counts.
    stores.write_events(plain_events(spark, [("c", 1, "lost")]), f"{store.events_path}/part=dead")
    assert store.read(spark).count() == 2
    store.append(plain_events(spark, [("c", 1, "kept"), ("a", 9, "again")]), part="q")
    assert {r["id"]: r["label"] for r in store.read(spark).collect()} == {"a": "later", "b": "x", "c": "kept"}


def test_prune_beside_ingest(spark, tmp_path, monkeypatch):
    """Events appended while retention runs stay; pruned ids may come back."""
    store, now = EventStore(str(tmp_path / "s")), F.lit(datetime(2024, 3, 1))
    store.append(plain_events(spark, [("a", 1, "x"), ("b", 2, "x")]), part="p")
    write = EventStore._write_events

    def slow(self, session, events, part, level=0):
        if part.startswith("pruned"):
            EventStore(self.root).append(plain_events(spark, [("c", 3, "meanwhile")]), part="q")
        return write(self, session, events, part, level)

    monkeypatch.setattr(EventStore, "_write_events", slow)
    assert store.prune(spark, now, 30) == 2
    assert [r["id"] for r in store.read(spark).collect()] == ["c"]
    monkeypatch.setattr(EventStore, "_write_events", write)
    store.append(plain_events(spark, [("a", 4, "back"), ("c", 9, "no")]), part="r")
    assert {r["id"]: r["label"] for r in store.read(spark).collect()} == {"a": "back", "c": "meanwhile"}
    assert store.prune(spark, now, 30) == 2 and store.read(spark).count() == 0


def test_prune_rewrites_only_affected_days(spark, tmp_path):
    store = EventStore(str(tmp_path / "s"))
    now = datetime(2024, 2, 1)
    rows = [("a", now - timedelta(days=45), "TERM", None), ("b", now - timedelta(days=45), "NOTE", None),
            ("c", now - timedelta(days=44), "TERM", None), ("d", now - timedelta(days=45), "MCP", None),
            ("e", now - timedelta(days=45), "GIT", "t1"), ("f", now - timedelta(days=5), "TERM", None),
            ("g", now - timedelta(days=40), "NOTE", None)]
    e = spark.createDataFrame(rows, "id string, timestamp timestamp, source string, task_id string")
    for c in ("label", "content"):
        e = e.withColumn(c, F.lit(""))
    for c in ("metadata", "cwd", "git_repo"):
        e = e.withColumn(c, F.lit(None).cast("string"))
    store.append(e.withColumn("was_redacted", F.lit(False)))
    files = lambda: set(store.read(spark).inputFiles())
    before = files()
    assert store.prune(spark, F.lit(now), 30) == 2
    assert sorted(r["id"] for r in store.read(spark).collect()) == ["b", "d", "e", "f", "g"]
    day = lambda n: {f for f in before if f"event_date={(now - timedelta(days=n)).date()}" in f}
    assert day(5) | day(40) <= files() and not day(45) & files() and not day(44) & files()
    assert store.prune(spark, F.lit(now), 30) == 0
