"""Events, tasks, cards, context and review: small cases with known answers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions import jsonio
from worktrail.operators import capture, cards, dedup, ranking, retention, review
from worktrail.operators import events as E
from worktrail.operators import tasks as K
from worktrail.plans import context

T0 = datetime(2024, 3, 1, 9)


def now():
    return F.lit("2024-03-02 00:00:00").cast("timestamp")


def make_events(spark, rows):
    """rows: (id, seconds, source, label, content, metadata, task_id)."""
    df = spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), src, lab, con, meta, False, None, "r1", task)
         for i, s, src, lab, con, meta, task in rows],
        "id string, timestamp timestamp, source string, label string, content string, "
        "metadata string, was_redacted boolean, cwd string, git_repo string, task_id string")
    return df.repartition(4)


def make_tasks(spark, rows):
    """rows: (id, name, start, stop or None, status, summary)."""
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return spark.createDataFrame(
        [(i, n, None, at(a), at(b), st, su, "r1", 3) for i, n, a, b, st, su in rows],
        "id string, name string, description string, started_at timestamp, stopped_at timestamp, "
        "status string, summary string, git_repo string, event_count int")


@pytest.fixture(scope="module")
def session(spark):
    return make_events(spark, [
        ("1", 1, "TERM", "cargo check", "error in src/a.rs:4", '{"exit_code":101}', "t1"),
        ("2", 2, "TERM", " cargo check ", "again", '{"exit_code":0}', "t1"),
        ("3", 3, "NOTE", "note", "  use WAL  ", None, "t1"),
        ("4", 4, "TERM", "cargo test", "exited with code 1 in Cargo.toml ", None, "t1"),
        ("5", 5, "MCP", "AI note", " ", None, "t1"),
        ("6", 6, "TERM", "cargo check", "src/a.rs ok", None, "t1"),
        ("7", 7, "IDE", "Opened: b.py", "x", None, "t2"),
        ("8", 8, "TERM", "  ", "exit code 3", None, "t2"),
        ("9", 9, "TERM", "ls", "", None, None),
    ])


@pytest.fixture(scope="module")
def task_rows(spark):
    return make_tasks(spark, [("t1", "Fix it", 0, 125, "completed", None),
                              ("t2", "Other", 5, None, "active", None),
                              ("t3", "Gone", 6, 10, "abandoned", None)])


def card_of(df, task):
    return df.filter(F.col("task_id") == task).first().asDict(recursive=True)


def test_session_card(spark, session, task_rows):
    c = card_of(cards.session_cards(task_rows, session, now()), "t1")
    assert c["files_touched"] == ["src/a.rs", "Cargo.toml"]
    assert c["commands_verified"] == [
        {"cmd": "cargo check", "exit_code": 101}, {"cmd": "cargo test", "exit_code": 1},
        {"cmd": "cargo check", "exit_code": None}]
    assert c["decisions"] == ["use WAL"]
    assert (c["duration_secs"], c["result"], c["token_estimate"]) == (125, "completed", 50)
    other = card_of(cards.session_cards(task_rows, session, now()), "t2")
    assert other["commands_verified"] == [] and other["files_touched"] == ["b.py"]
    assert card_of(cards.session_cards(task_rows, session, now()), "t3")["result"] == "abandoned"


def test_card_orders_and_bounds(spark, session, task_rows):
    newest = card_of(cards.session_cards(task_rows, session, now(), max_events=3, order="desc"), "t1")
    assert [c["cmd"] for c in newest["commands_verified"]] == ["cargo check", "cargo test"]
    assert newest["decisions"] == []
    whole = card_of(cards.session_cards(task_rows, session, now(), max_events=10**6), "t1")
    assert whole == card_of(cards.session_cards(task_rows, session, now()), "t1")


def test_rows_agree_with_cards(spark, session, task_rows):
    full = card_of(cards.session_cards(task_rows, session, now()), "t1")
    cmds = cards.commands_verified(session).filter("task_id = 't1'").orderBy("timestamp").collect()
    assert [(r["cmd"], r["exit_code"]) for r in cmds] == [
        (c["cmd"], c["exit_code"]) for c in full["commands_verified"]]
    files = cards.files_touched(session).filter("task_id = 't1'").orderBy(
        "first_ts", "first_event", "first_pos").collect()
    assert [r["path"] for r in files] == full["files_touched"]
    est = {r["task_id"]: r["token_estimate"] for r in
           cards.token_estimates(task_rows, session).collect()}
    assert est == {"t1": 50, "t2": 50, "t3": 50}


def test_card_of_a_long_task_is_whole(spark):
    rows = [(f"{i:04d}", i, "TERM", f"make step{i}", f"in src/m{i % 7}.rs exit code 0", None, "long")
            for i in range(1500)]
    e = make_events(spark, rows)
    t = make_tasks(spark, [("long", "Long", 0, 2000, "completed", None)])
    card = cards.session_cards(t, e, now()).first()
    assert [c["cmd"] for c in card["commands_verified"]] == [r[3] for r in rows]
    assert card["token_estimate"] == cards.token_estimates(t, e).first()["token_estimate"]
    newest = cards.session_cards(t, e, now(), max_events=1200, order="desc").first()
    assert [c["cmd"] for c in newest["commands_verified"]] == [r[3] for r in rows[:-1201:-1]]


def test_card_json_and_markdown(spark, session, task_rows):
    c = cards.session_cards(task_rows, session, now())
    stored = cards.cards_json(c)
    back = stored.select("task_id", jsonio.card_from_json(F.col("summary")).alias("c")).select("c.*")
    assert sorted(map(str, back.collect())) == sorted(map(str, c.select(back.columns).collect()))
    md = c.filter("task_id = 't1'").select(cards.card_markdown(cards.card_struct(c))).first()[0]
    assert md == ("## Session: Fix it\n**Duration:** 2m 5s  **Result:** ✅ Completed\n\n"
                  "**Files Touched:**\n- `src/a.rs`\n- `Cargo.toml`\n\n"
                  "**Commands Verified:**\n- `cargo check` ❌ (exit 101)\n- `cargo test` ❌ (exit 1)\n"
                  "- `cargo check` —\n\n**Key Decisions:**\n- use WAL\n")
    bare = c.filter("task_id = 't3'").select(cards.card_markdown(cards.card_struct(c))).first()[0]
    assert bare == "## Session: Gone\n**Duration:** 4s  **Result:** ❌ Abandoned\n\n"


def test_summary_fallback(spark, session, task_rows):
    stored = cards.cards_json(cards.session_cards(task_rows, session, now())).filter("task_id = 't3'")
    t = K.update_summaries(task_rows, stored)
    t = t.withColumn("summary", F.when(F.col("id") == "t2", "junk").otherwise(F.col("summary")))
    got = {r["task_id"]: r for r in cards.task_summaries(t, session, now()).collect()}
    assert {k: v["origin"] for k, v in got.items()} == {
        "t1": "computed", "t2": "raw", "t3": "stored"}
    assert got["t2"]["raw"] == "junk" and got["t1"]["card"]["decisions"] == ["use WAL"]


def random_rows(n=600, seed=1):
    rnd = random.Random(seed)
    # One key holds a third of the rows.
    return [(f"{i:04d}", rnd.randrange(0, 40000), "TERM", rnd.choice("abc"), "", None,
             "hot" if i % 3 == 0 else f"t{rnd.randrange(20)}") for i in range(n)]


def ordered(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by.setdefault(r[6], []).append(r)
    return by


def test_commands_on_hot_tasks(spark):
    rows = random_rows()
    want = []
    for key, rs in ordered(rows).items():
        for prev, r in zip([None, *rs], rs):
            if prev is None or prev[3] != r[3]:
                want.append((key, r[0]))
    got = cards.commands_verified(make_events(spark, rows)).select("task_id", "id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_debounce_on_hot_keys(spark):
    rows = random_rows()
    want = []
    for rs in ordered(rows).values():
        for r, nxt in zip(rs, [*rs[1:], None]):
            if nxt is None or nxt[1] - r[1] >= 120:
                want.append(r[0])
    for bucket in ("hour", "minute"):
        got = capture.debounce(make_events(spark, rows), ["task_id"], 120_000, bucket).collect()
        assert sorted(r["id"] for r in got) == sorted(want)


def test_neighbours_read_and_deal_the_input_once(spark):
    from worktrail.plans import inputs as I
    for df in (cards.commands_verified(I.events(spark, "/root/testdata/sf0.001")),
               capture.debounce(I.events(spark, "/root/testdata/sf0.001"), ["source"], 60_000)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_neighbours_of_one_crowded_hour(spark):
    """All rows of one key in one hour lie in many buckets; equal times are in order of id."""
    rows = [(f"{i:05d}", i // 3, "TERM", "abc"[i * i % 3], "", None, "hot") for i in range(6000)]
    e = make_events(spark, rows)
    got = ranking.with_neighbour(e, ["task_id"], "timestamp", ["timestamp", "id"], F.col("id"), "prev")
    assert sorted((r["id"], r["prev"], r["has_prev"]) for r in got.collect()) == [
        (r[0], rows[i - 1][0] if i else None, i > 0) for i, r in enumerate(rows)]
    spread = e.groupBy(F.date_trunc("minute", "timestamp")).count().agg(F.max("count")).first()[0]
    assert spread <= 180


def test_newest_per_key_on_hot_keys(spark):
    rows = random_rows()
    want = [(k, r[0], n + 1) for k, rs in ordered(rows).items()
            for n, r in enumerate(sorted(rs, key=lambda r: (-r[1], r[0]))[:5])]
    got = cards.task_newest(make_events(spark, rows), 5).select("task_id", "id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_salted_lookup(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 3)
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    got = ranking.salted_lookup(big, small, ["k"], salt_on=["id"])
    assert got.count() == 67 and got.exceptAll(big.join(small, "k").select(got.columns)).count() == 0


def test_insert_if_absent(spark):
    batch = make_events(spark, [("a", 1, "TERM", "first", "", None, None),
                                ("a", 2, "TERM", "second", "", None, None),
                                ("b", 1, "GIT", "old", "", None, None)])
    stored = batch.filter("id = 'b'")
    new = dedup.insert_if_absent(batch, stored).collect()
    assert [(r["id"], r["label"]) for r in new] == [("a", "first")]
    assert tuple(dedup.ingest_counts(batch, stored).first()) == (3, 1, 2)


def test_filters_and_paging(spark, session):
    got = E.recent(session, E.EventFilter(limit=2, offset=1)).collect()
    assert [r["id"] for r in got] == ["8", "7"]
    flt = E.EventFilter(source="TERM", task_id="t1", since=T0 + timedelta(seconds=2),
                        until=T0 + timedelta(seconds=4))
    assert sorted(r["id"] for r in E.apply_filter(session, flt).collect()) == ["2", "4"]
    assert E.count_events(session, flt).first()[0] == 2
    assert [r["id"] for r in E.notes(session, 1).collect()] == ["5"]
    assert (E.EventFilter(limit=9999).resolved_limit, E.EventFilter(limit=0).resolved_limit) == (200, 1)


def test_prune_is_monotone(spark, session):
    kept = lambda d: {r["id"] for r in retention.prune(
        session, F.lit(T0 + timedelta(days=d)).cast("timestamp"), 1).collect()}
    assert kept(0) == set("123456789") and kept(10) == set("12345678")
    assert retention.prune_count(session, F.lit(T0 + timedelta(days=10)), 1).first()[0] == 1


def test_task_lists(spark, task_rows):
    assert K.active_task(task_rows).first()["id"] == "t2"
    assert K.latest_session(task_rows).first()["id"] == "t1"
    assert K.task_by_id(task_rows, "t3").first()["status"] == "abandoned"
    assert [r["id"] for r in K.task_list(task_rows).collect()] == ["t3", "t2", "t1"]


def test_lifecycle(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    log = [("a", "start", at(0), 0), ("a", "stop", at(5), 1), ("a", "abandon", at(6), 2),
           ("b", "stop", at(0), 0), ("b", "start", at(1), 1), ("b", "abandon", at(2), 2),
           ("c", "start", at(0), 0), ("d", "stop", at(0), 0)]
    actions = spark.createDataFrame(log, S.ACTION_SCHEMA)
    got = {r["task_id"]: (r["status"], r["stopped_at"]) for r in K.task_state(actions).collect()}
    assert got == {"a": ("completed", at(5)), "b": ("abandoned", at(2)), "c": ("active", None)}


def test_workspace_context(spark):
    files = spark.createDataFrame([(1, "/w/repo/sub/x.rs"), (2, "/w/repo/y.rs"), (3, "/tmp/z.rs"),
                                   (4, "/w/repository/y.rs")], "id int, path string")
    roots = spark.createDataFrame([("/w/repo",), ("/w/repo/sub",)], "root string")
    got = {r["id"]: (r["cwd"], r["git_repo"]) for r in
           capture.workspace_context(files, roots).collect()}
    assert got == {1: ("/w/repo/sub", "sub"), 2: ("/w/repo", "repo"), 3: ("/tmp", None),
                   4: ("/w/repository", None)}


def test_context_text(spark, session, task_rows):
    tiers = context.context_tiers(session, task_rows, flt=E.EventFilter(source="IDE"))
    out = context.context_text(tiers).first()["text"]
    assert out.startswith("## Lasting notes\n- **AI note** _2024-03-01 09:00 UTC_\n")
    assert "**Other** | since 2024-03-01 09:00 UTC | 3 events\n" in out
    assert "- **Fix it** (3 events)" in out
    assert out.endswith("**[IDE] Opened: b.py** _2024-03-01 09:00 UTC_\n```\nx\n```")
    empty = context.context_tiers(session.limit(0), task_rows.limit(0))
    assert empty.count() == 0
    assert "exclude" not in [r["id"] for r in context.context_tiers(
        session, task_rows, exclude_notes=True).filter("tier = 1 and id in ('3', '5')").collect()]


def block(path, body, extra=""):
    return f"diff --git a/{path} b/{path}\n{extra}{body}"


def bounded(spark, diff, **kw):
    df = spark.createDataFrame([(1, diff)], "diff_id int, diff string")
    return review.bounded_diff(df, **kw).first()


def test_diff_filtering(spark):
    diff = "\n".join([block("src/lib.rs", "+a"), block("Cargo.lock", "+b"), block("a.png", "x"),
                      block("old.rs", "-x", "deleted file mode 100644\n"),
                      block("bin.dat", "", "Binary files a and b differ\n"), block("b.rs", "+c")])
    r = bounded(spark, diff)
    assert r["kept_files"] == ["src/lib.rs", "b.rs"] and not r["was_truncated"]
    assert r["bounded_diff"] == block("src/lib.rs", "+a") + "\n\n" + block("b.rs", "+c")
    assert bounded(spark, "  ")["kept_files"] == [] and bounded(spark, "  ")["bounded_diff"] == ""


def test_diff_bounds(spark):
    diff = "\n".join(block(f"f{i}.rs", "+" + "x" * 50) for i in range(5))
    r = bounded(spark, diff, max_files=3, max_file=40, max_total=120)
    assert r["kept_files"] == ["f0.rs", "f1.rs", "f2.rs"] and r["was_truncated"]
    assert r["bounded_diff"].endswith("[... diff cut at 120 bytes ...]\n")
    assert r["notice"].startswith("> **Not all was reviewed:** File `f0.rs` is cut at 40 bytes.")
    assert "More files than the limit (3 files)" in r["notice"]


REVIEWS = [
    ("#### 🔴 CRITICAL: x\n### Recommendation\nPASS", "FAIL", (1, 0, 0, 0)),
    ("looks fine", "PASS", (0, 0, 0, 0)),
    ("**Severity**: low", "WARN", (0, 0, 0, 1)),
    ("**Severity**: MEDIUM\n### Recommendation\n\nOverall: fail", "FAIL", (0, 0, 1, 0)),
    ("#### High\n#### Highway", "FAIL", (0, 1, 0, 0)),
    ("### Recommendation\nWARN", "WARN", (0, 0, 0, 0)),
]


def test_review_scores(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REVIEWS)], "i int, text string")
    got = review.score_reviews(df).orderBy("i").collect()
    assert [r["status"] for r in got] == [s for _, s, _ in REVIEWS]
    assert [tuple(r[f"n_{s.lower()}"] for s in review.SEVERITIES) for r in got] == [
        c for _, _, c in REVIEWS]
    noted = review.score_reviews(df).withColumn("notice", F.lit("> cut"))
    text = review.review_comment(noted, now()).orderBy("i").first()["comment"]
    assert text.startswith("<!-- automated-review -->\n## Automatic review\n\n"
                           "**Verdict:** 🔴 **FAIL**")
    assert "\n\n> cut\n\n#### 🔴 CRITICAL" in text


def test_comment_upsert(spark):
    m = review.COMMENT_MARKER
    old = spark.createDataFrame([(1, 10, 0, "hi"), (1, 11, 1, m + "a"), (1, 12, 2, m), (2, 20, 0, "x")],
                                "pr_id int, comment_id int, pos int, body string")
    new = spark.createDataFrame([(1,), (2,), (3,)], "pr_id int")
    got = {r["pr_id"]: (r["action"], r["comment_id"]) for r in
           review.upsert_comments(new, old).collect()}
    assert got == {1: ("updated", 11), 2: ("created", None), 3: ("created", None)}
