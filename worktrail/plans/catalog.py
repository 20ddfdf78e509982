"""The registered queries: each runs one operator over the driver's tables."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.functions import clean, jsonio, text, times
from worktrail.operators import capture, cards, dedup, retention, review, search
from worktrail.operators import events as E
from worktrail.operators import tasks as K
from worktrail.plans import context
from worktrail.plans import inputs as I
from worktrail.session import work_dir
from worktrail.sources import events as src
from worktrail.sources import textstore
from worktrail.sources.store import EventStore
from worktrail.sources.textstore import TextStore
from worktrail.streaming import ingest, state

QUERIES = {}
PRUNE_DAYS = 14
BURST_MS = 600_000
TASK = "8-2024-01-01"
SINCE, UNTIL = datetime(2024, 1, 5, 12), datetime(2024, 1, 20)


def plain(df):
    """Result columns in plain types: zone-free times, 64-bit integers."""
    def cast(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        return c.alias(f.name)
    return df.select(*[cast(f) for f in df.schema.fields])


def query(fn):
    def run(spark, sf_dir):
        return plain(fn(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- sources, sinks, decoding --------------------------------------------------

@query
def src_events(s, d):
    valid, _ = src.split_requests(src.parse_requests(I.requests(s, d)))
    return src.to_events(valid).select(
        "id", "timestamp", "source", "label", "content", "metadata", "was_redacted",
        "git_repo", "task_id")


@query
def src_quarantine(s, d):
    _, rejected = src.split_requests(src.parse_requests(I.requests(s, d)))
    return rejected.select("id", "source", "reason")


@query
def decode_events(s, d):
    decoded, _ = src.decode_events(I.stored_rows(s, d))
    return decoded.select("id", "timestamp", "source", "task_id", "was_redacted")


@query
def decode_rejects(s, d):
    _, rejected = src.decode_events(I.stored_rows(s, d))
    return rejected.select("id", F.col("timestamp").alias("written"))


@query
def decode_tasks(s, d):
    return src.decode_tasks(I.stored_task_rows(s, d))


@query
def parse_ts(s, d):
    return I.time_texts(s, d).select(
        "event_id", times.parse_timestamp(F.col("written")).alias("parsed"))


@query
def ingest_dedup(s, d):
    new = dedup.insert_if_absent(I.offered_batch(s, d), I.stored_history(s, d), order=("copy",))
    return new.select("id", "timestamp", "source", "label")


@query
def ingest_counts(s, d):
    return dedup.ingest_counts(I.offered_batch(s, d), I.stored_history(s, d))


@query
def remember_notes(s, d):
    t = I.turns(s, d)
    made = src.note_events(t.filter("role <> 'assistant'"), "NOTE").unionByName(
        src.note_events(t.filter("role = 'assistant'"), "MCP"))
    return made.select("id", "timestamp", "source", "label", "content", "was_redacted")


@query
def task_state(s, d):
    return K.task_state(I.actions(s, d))


@query
def task_start(s, d):
    t = I.tasks(s, d)
    new = t.select(F.concat("id", F.lit("-next")).alias("id"), "name", "description",
                   F.col("stopped_at").alias("started_at"), "git_repo"
                   ).filter(F.col("started_at").isNotNull())
    return K.start_tasks(t, new).select("id", "name", "status", "started_at", "stopped_at",
                                        "event_count")


@query
def task_summary_update(s, d):
    t = I.tasks(s, d, with_summary=True)
    done = t.filter(F.col("status") == "completed")
    new = done.select(F.col("id").alias("task_id"), F.concat(F.lit("S:"), "id").alias("summary"))
    ghost = done.select(F.concat("id", F.lit("-none")).alias("task_id"), F.lit("x").alias("summary"))
    return K.update_summaries(t, new.unionByName(ghost)).select("id", "status", "summary")


@query
def events_json(s, d):
    return E.to_json_rows(I.events(s, d))


# --- filters -------------------------------------------------------------------

def _filtered(s, d, **kw):
    return E.apply_filter(I.events(s, d), E.EventFilter(**kw)).select(
        "id", "timestamp", "source", "git_repo", "task_id")


@query
def filter_source(s, d):
    return _filtered(s, d, source="TERM")


@query
def filter_repo(s, d):
    return _filtered(s, d, git_repo="repo3")


@query
def filter_task(s, d):
    return _filtered(s, d, task_id=TASK)


@query
def filter_since(s, d):
    return _filtered(s, d, since=SINCE)


@query
def filter_until(s, d):
    return _filtered(s, d, until=UNTIL)


@query
def filter_all(s, d):
    return _filtered(s, d, source="IDE", git_repo="repo1", since=SINCE, until=UNTIL)


@query
def prune(s, d):
    return retention.prune(I.events(s, d), I.now(), PRUNE_DAYS).select("id", "timestamp", "source")


@query
def prune_count(s, d):
    return retention.prune_count(I.events(s, d), I.now(), PRUNE_DAYS)


@query
def filter_noise_paths(s, d):
    return I.page_paths(s, d).filter(capture.keep_document(F.col("scheme"), F.col("path"))
                                     ).select("page_id", "path")


def _kinds():
    return (F.when(F.col("source") == "TERM", "selection").when(F.col("source") == "GIT", "save")
            .when(F.col("source") == "MCP", "focus").otherwise("open"))


@query
def filter_kinds(s, d):
    e = I.events(s, d).select("id", _kinds().alias("kind"))
    return capture.enabled_kinds(e, focus=False)


@query
def diff_ignored(s, d):
    return I.page_paths(s, d).select(
        "page_id", "path", review.is_ignored_file(F.col("path")).alias("ignored"))


# --- joins ---------------------------------------------------------------------

@query
def orphan_task_refs(s, d):
    known = I.tasks(s, d).filter(F.col("status") != "abandoned")
    return E.orphan_task_refs(I.events(s, d), known)


@query
def detach_orphans(s, d):
    known = I.tasks(s, d).filter(F.col("status") != "abandoned")
    return E.detach_orphans(I.events(s, d), known).select("id", "task_id")


@query
def workspace_context(s, d):
    return capture.workspace_context(
        I.page_paths(s, d), I.workspaces(s, d), key="page_id"
    ).select("page_id", "path", "cwd", "git_repo")


# --- aggregations --------------------------------------------------------------

@query
def count_events(s, d):
    return E.count_events(I.events(s, d), E.EventFilter(source="GIT", since=SINCE))


@query
def task_event_counts(s, d):
    return E.task_event_counts(I.events(s, d))


@query
def source_counts(s, d):
    return E.counts_by(I.events(s, d), "source")


@query
def files_touched(s, d):
    return cards.files_touched(I.events(s, d))


@query
def commands_verified(s, d):
    return cards.commands_verified(I.events(s, d))


@query
def decisions(s, d):
    return cards.decisions(I.events(s, d))


@query
def token_estimate(s, d):
    return cards.token_estimates(I.tasks(s, d), I.events(s, d))


@query
def session_cards(s, d):
    c = I.session_cards(s, d)
    return c.select("task_id", "goal", "duration_secs", "result", "token_estimate",
                    F.to_json("files_touched").alias("files_touched"),
                    F.to_json("commands_verified", {"ignoreNullFields": "false"})
                    .alias("commands_verified"),
                    F.to_json("decisions").alias("decisions"))


@query
def session_cards_recent(s, d):
    """Cards from each task's two newest events, newest first."""
    c = I.session_cards(s, d, max_events=2, order="desc")
    return c.select("task_id", "token_estimate", F.to_json("files_touched").alias("files_touched"),
                    F.to_json("decisions").alias("decisions"))


@query
def fts_stats(s, d):
    t = search.term_stats(search.build_index(I.documents(s, d), stemmed=False))
    return t.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query
def review_severity(s, d):
    return review.score_reviews(I.reviews(s, d)).select(
        "review_id", "n_critical", "n_high", "n_medium", "n_low")


@query
def status(s, d):
    return K.status_report(I.events(s, d), I.tasks(s, d))


@query
def token_budget(s, d):
    tiers = context.context_tiers(I.events(s, d), I.tasks(s, d), by="git_repo")
    return context.token_budget(tiers, by="git_repo", limit=1000).select(
        "git_repo", "tier", "part", "pos", "tokens", "used", "band")


# --- windows -------------------------------------------------------------------

@query
def debounce(s, d):
    return capture.debounce(I.events(s, d), ["source"], BURST_MS).select(
        "id", "source", "timestamp")


@query
def diff_files(s, d):
    return review.diff_files(I.diffs(s, d)).select(
        "diff_id", "pos", "path", F.md5("block").alias("block_md5"))


@query
def feed_latest(s, d):
    return capture.feed_latest(I.events(s, d), ["source"]).select("source", "id", "pos")


@query
def task_newest(s, d):
    return cards.task_newest(I.events(s, d), 2).select("task_id", "id", "pos")


# --- top-k ---------------------------------------------------------------------

@query
def recent(s, d):
    return E.recent(I.events(s, d), E.EventFilter(source="TERM", since=SINCE)).select(
        "id", "timestamp", "label", "content")


@query
def recent_clamped(s, d):
    """A limit above the bound gives as many rows as the bound."""
    return E.recent(I.events(s, d), E.EventFilter(limit=5000)).select("id", "timestamp", "source")


@query
def task_lookup(s, d):
    return K.task_by_id(I.tasks(s, d), TASK).select("id", "name", "status", "started_at", "event_count")


@query
def notes_clamped(s, d):
    """A limit below the bound gives one row."""
    return E.notes(I.events(s, d), 0).select("id", "timestamp", "source")


@query
def recent_page2(s, d):
    return E.recent(I.events(s, d), E.EventFilter(limit=50, offset=50)).select("id", "timestamp")


@query
def notes_l3(s, d):
    return E.notes(I.events(s, d), 200).select("id", "timestamp", "source", "content")


@query
def active_task(s, d):
    return K.active_task(I.tasks(s, d)).select("id", "name", "started_at", "event_count")


@query
def sessions_completed(s, d):
    return K.completed_sessions(I.tasks(s, d), 20).select("id", "name", "stopped_at")


@query
def task_list(s, d):
    return K.task_list(I.tasks(s, d)).select("id", "status", "started_at")


@query
def latest_session(s, d):
    t = I.tasks(s, d)
    pick = lambda by: K.latest_session(t, by).select(F.lit(by).alias("picked_by"), "id")
    return pick("stopped_at").unionByName(pick("started_at"))


# --- context -------------------------------------------------------------------

@query
def context_tiers(s, d):
    t = context.context_tiers(I.events(s, d), I.tasks(s, d, True), flt=E.EventFilter(source="TERM"))
    return t.select("tier", "part", "pos", "id", "timestamp", "line")


@query
def context_tiers_by_repo(s, d):
    t = context.context_tiers(I.events(s, d), I.tasks(s, d), by="git_repo")
    return t.select("git_repo", "tier", "part", "pos", "id")


@query
def context_text(s, d):
    t = context.context_tiers(I.events(s, d), I.tasks(s, d), by="git_repo")
    return context.context_text(t, by="git_repo")


# --- text ----------------------------------------------------------------------

@query
def strip_ansi(s, d):
    doc = I.documents(s, d).withColumn("content", I.ansi(F.col("content")))
    return doc.select("id", F.md5(clean.strip_ansi(F.col("content"))).alias("text_md5"))


@query
def redact(s, d):
    doc = clean.with_scrubbed(I.secret_documents(s, d), "content", "masked")
    return doc.select("id", (F.col("masked") != F.col("content")).alias("was_redacted"),
                      F.md5("masked").alias("text_md5"))


@query
def truncate(s, d):
    r = I.documents(s, d).select("id", clean.truncation_result(F.col("content")).alias("r"))
    return r.select("id", F.md5("r.content").alias("text_md5"), "r.was_truncated", "r.original_len")


@query
def clean_events(s, d):
    doc = I.secret_documents(s, d).withColumn("content", I.ansi(F.col("content")))
    return clean.clean_events(doc).select(
        "id", "label", "was_redacted", F.octet_length("content").alias("n_bytes"),
        F.md5("content").alias("text_md5"))


@query
def source_codes(s, d):
    r = src.parse_requests(I.requests(s, d)).select("id", "source")
    code = text.source_code(F.col("source"))
    return r.select("id", "source", code.alias("code"), text.source_name(code).alias("name"),
                    text.source_badge(F.col("source")).alias("badge"))


@query
def preview_400(s, d):
    return I.documents(s, d).select("id", text.preview_context(F.col("content")).alias("preview"))


@query
def preview_200(s, d):
    return I.documents(s, d).select("id", text.preview_list(F.col("content")).alias("preview"))


@query
def doc_head(s, d):
    return I.documents(s, d).select(
        "id", F.md5(text.first_lines(F.col("content"), 20)).alias("open_md5"),
        F.md5(text.first_lines(F.col("content"), 30)).alias("save_md5"))


@query
def cursor_context(s, d):
    line = (F.col("doc_id") % 7).cast("int")
    return I.documents(s, d).select(
        "id", F.md5(text.cursor_context(F.col("content"), line)).alias("text_md5"))


@query
def selection_cap(s, d):
    line = (F.col("doc_id") % 7).cast("int")
    chosen = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("content"))
    return I.documents(s, d).select(
        "id", F.md5(text.selection_text(chosen, F.col("content"), line)).alias("text_md5"))


@query
def event_labels(s, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("open", "save", "selection", "focus")]),
                 (F.col("page_id") % 4).cast("int"))
    return I.page_paths(s, d).select("page_id", text.capture_label(
        kind, F.col("path"), F.col("page_id").cast("int")).alias("label"))


@query
def card_markdown(s, d):
    c = I.session_cards(s, d)
    return c.select("task_id", cards.card_markdown(cards.card_struct(c)).alias("markdown"))


@query
def event_markdown(s, d):
    doc = clean.clean_events(I.secret_documents(s, d))
    return text.event_markdown(doc).select("id", "markdown")


@query
def slugify(s, d):
    return I.documents(s, d).select("id", text.slugify(F.col("content")).alias("slug"))


@query
def strip_refs(s, d):
    return I.reviews(s, d).select("review_id", F.md5(text.strip_refs(F.col("text"))).alias("text_md5"))


@query
def strip_refs_all(s, d):
    """All patterns, those of a named product, its hosts, vendor and quoted line included."""
    patterns = text.reference_patterns(("AcmeWiki",), ("acmewiki.example", "helper.example"),
                                       ("Vendorix",), ("ask the deep index",))
    return I.referenced_reviews(s, d).select(
        "review_id", F.md5(text.strip_refs(F.col("text"), patterns)).alias("text_md5"))


# --- time and JSON -------------------------------------------------------------

def _durations(s, d):
    return I.tasks(s, d).select("id", times.task_duration(
        F.col("started_at"), F.col("stopped_at"), I.now()).alias("secs"))


@query
def task_duration(s, d):
    return _durations(s, d)


@query
def format_duration(s, d):
    return _durations(s, d).select(
        "id", times.format_duration(F.col("secs")).alias("long_form"),
        times.format_duration_short(F.col("secs")).alias("short_form"))


@query
def relative_time(s, d):
    at = F.lit("2024-01-30 23:58:00").cast("timestamp")
    return I.events(s, d).select(
        "id", times.relative_time(F.col("timestamp"), at).alias("age"),
        times.relative_time(F.col("timestamp"), at, feed=True).alias("feed_age"))


@query
def exit_codes(s, d):
    n = F.col("id").cast("bigint") % 7
    meta = (F.when(n == 0, F.lit('{"exit_code": "3"}')).when(n == 1, F.lit('{"run":{"exit_code": 5}}'))
            .when(n == 2, F.lit('{"exit_code": 4294967297}')).when(n == 3, F.lit(None).cast("string"))
            .when(n == 4, F.lit('{"exit_code": -2}')).otherwise(F.col("metadata")))
    return I.events(s, d).select("id", jsonio.exit_code(meta, F.col("content")).alias("exit_code"))


@query
def card_json(s, d):
    return cards.cards_json(I.session_cards(s, d))


@query
def task_summaries(s, d):
    out = cards.task_summaries(I.tasks(s, d, with_summary=True), I.events(s, d), I.now())
    return out.select("task_id", "status", "origin", F.col("card.goal").alias("goal"),
                      F.col("card.token_estimate").alias("token_estimate"), "raw")


# --- full text -----------------------------------------------------------------

@query
def fts_tokens(s, d):
    t = search.tokens(F.col("content"))
    return I.documents(s, d).select("id", t.alias("t")).select(
        "id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def fts_postings(s, d):
    p = search.postings(I.documents(s, d), stemmed=False)
    return p.select("term", "id", "n_tokens", "tf",
                    F.aggregate("places", F.lit(0).cast("bigint"),
                                lambda a, x: a + x["col"] * 1000000 + x["pos"]).alias("place_sum"))


@query
def fts_incremental(s, d):
    """Index one language, add the rest, then drop documents marked toxic."""
    doc = I.documents(s, d)
    first = search.build_index(doc.filter(F.col("lang") == "en"), stemmed=False)
    both = search.add_documents(first, doc, stemmed=False)
    toxic = I.table(s, d, "labels").filter(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("id"))
    return search.term_stats(search.remove_documents(both, toxic)).select("term", "df", "n_docs")


def _ranked(s, d, q):
    i = search.build_index(I.documents(s, d), stemmed=False)
    return search.rank(i, q).select("id", F.round("bm25_rank", 6).alias("bm25_rank"))


@query
def search_and(s, d):
    return _ranked(s, d, search.all_terms("the with", stemmed=False))


@query
def search_or(s, d):
    return _ranked(s, d, search.any_term("src1 est", stemmed=False))


@query
def search_phrase(s, d):
    return _ranked(s, d, search.phrase("of the", stemmed=False))


@query
def search_prefix(s, d):
    return _ranked(s, d, search.prefix("ther", stemmed=False))


@query
def search_blank(s, d):
    """A query without words finds nothing."""
    doc = I.documents(s, d)
    i = search.build_index(doc, stemmed=False)
    return search.search(doc, i, search.all_terms(" ,; ", stemmed=False)).select("id", "bm25_rank")


@query
def search_limited(s, d):
    """The caller's limit is clamped: 0 asks for one event."""
    doc = I.documents(s, d)
    i = search.build_index(doc, stemmed=False)
    return search.search(doc, i, search.all_terms("the with", stemmed=False), 0).select(
        "id", F.round("bm25_rank", 6).alias("bm25_rank"))


@query
def search_ranked(s, d):
    """Best 20 events of a two-word query, stemming off."""
    doc = I.documents(s, d)
    i = search.build_index(doc, stemmed=False)
    return search.search(doc, i, search.all_terms("the with", stemmed=False)).select(
        "id", "label", "timestamp", F.md5("content").alias("text_md5"),
        F.round("bm25_rank", 6).alias("bm25_rank"))


@query
def search_stemmed(s, d):
    doc = I.documents(s, d)
    return search.search(doc, search.build_index(doc), search.all_terms("thering with")).select(
        "id", "label", F.round("bm25_rank", 6).alias("bm25_rank"))


@query
def fts_vocabulary(s, d):
    """Each distinct word with its stem: Python sees the vocabulary once."""
    doc = I.documents(s, d).withColumn("doc", F.col("doc_id"))
    words = textstore.document_words(doc).select("word").distinct()
    return words.join(textstore.changed_words(words), "word", "left").select(
        "word", F.coalesce("stem", "word").alias("stem"))


def _snippets(s, d):
    doc = I.documents(s, d)
    return search.search_snippets(doc, search.build_index(doc), search.any_term("thering with"), 20)


@query
def search_snippets(s, d):
    return _snippets(s, d)


@query
def search_text(s, d):
    return search.search_text(_snippets(s, d), "thering with")


@query
def search_batch(s, d):
    i = search.build_index(I.documents(s, d), stemmed=False)
    hits = search.search_batch(i, I.query_table(s, d, search.tokens))
    return hits.select("query_id", "id", "pos", F.round("bm25_rank", 6).alias("bm25_rank"))


# --- review corpus -------------------------------------------------------------

@query
def diff_bounded(s, d):
    b = review.bounded_diff(I.diffs(s, d))
    return b.select("diff_id", F.array_join("kept_files", ",").alias("kept_files"),
                    F.md5("bounded_diff").alias("diff_md5"), "was_truncated", "notice")


@query
def review_status(s, d):
    return review.score_reviews(I.reviews(s, d)).select("review_id", "declared", "status")


@query
def review_comment(s, d):
    c = review.review_comment(review.score_reviews(I.reviews(s, d)), I.now())
    return c.select("review_id", F.md5("comment").alias("comment_md5"))


PROMPT = "Repo {repository} PR #{pr_number}\n{pr_description}\n<<<\n{unified_diff}\n>>>"


@query
def review_prompt(s, d):
    r = I.reviews(s, d)
    filled = review.render_prompt(F.lit(PROMPT), {
        "repository": F.lit("demo"), "pr_number": F.col("review_id").cast("string"),
        "pr_description": review.prompt_description(
            F.when(F.col("review_id") % 2 == 0, F.lit(" fix it ")).otherwise(F.lit(""))),
        "unified_diff": F.col("text")})
    return r.select("review_id", F.md5(filled).alias("prompt_md5"))


@query
def comment_upsert(s, d):
    old = I.comments(s, d, review.COMMENT_MARKER)
    new = old.select("pr_id").distinct()
    return review.upsert_comments(new, old).select("pr_id", "comment_id", "action")




# --- streams: the whole table drained through a file stream -----------------------

@query
def stream_ingest(s, d):
    base = work_dir(s, "stream-ingest")
    store = EventStore(f"{base}/store")
    requests = src.parse_requests(I.requests(s, d, stream=True))
    ingest.start_ingest(requests, store, f"{base}/checkpoint", drain=True).awaitTermination()
    return store.read(s).select("id", "timestamp", "source", "label", "content", "metadata",
                                "was_redacted", "git_repo", "task_id")


@query
def stream_tail(s, d):
    base = work_dir(s, "stream-tail")
    requests = src.parse_requests(I.requests(s, d, stream=True))
    ingest.start_tail(requests, f"{base}/out", f"{base}/checkpoint", drain=True).awaitTermination()
    return s.read.text(f"{base}/out").select(
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.source").alias("source"),
        F.get_json_object("value", "$.content").alias("content"))


@query
def stream_quarantine(s, d):
    base = work_dir(s, "stream-quarantine")
    requests = src.parse_requests(I.requests(s, d, stream=True))
    ingest.start_ingest(requests, EventStore(f"{base}/store"), f"{base}/checkpoint",
                        drain=True).awaitTermination()
    return s.read.parquet(f"{base}/store/quarantine").select("id", "source", "reason")


@query
def stream_counts(s, d):
    base = work_dir(s, "stream-counts")
    e = I.events(s, d, stream=True)
    state.start_counts(e, ["source"], f"{base}/out", f"{base}/checkpoint",
                       drain=True).awaitTermination()
    return state.counts(s, f"{base}/out", state.running_counts(e, "source").schema, ["source"])


@query
def stream_debounce(s, d):
    """Closed bursts, and those still open when the input ends."""
    base = work_dir(s, "stream-debounce")
    e = I.events(s, d, stream=True)
    state.start_debounce(e, ["source"], BURST_MS, 3_600_000, f"{base}/out", f"{base}/checkpoint",
                         drain=True).awaitTermination()
    closed = state.closed_bursts(s, f"{base}/out", e.schema)
    rest = state.flush_debounce(s, f"{base}/out", f"{base}/checkpoint", e, ["source"], BURST_MS)
    return closed.unionByName(rest.select(closed.columns)).select("id", "source", "timestamp")


@query
def stream_task_state(s, d):
    base = work_dir(s, "stream-tasks")
    state.start_lifecycle(I.actions(s, d, stream=True), f"{base}/out", f"{base}/checkpoint",
                          drain=True).awaitTermination()
    return state.lifecycle(s, f"{base}/out")


# --- the stores: written, kept up and read back ------------------------------------

@query
def store_ingest(s, d):
    """History and then every event, some offered twice, into a store; parts merged."""
    store = EventStore(work_dir(s, "store-ingest"))
    store.append(I.stored_history(s, d), "history")
    offered = I.offered_batch(s, d)
    for part in ("offered", "offered again"):
        store.append(offered, part, order=("copy",))
    store.compact(s, 2)
    return store.read(s).select("id", "timestamp", "source", "label")


@query
def store_prune(s, d):
    """Retention on the store, then the expired events offered again with the kept ones."""
    store = EventStore(work_dir(s, "store-prune"))
    store.append(I.events(s, d), "all")
    store.prune(s, I.now(), PRUNE_DAYS)
    return store.read(s).select("id", "timestamp", "source")


def _stored_documents(s, d):
    """(events by day, their index) of all documents, words unstemmed."""
    base = work_dir(s, "stored-documents")
    store, index = EventStore(f"{base}/events"), TextStore(f"{base}/index")
    store.append(I.document_events(s, d), "documents")
    index.add(store.read(s), "documents", stemmed=False)
    return store.read(s), index.load(s)


@query
def search_saved(s, d):
    """As ``search_ranked``, from a stored index and a store by day."""
    doc, index = _stored_documents(s, d)
    return textstore.search(doc, index, search.all_terms("the with", stemmed=False)).select(
        "id", "label", "timestamp", F.md5("content").alias("text_md5"),
        F.round("bm25_rank", 6).alias("bm25_rank"))


@query
def fts_saved(s, d):
    """As ``fts_incremental``, on a stored index: added, removed and merged."""
    doc, store = I.documents(s, d, spread=False), TextStore(work_dir(s, "fts-saved"))
    store.add(doc.filter(F.col("lang") == "en"), "english", stemmed=False)
    store.add(doc, "all", stemmed=False)
    toxic = I.table(s, d, "labels").filter(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("id"))
    store.remove(doc.join(toxic, "id", "left_semi"), "toxic", stemmed=False)
    store.merge(s, 3)
    return textstore.term_stats(store.load(s)).select("term", "df", "n_docs")
