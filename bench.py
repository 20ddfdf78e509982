"""Headline timings: one warm-up, then the median of three runs per query, of one if it takes over LONG s.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worktrail.operators import search  # noqa: E402
from worktrail.plans import inputs as I  # noqa: E402
from worktrail.plans.catalog import QUERIES  # noqa: E402
from worktrail.session import local_session, work_dir  # noqa: E402
from worktrail.sources import events as src  # noqa: E402
from worktrail.sources import textstore  # noqa: E402
from worktrail.sources.store import EventStore  # noqa: E402
from worktrail.sources.textstore import TextStore  # noqa: E402
from worktrail.streaming import ingest  # noqa: E402

RUNS, LONG = 3, 3.0
HEADLINE = ["clean_events", "redact", "truncate", "fts_postings", "session_cards",
            "commands_verified", "files_touched", "ingest_dedup", "prune", "debounce",
            "recent", "context_tiers", "task_state", "diff_bounded", "review_status"]


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs=RUNS):
    fn()
    spent = []
    for _ in range(runs):
        start = time.perf_counter()
        fn()
        spent.append(time.perf_counter() - start)
        if spent[0] > LONG:
            break
    return round(statistics.median(spent), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    out, rates = {}, {}

    for name in HEADLINE:
        out[name] = timed(lambda: drain(QUERIES[name](spark, sf_dir)))

    docs = I.documents(spark, sf_dir)
    base = work_dir(spark, "bench")
    kept = EventStore(f"{base}/documents")
    kept.append(I.document_events(spark, sf_dir), "documents")
    stored = kept.read(spark)
    built = []

    def build():
        built.append(TextStore(f"{base}/index{len(built)}"))
        built[-1].add(docs, "documents", fresh=True)

    out["index_build"] = timed(build, 1)
    index = built[-1].load(spark)
    query = search.all_terms("thering with")
    out["search_saved"] = timed(lambda: drain(textstore.search(stored, index, query)))
    out["snippets_saved"] = timed(lambda: drain(textstore.search_snippets(stored, index, query)))
    plain = index.as_index()
    asked = I.query_table(spark, sf_dir, search.tokens).withColumn(
        "terms", search.stem_all("terms"))
    out["search_batch"] = timed(lambda: drain(search.search_batch(plain, asked)))

    requests = src.parse_requests(I.requests(spark, sf_dir))
    requests.repartition(20).write.parquet(f"{base}/requests")
    start = time.perf_counter()
    stream = src.stream_requests(spark, f"{base}/requests", "parquet")
    ingest.start_ingest(stream, EventStore(f"{base}/store"), f"{base}/cp", drain=True).awaitTermination()
    out["stream_ingest"] = round(time.perf_counter() - start, 3)

    # Streams write stores and state tables: the whole table once each.
    for name in ("stream_debounce", "stream_task_state", "stream_counts"):
        start = time.perf_counter()
        drain(QUERIES[name](spark, sf_dir))
        out[name] = round(time.perf_counter() - start, 3)

    # Eight micro-batches with the index on: the last one should cost as much as the first.
    requests.repartition(8).write.parquet(f"{base}/requests8")
    start = time.perf_counter()
    stream = src.stream_requests(spark, f"{base}/requests8", "parquet", max_files=1)
    query = ingest.start_ingest(stream, EventStore(f"{base}/store8"), f"{base}/cp8",
                                f"{base}/index8", drain=True)
    query.awaitTermination()
    out["stream_ingest_8_batches"] = round(time.perf_counter() - start, 3)
    batches = [p["batchDuration"] / 1000 for p in query.recentProgress if p["numInputRows"]]
    rates["ingest_first_batch_s"], rates["ingest_last_batch_s"] = batches[0], batches[-1]

    n_events = I.table(spark, sf_dir, "events").count()
    text = I.table(spark, sf_dir, "documents").selectExpr("sum(octet_length(text))").first()[0]
    rates["clean_events_mb_per_s"] = round(text / 1e6 / out["clean_events"], 2)
    rates["search_batch_queries_per_s"] = round(asked.count() / out["search_batch"], 1)
    rates["session_cards_tasks_per_s"] = round(
        I.tasks(spark, sf_dir).count() / out["session_cards"], 1)
    for name in ("ingest_dedup", "prune", "stream_ingest"):
        rates[f"{name}_rows_per_s"] = round(n_events / out[name], 1)
    rates["index_build_tokens_per_s"] = round(
        index.n_tokens / out["index_build"], 1)

    print(json.dumps({
        "metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec",
        "queries": out, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")),
        "spark": spark.version, "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
