"""Structured Streaming: stream = batch on keys (O-T1, O-T2, O-T4)."""

from pyspark.sql import functions as F

from jobsift.functions import text as T
from jobsift.operators import dedup
from jobsift.streaming import stream as ST


DOCS = "/root/testdata/sf0.001/documents.parquet"


def documents(spark, files=4):
    """The documents and a folder that holds them in several files."""
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang", "source")
    path = ST.shared_path(spark, "landing")
    docs.repartition(files).write.parquet(path)
    return docs, path


def test_stream_dedup_equals_batch_keys(spark):
    docs, path = documents(spark)
    streamed = {r.fp for r in ST.stream_dedup_documents(spark, path, docs.schema, max_files=1).collect()}
    batch = {r.fp for r in docs.select(dedup.description_key(T.py_strip(T.nz(F.col("text"))), F.col("source")).alias("fp")).distinct().collect()}
    assert streamed == batch and len(streamed) > 0


def test_stream_upgrade(spark):
    docs, path = documents(spark)
    got = {r.url: r.capture_no for r in ST.stream_upgrade_documents(spark, path, docs.schema, max_files=1).collect()}
    want = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        n = len(r.text or "")
        if r.source not in want or n > want[r.source][0]:
            want[r.source] = (n, r.doc_id)
    assert got == {k: v[1] for k, v in want.items()}


def test_page_stream_extracts(spark):
    """O-T1: a stream of pages goes through the same shredder and extractor Columns."""
    from jobsift.operators import extract_generic as G
    from jobsift.operators.jobs import explode_jobs
    from jobsift.sources import listings as L

    pages = L.mixed_pages(spark, "/root/testdata/sf0.001")
    landing = ST.shared_path(spark, "landing-pages")
    pages.repartition(3).write.parquet(landing)
    nodes = ST.stream_nodes(ST.read_page_stream(spark, landing, max_files=1))
    jobs = explode_jobs(nodes, G.generic_jobs(G.heuristic_items(F.col("buf"), F.col("nodes"))))
    streamed = ST.drain_append(jobs.select("page_id", "pos", "company"), "t_page_stream").count()
    batch = explode_jobs(ST.stream_nodes(pages), G.generic_jobs(G.heuristic_items(F.col("buf"), F.col("nodes")))).count()
    assert streamed == batch > 0


def test_running_status_over_several_batches_and_a_restart(spark):
    """O-T3: running counts per language; a second run goes on from the state of the first."""
    docs, path = documents(spark)
    checkpoint, out = ST.shared_path(spark, "ckpt"), ST.shared_path(spark, "out")
    status = lambda: ST.drain_upsert(
        ST.running_status(ST.table_stream(spark, path, docs.schema, 1), "lang"), ["lang"], "t_status", checkpoint, out)
    want = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert {r.lang: r.n for r in status().collect()} == want
    docs.write.mode("append").parquet(path)
    assert {r.lang: r.n for r in status().collect()} == {k: 2 * v for k, v in want.items()}


def test_cross_run_seen_table(spark):
    """O-D4 across runs: keys written after run 1 remove rows of run 2."""
    run1 = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "page_id long, pos int, fp string")
    run2 = spark.createDataFrame([(2, 1, "b"), (2, 2, "c"), (2, 3, "c")], "page_id long, pos int, fp string")
    seen = dedup.seen_rows(dedup.first_per_key(run1, "fp", ["page_id", "pos"]), "fp", "page_id", "run-1")
    kept = dedup.cross_run(run2, seen.withColumnRenamed("fingerprint", "fp"), "fp", ["page_id", "pos"])
    assert sorted((r.page_id, r.pos) for r in kept.collect()) == [(2, 2)]
