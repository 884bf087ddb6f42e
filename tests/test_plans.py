"""Physical-plan checks."""

from pyspark.sql import functions as F

import __spark_entry__ as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_uses_window_group_limit(spark):
    df = E.queries()["dedup_description"](spark, "/root/testdata/sf0.001")
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_parquet_pruning_and_single_python_step(spark):
    df = E.queries()["page_headings"](spark, "/root/testdata/sf0.001")
    p = plan(df)
    assert p.count("MapInArrow") == 1
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in p


def test_extraction_stays_in_jvm(spark):
    df = E.queries()["extract_indeed"](spark, "/root/testdata/sf0.001")
    p = plan(df)
    assert p.count("MapInArrow") == 1 and "EvalPython" not in p


def test_text_queries_no_python(spark):
    for name in ["clean_text", "bullets_base", "fingerprint", "smart_trim", "skills_tag"]:
        p = plan(E.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "EvalPython" not in p and "MapInArrow" not in p, name
        assert "ReadSchema" in p


def test_built_pages_are_dealt_over_the_cluster(spark):
    """The tables that pages are built from are one small file each: one task without dealing."""
    from jobsift.session import SCAN_PARTITIONS
    from jobsift.sources import listings as L

    sf = "/root/testdata/sf0.001"
    before = spark.conf.get(SCAN_PARTITIONS)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        pages = [L.naukri_job_pages(spark, sf), L.single_job_pages(spark, sf, "LinkedIn"), L.framed_pages(spark, sf), L.mixed_pages(spark, sf), L.naukri_pages(spark, sf)]
        for p in pages:
            assert p.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
            assert p.count() == p.select("page_id").distinct().count() > 0
    finally:
        spark.conf.set(SCAN_PARTITIONS, before)
