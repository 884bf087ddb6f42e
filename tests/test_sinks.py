"""Projections and sinks (F6, F21, F22): files are written by Spark and read back."""

import os
import tempfile

from pyspark.sql import functions as F

from jobsift.operators import report as R
from jobsift.operators import sinks as K

JOB_DDL = ("page_id long, pos int, company string, job_role string, description string, description_bullets array<string>, "
           "skills array<string>, location string, experience string, education string, employment_type string, department string, "
           "industry string, source string, link string")


def jobs(spark, rows):
    full = []
    for r in rows:
        d = dict(page_id=1, pos=1, company="", job_role="", description="", description_bullets=[], skills=[], location="",
                 experience="", education="", employment_type="", department="", industry="", source="", link="")
        d.update(r)
        full.append(d)
    return spark.createDataFrame(full, JOB_DDL)


def test_sheet_f6(spark):
    df = jobs(spark, [
        dict(pos=1, company="Google", job_role="Software Engineer", description="We build", description_bullets=["a", "b", "c"], source="Indeed"),
        dict(pos=2, company="Meta", job_role="ML Engineer", description="python and docker", source="LinkedIn"),
    ])
    rows = K.sheet(df).orderBy("s_no").collect()
    assert [r.s_no for r in rows] == [1, 2]
    assert rows[0].job_description == "• a\n• b\n• c" and rows[0].location == "N/A"
    assert rows[1].job_description == "• python and docker" and rows[1].key_skills == "• Python\n• Docker"
    assert len(K.SHEET_COLS) == 8


def test_serial_number_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("page_id"), (F.col("id") / 97).cast("int").alias("pos")).repartition(13)
    out = R.serial_number(df, ["page_id", "pos"]).collect()
    got = sorted((r.page_id, r.pos, r.s_no) for r in out)
    assert [s for *_, s in got] == list(range(1, 5001))


def test_serial_number_keeps_wide_rows(spark):
    """Adaptive execution coalesces partitions; rows, numbers and order stay whole."""
    n = 300_000
    df = spark.range(n).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.repeat(F.lit("x"), 300).alias("more"))
    out = R.serial_number(df.repartition(16), ["id"])
    got = out.agg(F.count("*"), F.count_distinct("s_no"), F.min("s_no"), F.max("s_no"), F.count_if(F.col("s_no") != F.col("id") + 1)).first()
    assert tuple(got) == (n, n, 1, n, 0)


def test_no_local_folder_on_a_cluster():
    from jobsift.session import is_local

    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[3,2,3000]") and not is_local("yarn") and not is_local("spark://host:7077")


def test_json_last_wins_f21(spark):
    df = jobs(spark, [
        dict(pos=1, company="Acme Inc", job_role="Dev", description="first"),
        dict(pos=2, company="acme inc", job_role="dev", description="x" * 221),
        dict(pos=3, company="", job_role="", description="", description_bullets=["b1", "b2"]),
    ])
    docs = {r.id: r for r in K.json_docs(df).collect()}
    assert set(docs) == {"scraped-acme_inc-dev", "scraped-scraped-job"}
    d = docs["scraped-acme_inc-dev"]
    assert d.fullDescription == "x" * 221 and d.descriptionSnippet == "x" * 220 + "..."
    e = docs["scraped-scraped-job"]
    assert (e.company, e.title, e.fullDescription, e.url) == ("Featured Organization", "Software Engineer", "b1\nb2", "#")
    engine = {r.id: r for r in K.json_docs(df, variant="engine").collect()}
    assert list(engine["scraped-naukri-software_developer"].requiredSkills) == ["React", "TypeScript", "Python"]


def test_csv_round_trip_f22(spark):
    df = jobs(spark, [dict(pos=1, company='Acme, "Inc"', job_role="Dev\nOps", description="line1\r\nline2", source="")])
    path = os.path.join(tempfile.mkdtemp(prefix="jobsift-csv-"), "out")
    rows = K.csv_rows(df)
    K.write_csv(rows, path)
    back = K.read_csv(spark, path).collect()
    assert len(back) == 1
    b = back[0].asDict()
    assert b["Company Name"] == 'Acme, "Inc"' and b["Job Role"] == "Dev\nOps" and b["Source"] == "Extension"
    assert b["Job Description (Bullet Points)"] == "line1\r\nline2"


def test_summary_and_preview(spark):
    df = jobs(spark, [dict(pos=i, company=f"C{i % 3}", job_role=f"R{i % 2}", source=s) for i, s in enumerate(["A", "B", "A", "B"] * 4)])
    s = R.summary(df).first()
    assert (s.total_entries, s.companies, s.job_roles, s.sources) == (16, 3, 2, "A, B")
    assert [r.pos for r in R.preview(df, 3).collect()] == [0, 1, 2]


def test_output_name_and_fanout(spark):
    """O-S20 name, O-K4 fan-out: one checkpointed input, sheet CSV + JSON documents written and read back."""
    import re as _re

    from jobsift.functions import text as T

    name = spark.range(1).select(T.output_name(F.lit("Indeed, Naukri!")).alias("n")).first().n
    assert _re.fullmatch(r"jobs_Indeed Naukri_\d{8}_\d{6}", name)
    df = jobs(spark, [dict(pos=i, company=f"Co{i}", job_role="Dev", description=f"desc {i}", source="Generic") for i in range(1, 4)])
    root = tempfile.mkdtemp(prefix="jobsift-export-")
    out = K.export(df, os.path.join(root, "sheet"), os.path.join(root, "json"))
    assert out["rows"] == 3
    sheet = K.read_csv(spark, os.path.join(root, "sheet")).orderBy(F.col("`S.No`").cast("int")).collect()
    assert [r["Company Name"] for r in sheet] == ["Co1", "Co2", "Co3"]
    docs = spark.read.json(os.path.join(root, "json"))
    assert docs.count() == 3 and "requiredSkills" in docs.columns


def test_more_count_distinct_urls_and_parquet(spark):
    """O-L1 "n more", O-D5 first row per url across pages, Parquet sink read-back."""
    from jobsift.operators import dedup

    df = jobs(spark, [dict(pos=i, company=f"C{i}") for i in range(13)])
    assert R.more_count(df).first().more == 3
    links = spark.createDataFrame([(2, 1, "u1"), (1, 5, "u1"), (1, 6, "u2")], "page_id long, pos int, url string")
    assert sorted((r.page_id, r.pos, r.url) for r in dedup.distinct_urls(links, ["page_id", "pos"]).collect()) == [(1, 5, "u1"), (1, 6, "u2")]
    path = os.path.join(tempfile.mkdtemp(prefix="jobsift-pq-"), "jobs")
    K.write_parquet(df, path)
    assert spark.read.parquet(path).count() == 13
