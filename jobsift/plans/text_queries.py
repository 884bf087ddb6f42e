"""Registered queries over ``documents`` / ``supplier`` / ``part`` (text operators, dedup).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables.  The matching DuckDB SQL lives in :mod:`.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup
from ..session import read_table
from ..sources.pages import spread


def _docs(spark, sf_dir) -> DataFrame:
    """Documents, column-pruned; few large splits are spread over the cores (regex work is CPU-bound)."""
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _explode(df: DataFrame, key: str, arr, name: str) -> DataFrame:
    return df.select(key, F.posexplode(arr).alias("pos", name)).select(key, (F.col("pos") + 1).cast("int").alias("pos"), name)


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean_text("text").alias("clean"))


def q_bullets_base(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), "doc_id", T.bullets_base("text"), "bullet")


def q_bullets_engine(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), "doc_id", T.bullets_engine("text"), "bullet")


def q_bullets_ext(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), "doc_id", T.bullets_ext("text"), "bullet")


def q_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fingerprint("text").alias("fp"))


def q_dedup_description(spark, sf_dir):
    """O-D2 over documents: description = stripped text, company = source."""
    d = _docs(spark, sf_dir).select(
        "doc_id", T.py_strip(T.nz("text")).alias("description"), F.col("source").alias("company")
    )
    keyed = d.withColumn("fp", dedup.description_key("description", "company"))
    return dedup.first_per_key(keyed, "fp", ["doc_id"]).select("doc_id", "fp")


def _primary_supplier_jobs(spark, sf_dir) -> DataFrame:
    """Job-like rows from the TPC-H rule *primary supplier of part p = p mod S + 1*."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n_supp = supp.select(F.count("*")).scalar()  # scalar subquery, evaluated once
    keyed = part.select("p_partkey", "p_type", (F.col("p_partkey") % n_supp + 1).alias("s_suppkey"))
    return keyed.join(supp, "s_suppkey").select(
        F.col("p_partkey").alias("job_id"), F.col("s_name").alias("company"), F.col("p_type").alias("job_role")
    )


def q_dedup_role_company(spark, sf_dir):
    """O-D1: key = fingerprint(job_role + company), first job wins."""
    jobs = _primary_supplier_jobs(spark, sf_dir).withColumn("fp", dedup.role_company_key("job_role", "company"))
    return dedup.first_per_key(jobs, "fp", ["job_id"]).select("job_id", "company", "job_role")


def q_dedup_triple(spark, sf_dir):
    """O-D3: exact ``company|role|description[:100]`` (company = source, role = lang)."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("company"), F.col("lang").alias("job_role"), T.nz("text").alias("description"))
    keyed = d.withColumn("k", dedup.triple_key("company", "job_role", "description"))
    return dedup.first_per_key(keyed, "k", ["doc_id"]).select("doc_id")


def q_dedup_cross_run(spark, sf_dir):
    """O-D4: the earlier run (sources sorting before 'src5') is the seen table;
    the later run keeps rows whose description fingerprint is new, first one per key."""
    d = _docs(spark, sf_dir).select("doc_id", "source", T.py_strip(T.nz("text")).alias("description"))
    d = d.withColumn("fp", dedup.description_key("description", "source"))
    seen = d.where(F.col("source") < "src5").select("fp")
    new = d.where(F.col("source") >= "src5")
    return dedup.cross_run(new, seen, "fp", ["doc_id"]).select("doc_id", "fp")


def q_skills_tag(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.skills_tag("text"), "|").alias("skills"))


def q_looks_like_company(spark, sf_dir):
    """O-S9 on supplier names and on every line of every document."""
    s = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("probe"))
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    d = lines.select(F.concat_ws(".", F.concat(F.lit("d"), F.col("doc_id").cast("string")), (F.col("i") + 1).cast("string")).alias("id"), T.clean_text("line").alias("probe"))
    u = s.unionByName(d)
    return u.select("id", "probe", T.looks_like_company("probe").alias("is_company"))


def q_location_lookup(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.location_lookup("text").alias("location"))


def q_experience(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.experience("text").alias("experience"))


def trim_input(text_col="text", source_col="source", lang_col="lang"):
    """Page-like text with a header, a start marker and an end marker around the document."""
    return F.concat(
        F.lit("Header "), F.col(source_col), F.lit("\nJob Description: "), T.nz(text_col),
        F.lit("\nSimilar Jobs\n"), F.col(lang_col),
    )


def q_smart_trim(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.smart_trim(trim_input()).alias("trimmed"), T.smart_trim("text").alias("trimmed_raw"))


def labelled_input():
    return F.concat(
        F.lit("Employment Type: "), F.col("source"), F.lit("\nDepartment: "), F.col("lang"),
        F.lit(" • x\n"), T.nz("text"), F.lit("\nIndustry Type: "), F.upper(F.col("lang")),
    )


def q_labelled_fields(spark, sf_dir):
    t = labelled_input()
    return _docs(spark, sf_dir).select(
        "doc_id", T.employment_type(t).alias("employment_type"), T.department(t).alias("department"), T.industry(t).alias("industry")
    )


def q_slug_snippet(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select(
        "doc_id",
        T.slug("source", "scraped").alias("company_slug"),
        T.slug("text", "job").alias("role_slug"),
        T.snippet("text").alias("snippet"),
    )


def q_sql_functions(spark, sf_dir):
    """O-E4: the scalar rules called from SQL through registered SQL UDFs."""
    from ..functions.sql import register_sql_functions

    register_sql_functions(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("jobsift_documents")
    return spark.sql(
        "SELECT doc_id, jobsift_clean_text(text) AS clean, jobsift_fingerprint(text) AS fp, "
        "jobsift_slug(source, 'scraped') AS company_slug, jobsift_snippet(text) AS snippet, "
        "jobsift_detect_source(concat('https://www.', source, '.naukri.com/jobs')) AS src FROM jobsift_documents"
    )
