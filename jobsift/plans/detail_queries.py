"""Registered queries of single-job pages, page text without furniture, description choice and export details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sql import register_sql_functions
from ..operators import extract_extension as E
from ..operators import sinks as K
from ..operators.jobs import flat
from ..session import read_table
from ..sources import listings as L
from ..sources.pages import shred_pages
from .extract_queries import site_jobs
from .text_queries import _docs, trim_input

SINGLE_COLS = ["page_id", "pos", "company", "job_role", "description", "description_bullets", "source"]


def q_indeed_single(spark, sf_dir):
    """O-X8: an Indeed job page per part; a page with nothing to read has no row."""
    return flat(site_jobs(L.single_job_pages(spark, sf_dir, "Indeed"), "Indeed"), SINGLE_COLS)


def q_linkedin_single(spark, sf_dir):
    """O-X10."""
    return flat(site_jobs(L.single_job_pages(spark, sf_dir, "LinkedIn"), "LinkedIn"), SINGLE_COLS)


def q_page_body_text(spark, sf_dir):
    """O-H11: the text of the main area and of the body, without the furniture's subtrees."""
    nodes = shred_pages(L.framed_pages(spark, sf_dir))
    body = E.S.select_one(F.col("nodes"), "body")
    return nodes.select(
        "page_id", F.expr(E.stripped_inner_text_sql(E.MAIN_AREA, E.BOILER)).alias("main_text"),
        E.stripped_inner_text(F.col("buf"), F.col("nodes"), body, E.BODY_BOILER).alias("body_text"),
    )


def q_description_choice(spark, sf_dir):
    """O-S11 on every document: by its length the CSS text is missing, short, half or the whole of the text,
    the fallback the page-like text or (by language) a few words."""
    n = F.length(T.nz("text"))
    css = F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.substring("text", 1, 40)).when(n % 4 == 2, F.col("text").substr(F.lit(1), (n / 2).cast("int"))).otherwise(F.col("text"))
    fallback = F.when(F.col("lang") == "de", F.substring("text", 1, 20)).otherwise(trim_input())
    return _docs(spark, sf_dir).select("doc_id", T.choose_description(css, fallback).alias("description"))


def q_skills_split(spark, sf_dir):
    """O-S15: a text at its commas."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.split_skills("text"), "|").alias("skills"), F.size(T.split_skills("text")).alias("n"))


def skill_text_jobs(spark, sf_dir):
    """Jobs that carry their skills as one string (or none, or commas only)."""
    skills = F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 == 1, F.lit(" , ,")).otherwise(
        F.concat(F.lower(F.col("p_type")), F.lit(",  "), F.col("p_brand"), F.lit(" ,,size "), F.col("p_size").cast("string")))
    return L.job_rows(spark, sf_dir).select(
        F.col("job_id").cast("bigint").alias("page_id"), F.lit(1).alias("pos"), "company", F.col("role").alias("job_role"), L.description().alias("description"),
        F.array().cast("array<string>").alias("description_bullets"), skills.alias("skills"), F.col("nation").alias("location"), F.lit("").alias("experience"),
        F.lit("Generic").alias("source"),
    )


def q_export_skills_text(spark, sf_dir):
    """O-S15 in the sheets: both variants' skills cells from one string per job."""
    jobs = K.listed(skill_text_jobs(spark, sf_dir))
    cell = lambda variant: next(c for c in K.sheet_row(variant) if c._jc.toString().endswith("AS key_skills"))
    return jobs.select("page_id", cell("sheet").alias("sheet_skills"), cell("engine").alias("engine_skills"))


def q_csv_fields(spark, sf_dir):
    """O-S19 on every document's text and source."""
    return _docs(spark, sf_dir).select("doc_id", T.csv_escape("text").alias("text_field"), T.csv_escape("source").alias("source_field"))


def q_output_names(spark, sf_dir):
    """O-S20: per nation the file name of a run over its region's sources that ended with its last order."""
    read = lambda t: read_table(spark, sf_dir, t)
    last = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("o_orderdate").alias("at"))
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(last, "n_nationkey")
    sources = F.when(F.col("n_nationkey") == 0, F.lit(" ,;")).otherwise(F.concat("r_name", F.lit(", "), "n_name", F.lit("/x-y")))
    return places.select("n_nationkey", T.output_name(sources, F.col("at")).alias("name"))


def q_export_report(spark, sf_dir):
    """O-K3: per nation the jobs with the largest sizes; a nation without one writes no file."""
    jobs = L.job_rows(spark, sf_dir).where("p_size >= 49").withColumnRenamed("nation", "source")
    asked = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"))
    return K.export_report(jobs, asked)


def q_sql_text_functions(spark, sf_dir):
    """O-E4: bullets, skills, company test, location, experience and CSV fields from SQL."""
    register_sql_functions(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("jobsift_documents")
    return spark.sql(
        "SELECT doc_id, array_join(jobsift_bullets(text), '|') AS bullets, array_join(jobsift_engine_bullets(text), '|') AS engine_bullets, "
        "array_join(jobsift_extension_bullets(text), '|') AS extension_bullets, array_join(jobsift_skills(text), '|') AS skills, "
        "jobsift_looks_like_company(jobsift_clean_text(text)) AS is_company, jobsift_location(text) AS location, jobsift_experience(text) AS experience, "
        "array_join(jobsift_split_skills(text), '|') AS split_skills, jobsift_csv_field(text) AS csv_field, jobsift_url_domain_is(concat('https://www.', source, '.naukri.com/j'), 'naukri.com') AS is_naukri "
        "FROM jobsift_documents"
    )
