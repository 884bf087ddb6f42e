"""Presentation projections and sinks (O-P1, O-P1b, O-P2, O-K1 … O-K4, O-S13 … O-S22).

Projections are plain ``select``s; the sinks are Spark writers (CSV with
RFC-4180 quoting, JSON lines, Parquet), never a per-row file loop on the
driver.  Header names of the reference's sheets are applied at write time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..session import store
from .report import serial_number

SHEET_HEADERS = [
    "S.No", "Company Name", "Job Role", "Job Description (Bullet Points)", "Key Skills (Bullet Points)",
    "Location", "Experience", "Source",
]
ENGINE_SHEET_HEADERS = [
    "S.No", "Company Name", "Job Role", "Job Description", "Key Skills (Bullet Points)", "Location", "Experience", "Source",
]
CSV_HEADERS = [
    "S.No", "Company Name", "Job Role", "Job Description (Bullet Points)", "Key Skills",
    "Education", "Employment Type", "Department", "Industry", "Source",
]
SHEET_COLS = ["s_no", "company_name", "job_role", "job_description", "key_skills", "location", "experience", "source"]
CSV_COLS = ["s_no", "company_name", "job_role", "job_description", "key_skills", "education", "employment_type", "department", "industry", "source"]


def _skill_lines(skills: Column) -> Column:
    kept = F.filter(F.transform(skills, T.py_strip), lambda s: s != "")
    return T.bullet_lines(kept)


def listed(jobs: DataFrame) -> DataFrame:
    """O-S15: skills as a list, also where the jobs carry one comma-separated string."""
    text = jobs.schema["skills"].dataType.typeName() in ("string", "varchar", "char")
    return jobs.withColumn("skills", T.skills_list("skills", text))


def sheet_row(variant: str = "sheet") -> list[Column]:
    """O-P1 (``sheet``) / O-P1b (``engine``) cell expressions, without S.No."""
    d, b, sk = T.nz(F.col("description")), F.col("description_bullets"), F.col("skills")
    if variant == "sheet":
        desc = F.when(F.size(b) > 0, T.bullet_lines(b)).when(d != "", F.concat(F.lit("• "), d)).otherwise(F.lit("No description available"))
        skills = (
            F.when(F.size(sk) > 0, _skill_lines(sk))
            .when(d != "", T.bullet_lines(T.skills_tag(d)))
            .otherwise(F.lit("• N/A"))
        )
        loc = T.default_if_empty(T.nz(F.col("location")), "N/A")
        exp = T.default_if_empty(T.nz(F.col("experience")), "N/A")
        src = T.nz(F.col("source"))
    elif variant == "engine":
        desc = F.when(F.size(b) > 0, T.bullet_lines(b)).otherwise(d)
        skills = F.when(F.size(sk) > 0, _skill_lines(sk)).otherwise(F.lit("• N/A"))
        loc, exp = T.nz(F.col("location")), T.nz(F.col("experience"))
        src = T.default_if_empty(T.nz(F.col("source")), "Naukri")
    else:
        raise ValueError(variant)
    return [
        T.nz(F.col("company")).alias("company_name"), T.nz(F.col("job_role")).alias("job_role"), desc.alias("job_description"),
        skills.alias("key_skills"), loc.alias("location"), exp.alias("experience"), src.alias("source"),
    ]


def sheet(jobs: DataFrame, order=("page_id", "pos"), variant: str = "sheet") -> DataFrame:
    """O-P1 / O-P1b + O-W1: the 8-column sheet with serial numbers in run order."""
    rows = listed(jobs).select(*order, *sheet_row(variant))
    return serial_number(rows, list(order)).select(*SHEET_COLS, *order)


def csv_rows(jobs: DataFrame, order=("page_id", "pos")) -> DataFrame:
    """O-P2: the extension's 10-column CSV rows."""
    d, b, sk = T.nz(F.col("description")), F.col("description_bullets"), F.col("skills")
    rows = listed(jobs).select(
        *order,
        T.nz(F.col("company")).alias("company_name"), T.nz(F.col("job_role")).alias("job_role"),
        F.when(F.size(b) > 0, T.bullet_lines(b)).otherwise(d).alias("job_description"),
        F.when(F.size(sk) > 0, T.bullet_lines(F.transform(sk, F.trim))).otherwise(F.lit("")).alias("key_skills"),
        T.nz(F.col("education")).alias("education"), T.nz(F.col("employment_type")).alias("employment_type"),
        T.nz(F.col("department")).alias("department"), T.nz(F.col("industry")).alias("industry"),
        T.default_if_empty(T.nz(F.col("source")), "Extension").alias("source"),
    )
    return serial_number(rows, list(order)).select(*CSV_COLS, *order)


def json_docs(jobs: DataFrame, variant: str = "sheet", order=("page_id", "pos")) -> DataFrame:
    """O-K1 (``sheet``) / O-K2 (``engine``): one JSON document per id, the *last* job per id wins
    (later files overwrite earlier ones with the same name)."""
    company, role = T.nz(F.col("company")), T.nz(F.col("job_role"))
    if variant == "engine":
        company = T.default_if_empty(company, K.JSON_ENGINE_COMPANY)
        role = T.default_if_empty(role, K.JSON_ENGINE_ROLE)
    c_slug, r_slug = T.slug(company, "scraped"), T.slug(role, "job")
    desc = T.export_description(F.col("description"), F.col("description_bullets"), role, company)
    if variant == "sheet":
        skills = F.when(F.size(F.col("skills")) > 0, F.col("skills")).otherwise(T.skills_tag(desc))
        out_company = T.default_if_empty(company, K.JSON_SHEET_COMPANY)
        out_role = T.default_if_empty(role, K.JSON_SHEET_ROLE)
        url = F.lit(K.JSON_URL)
    else:
        skills = F.when(F.size(F.col("skills")) > 0, F.col("skills")).otherwise(T.lit_array(K.SKILLS_DEFAULT_ENGINE))
        out_company, out_role = company, role
        url = T.default_if_empty(T.nz(F.col("link")), K.JSON_URL)
    docs = listed(jobs).select(
        *order,
        F.concat(F.lit("scraped-"), c_slug, F.lit("-"), r_slug).alias("id"),
        F.concat(c_slug, F.lit("_"), r_slug, F.lit(".json")).alias("file_name"),
        out_company.alias("company"), out_role.alias("title"),
        T.default_if_empty(T.nz(F.col("location")), K.JSON_LOCATION).alias("location"), url.alias("url"),
        T.snippet(desc).alias("descriptionSnippet"), skills.alias("requiredSkills"), desc.alias("fullDescription"),
    )
    last = docs.groupBy("id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "id"]), F.struct(*order)).alias("d"))
    return last.select("id", "d.*").drop(*order)


def write_csv(rows: DataFrame, path: str, headers=CSV_HEADERS, cols=CSV_COLS, mode: str = "overwrite") -> None:
    """CSV with the reference's header names; fields with comma, quote, CR or LF are quoted,
    quotes doubled (O-S19).  Multi-line fields stay intact."""
    out = rows.select(*[F.col(c).cast("string").alias(h) for c, h in zip(cols, headers)])
    (out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("lineSep", "\n").csv(path))


def read_csv(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def write_json(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one document per id (O-K3: an empty input writes no documents)."""
    docs.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def export_report(jobs: DataFrame, asked: DataFrame, key: str = "source") -> DataFrame:
    """O-K3: per asked source its rows and whether a file is written (not for an empty one)."""
    counts = jobs.groupBy(key).agg(F.count("*").alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return asked.select(key).distinct().join(counts, key, "left").select(key, rows.alias("rows"), (rows > 0).alias("written"))


def export(jobs: DataFrame, sheet_path: str, json_path: str, variant: str = "sheet") -> dict:
    """O-K4 fan-out: write the sheet (as CSV) and the JSON documents from one ``jobs`` input.

    ``jobs`` is stored in the shared folder once; both writes and the row
    count (from parquet footers) read it there.  O-K3: where there is nothing
    to export, nothing is written.
    """
    base = store(jobs, "jobs")
    n = base.count()
    if n == 0:
        return {"rows": 0}
    sheet_rows = sheet(base, variant=variant)
    write_csv(sheet_rows, sheet_path, SHEET_HEADERS if variant == "sheet" else ENGINE_SHEET_HEADERS, SHEET_COLS)
    docs = json_docs(base, variant)
    write_json(docs, json_path)
    return {"rows": n}
