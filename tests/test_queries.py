"""Registered queries vs their DuckDB oracle on sf0.001 (the driver runs sf0.01).

A representative subset runs by default; set JOBSIFT_ALL_ORACLES=1 for all.
"""

import os

import pytest

import __spark_entry__ as E
from oracle_harness import digest, duck

SF = "/root/testdata/sf0.001"
SUBSET = [
    "clean_text", "bullets_base", "dedup_description", "dedup_role_company", "smart_trim", "pagination", "page_links",
    "link_histogram", "extract_indeed", "extract_naukri", "naukri_single", "heuristic_cascade", "export_sheet",
    "export_json", "enrich_links", "enrich_errors", "upgrade_if_short", "routed_run", "site_outcomes",
    "extension_page_types", "sql_functions", "indeed_single", "page_body_text", "description_choice", "export_skills_text",
    "csv_fields", "output_names", "export_report", "sql_text_functions", "outcomes",
]
NAMES = sorted(E.oracle_sql()) if os.environ.get("JOBSIFT_ALL_ORACLES") else SUBSET


def test_every_query_registered_with_oracle_or_reason():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:8] == ["s_no", "company_name", "job_role", "job_description", "key_skills", "location", "experience", "source"]
