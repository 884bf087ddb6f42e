"""Registry of queries (name → callable(spark, sf_dir)) and their oracle SQL."""

from __future__ import annotations

import functools

from ..session import tune

from . import detail_queries as dq
from . import extension_queries as eq
from . import extract_queries as xq
from . import generic_queries as gq
from . import page_queries as pq
from . import report_queries as rq
from . import routed_queries as oq
from . import stream_queries as sq
from . import text_queries as tq
from .detail_oracle import DETAIL_SQL
from .oracle import EXTENSION_SQL, EXTRACT_SQL, GENERIC_SQL, PAGE_SQL, REPORT_SQL, ROUTED_SQL, STREAM_SQL, TEXT_SQL

QUERIES = {
    "clean_text": tq.q_clean_text,
    "bullets_base": tq.q_bullets_base,
    "bullets_engine": tq.q_bullets_engine,
    "bullets_ext": tq.q_bullets_ext,
    "fingerprint": tq.q_fingerprint,
    "dedup_description": tq.q_dedup_description,
    "dedup_role_company": tq.q_dedup_role_company,
    "dedup_triple": tq.q_dedup_triple,
    "dedup_cross_run": tq.q_dedup_cross_run,
    "skills_tag": tq.q_skills_tag,
    "looks_like_company": tq.q_looks_like_company,
    "location_lookup": tq.q_location_lookup,
    "experience": tq.q_experience,
    "smart_trim": tq.q_smart_trim,
    "labelled_fields": tq.q_labelled_fields,
    "slug_snippet": tq.q_slug_snippet,
    "sql_functions": tq.q_sql_functions,
    "url_source": pq.q_url_source,
    "url_domain": pq.q_url_domain,
    "url_single": pq.q_url_single,
    "pagination": pq.q_pagination,
    "usable_blocked": pq.q_usable_blocked,
    "page_headings": pq.q_page_headings,
    "page_links": pq.q_page_links,
    "resolve_links": pq.q_resolve_links,
    "link_histogram": pq.q_link_histogram,
    "link_sample": pq.q_link_sample,
    "page_type": pq.q_page_type,
    "extract_indeed": xq.q_extract_indeed,
    "extract_linkedin": xq.q_extract_linkedin,
    "extract_naukri": xq.q_extract_naukri,
    "naukri_single": xq.q_naukri_single,
    "site_outcomes": xq.q_site_outcomes,
    "extract_jsonld": gq.q_extract_jsonld,
    "extract_tables": gq.q_extract_tables,
    "extract_cards": gq.q_extract_cards,
    "extract_text_patterns": gq.q_extract_text_patterns,
    "heuristic_cascade": gq.q_heuristic_cascade,
    "custom_selectors": gq.q_custom_selectors,
    "summary": rq.q_summary,
    "outcomes": rq.q_outcomes,
    "preview": rq.q_preview,
    "export_sheet": rq.q_export_sheet,
    "export_csv": rq.q_export_csv,
    "export_json": rq.q_export_json,
    "serial_lineitem": rq.q_serial_lineitem,
    "naukri_links": eq.q_naukri_links,
    "generic_links": eq.q_generic_links,
    "script_links": eq.q_script_links,
    "naukri_job_page": eq.q_naukri_job_page,
    "script_job_page": eq.q_script_job_page,
    "enrich_links": eq.q_enrich_links,
    "enrich_errors": eq.q_enrich_errors,
    "extension_page_types": eq.q_extension_page_types,
    "stream_dedup": sq.q_stream_dedup,
    "stream_pages": sq.q_stream_pages,
    "stream_status": sq.q_stream_status,
    "upgrade_longest": sq.q_upgrade_longest,
    "stream_upgrade": sq.q_stream_upgrade,
    "upgrade_if_short": sq.q_upgrade_if_short,
    "sites_summary": sq.q_sites_summary,
    "batch_status": sq.q_batch_status,
    "routed_run": oq.q_routed_run,
    "export_sheet_engine": oq.q_export_sheet_engine,
    "export_json_engine": oq.q_export_json_engine,
    "indeed_single": dq.q_indeed_single,
    "linkedin_single": dq.q_linkedin_single,
    "page_body_text": dq.q_page_body_text,
    "description_choice": dq.q_description_choice,
    "skills_split": dq.q_skills_split,
    "export_skills_text": dq.q_export_skills_text,
    "csv_fields": dq.q_csv_fields,
    "output_names": dq.q_output_names,
    "export_report": dq.q_export_report,
    "sql_text_functions": dq.q_sql_text_functions,
}


ORACLE = {**TEXT_SQL, **PAGE_SQL, **EXTRACT_SQL, **GENERIC_SQL, **REPORT_SQL, **EXTENSION_SQL, **STREAM_SQL, **ROUTED_SQL, **DETAIL_SQL}


def _tuned(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        tune(spark)
        return fn(spark, sf_dir)

    return run


def queries():
    return {k: _tuned(v) for k, v in QUERIES.items()}


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}


flagship = _tuned(rq.flagship)
