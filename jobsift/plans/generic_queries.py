"""Registered generic-extraction queries (O-X1 … O-X6) on Spark-built pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import extract_generic as G
from ..operators.jobs import explode_jobs, flat
from ..sources import listings as L
from ..sources.pages import shred_pages

OUT = ["page_id", "pos", "company", "job_role", "description", "description_bullets"]


def generic_run(pages, strategies=G.STRATEGIES, custom=None):
    """GenericScraper over a set of pages: cascade → post-processing → run-wide O-D2 dedup."""
    return generic_run_nodes(shred_pages(pages), strategies, custom)


def generic_run_nodes(nodes, strategies=G.STRATEGIES, custom=None):
    items = G.heuristic_items(F.col("buf"), F.col("nodes"), custom, strategies)
    jobs = explode_jobs(nodes, G.generic_jobs(items))
    keyed = jobs.withColumn("fp", dedup.description_key("description", "company"))
    return dedup.first_per_key(keyed, "fp", ["page_id", "pos"]).drop("fp")


def q_extract_jsonld(spark, sf_dir):
    return flat(generic_run(L.jsonld_pages(spark, sf_dir), ("jsonld",)), OUT)


def q_extract_tables(spark, sf_dir):
    return flat(generic_run(L.table_pages(spark, sf_dir), ("tables",)), OUT)


def q_extract_cards(spark, sf_dir):
    return flat(generic_run(L.generic_card_pages(spark, sf_dir), ("cards",)), OUT)


def q_extract_text_patterns(spark, sf_dir):
    return flat(generic_run(L.text_pattern_pages(spark, sf_dir), ("text",)), OUT)


def q_heuristic_cascade(spark, sf_dir):
    return flat(generic_run(L.mixed_pages(spark, sf_dir)), OUT)


def q_custom_selectors(spark, sf_dir):
    """O-H12: custom values stand, detection fills what they leave open."""
    return flat(generic_run(L.custom_card_pages(spark, sf_dir), ("cards",), L.CUSTOM_SELECTORS), OUT)
