"""Registered queries over ``pages``: URL rules, classification, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import classify as C
from ..operators import select as S
from ..sources.pages import shred_pages, table_pages

MAX_PAGES = 3


def q_url_source(spark, sf_dir):
    p = table_pages(spark, sf_dir)
    return p.select(
        "page_id", U.detect_source("url").alias("source"), U.is_valid_url("url").alias("valid"),
        U.is_batch_url("url").alias("batch_ok"), U.source_mismatch("url", F.lit("Indeed")).alias("indeed_mismatch"),
    )


def q_url_domain(spark, sf_dir):
    p = table_pages(spark, sf_dir)
    return p.select(
        "page_id", U.netloc("url").alias("host"), U.is_indeed_url("url").alias("is_indeed"),
        U.is_linkedin_url("url").alias("is_linkedin"), U.is_naukri_url("url").alias("is_naukri"),
    )


def q_url_single(spark, sf_dir):
    p = table_pages(spark, sf_dir)
    return p.select(
        "page_id", U.is_single_job_url("url", "Indeed").alias("indeed_single"),
        U.is_single_job_url("url", "LinkedIn").alias("linkedin_single"),
    )


def q_pagination(spark, sf_dir, max_pages: int = MAX_PAGES):
    """O-C10 crawl plan for every page URL (Indeed rule for the pages Indeed would get)."""
    p = table_pages(spark, sf_dir).select("page_id", "url", U.detect_source("url").alias("source"))
    plan = p.select("page_id", "url", "source", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("page_no"))
    out = plan.select(
        "page_id", F.col("page_no").cast("int").alias("page_no"), U.page_url("url", "source", "page_no").alias("page_url"),
        U.page_url("url", F.lit("Indeed"), "page_no").alias("indeed_url"),
    )
    return out.where(F.col("page_url").isNotNull() | F.col("indeed_url").isNotNull())


def q_usable_blocked(spark, sf_dir):
    p = table_pages(spark, sf_dir)
    return p.select("page_id", C.usable("html").alias("usable"), C.blocked("html").alias("blocked"), C.blocked_v2("html").alias("blocked_v2"))


def _nodes(spark, sf_dir):
    return shred_pages(table_pages(spark, sf_dir))


def q_page_headings(spark, sf_dir):
    return page_headings(_nodes(spark, sf_dir))


def page_headings(n):
    return n.select(
        "page_id",
        T.clean_text(S.text(F.col("buf"), S.select_one(F.col("nodes"), "title"))).alias("title"),
        T.clean_text(S.text(F.col("buf"), S.select_one(F.col("nodes"), "h1"))).alias("h1"),
    )


def page_links(nodes_df):
    """All ``a[href]`` of every page with document position and text."""
    links = nodes_df.select("page_id", "buf", F.posexplode(S.select_all(F.col("nodes"), "a[href]")).alias("i", "a"))
    return links.select(
        "page_id", (F.col("i") + 1).cast("int").alias("pos"), S.attr(F.col("a"), "href").alias("href"),
        S.text(F.col("buf"), F.col("a")).alias("link_text"),
    )


def q_page_links(spark, sf_dir):
    return page_links(_nodes(spark, sf_dir))


#: Forms of a link made of every supplied one (``x``: without its leading slash).
LINK_FORMS = ["/{x}", "{x}", "../{x}", "?{x}", "#{x}", "mailto:{x}", "//other.example.com/{x}", "./a/../{x}", "", "https://other.example.com/b/./{x}"]


def q_resolve_links(spark, sf_dir):
    """O-H10 over all links of all pages, in every form that an href can have."""
    links = page_links(_nodes(spark, sf_dir)).join(table_pages(spark, sf_dir).select("page_id", "url"), "page_id")
    x = F.regexp_replace("href", "^/", "")
    forms = F.array(*[F.replace(F.lit(f), F.lit("{x}"), x) for f in LINK_FORMS])
    each = links.select("page_id", "pos", "url", F.posexplode(forms).alias("form", "href"))
    return each.select("page_id", "pos", "form", U.resolve("href", "url").alias("resolved"))


def q_link_histogram(spark, sf_dir):
    """O-C14 + O-A5: link-pattern counts, most common first."""
    links = page_links(_nodes(spark, sf_dir))
    pat = links.select(C.link_pattern("href").alias("pattern")).where(F.col("pattern").isNotNull())
    return pat.groupBy("pattern").agg(F.count("*").cast("bigint").alias("n")).orderBy(F.desc("n"), "pattern")


def q_link_sample(spark, sf_dir):
    """O-C15: first 20 sample links per page (text[:60] stripped, href[:90])."""
    links = page_links(_nodes(spark, sf_dir)).where(C.sample_link("href"))
    w = Window.partitionBy("page_id").orderBy("pos")
    ranked = links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)
    return ranked.select(
        "page_id", F.col("rank").cast("int").alias("rank"),
        T.py_strip(F.substring("link_text", 1, 60)).alias("text60"), F.substring("href", 1, 90).alias("href90"),
    )


def q_page_type(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.select(
        "page_id", C.extension_site("url").alias("site"), C.page_type(F.col("nodes"), F.col("url")).alias("page_type"),
        S.count(F.col("nodes"), C.GENERIC_JOB_LINKS).cast("int").alias("job_links"),
    )
