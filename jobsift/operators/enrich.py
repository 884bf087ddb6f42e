"""Link enrichment and capture upgrades (O-J1, O-J2, O-T4, O-U1).

The extension visits every job link and merges what the job page gave with
what the listing card said.  Here that is one left outer equi-join of the
``links`` table with the ``job pages`` table on ``url``: AQE picks a
broadcast or a sort-merge join at run time and splits a skewed ``url``
(the same job linked from many listings) across tasks.  Duplicate links are
kept, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import is_batch_url
from .jobs import ARR_FIELDS

RESULT_FIELDS = ["company", "job_role", "description", "description_bullets", "skills", "education", "employment_type", "department", "industry", "source"]


def _pick(item: Column, card: Column, sentinel_prefix: str) -> Column:
    """``(item && !item.startsWith(prefix)) ? item : (card || item || '')``."""
    i, c = T.nz(item), T.nz(card)
    return F.when((i != "") & ~i.startswith(sentinel_prefix), i).when(c != "", c).otherwise(i)


def visited(links: DataFrame, job_pages: DataFrame) -> DataFrame:
    """Valid links with the best record of their page and an ``outcome``: result, or error.

    A url that was captured more than once keeps its longest description
    (O-T4), so a link never multiplies.  The grouping has the join's key and
    adds no shuffle of its own.
    """
    valid = links.where(is_batch_url(F.col("url")))
    records = upgrade_longest(job_pages.select("url", *[c for c in ("page_id",) if c in job_pages.columns], *RESULT_FIELDS), "url", "page_id" if "page_id" in job_pages.columns else None)
    jp = records.select("url", *[F.col(f).alias("j_" + f) for f in RESULT_FIELDS])
    fine = F.col("j_source").isNotNull() | (T.nz(F.col("company")) != "")
    return valid.join(jp, "url", "left").withColumn("outcome", F.when(fine, "result").otherwise("error"))


def batch(links: DataFrame, job_pages: DataFrame, order=("page_id", "pos")) -> tuple[DataFrame, DataFrame]:
    """O-J1 + O-J2: ``links(order…, url, company, role)`` ⋈ ``job_pages(url, job fields)``: (results, errors)."""
    j = visited(links, job_pages)
    matched = F.col("j_source").isNotNull()
    card_company = T.nz(F.col("company"))
    empty = F.array().cast("array<string>")
    res = j.where("outcome = 'result'").select(
        *order, "url",
        F.when(matched, _pick(F.col("j_company"), F.col("company"), "[COMPANY_")).otherwise(card_company).alias("company"),
        F.when(matched, _pick(F.col("j_job_role"), F.col("role"), "[ROLE_")).otherwise(T.nz(F.col("role"))).alias("job_role"),
        *[
            (F.when(matched, F.coalesce(F.col("j_" + f), empty)).otherwise(empty) if f in ARR_FIELDS
             else F.when(matched, T.nz(F.col("j_" + f))).otherwise(F.lit(""))).alias(f)
            for f in ["description", "description_bullets", "skills", "education", "employment_type", "department", "industry"]
        ],
        F.when(matched, T.default_if_empty(T.nz(F.col("j_source")), "batch")).otherwise(F.lit("batch-card-fallback")).alias("source"),
    )
    errors = j.where("outcome = 'error'").select(*order, "url", F.lit("No data extracted").alias("error"))
    return res, errors


def upgrade_longest(captures: DataFrame, key: str = "url", order: str | None = "capture_no") -> DataFrame:
    """O-T4 (content-script rule): per key keep the capture with the longest description;
    ties go to the earliest capture.  A partial ``max_by`` per key: map-side combined."""
    cols = [c for c in captures.columns if c != key]
    earliest = -F.col(order) if order else F.lit(0)
    best = captures.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(F.length(T.nz(F.col("description"))).alias("n"), earliest.alias("o"))).alias("b")
    )
    return best.select(key, "b.*")


def upgrade_if_short(captures: DataFrame, key: str = "url", order: str = "capture_no", threshold: int = 100) -> DataFrame:
    """O-T4 (batch rule): the first capture stands when its description is longer than
    ``threshold``; otherwise the second capture replaces it."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    ranked = captures.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    ranked = ranked.withColumn("_first_len", F.max(F.when(F.col("_rn") == 1, F.length(T.nz(F.col("description"))))).over(whole))
    ranked = ranked.withColumn("_n", F.max("_rn").over(whole))
    keep = F.when((F.col("_first_len") > threshold) | (F.col("_n") == 1), F.col("_rn") == 1).otherwise(F.col("_rn") == 2)
    return ranked.where(keep).drop("_rn", "_first_len", "_n")


def union_runs(*frames: DataFrame) -> DataFrame:
    """O-U1: ``all_jobs.extend(...)`` across pages and sources."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
