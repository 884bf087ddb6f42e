"""Deduplication (O-D1 … O-D5, O-W2).

"First seen wins" needs an order; every row carries sort columns (``page_id,
pos`` for extracted jobs, ``doc_id`` for documents).  ``first_per_key`` is
``row_number() = 1`` over the key: Catalyst plans it with a partial
``WindowGroupLimit`` *before* the shuffle, so even a key that holds a third
of all rows (the empty fingerprint) sends one row per map task, not the
whole group, to one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def role_company_key(role, company) -> Column:
    """O-D1: fingerprint(job_role + company), no separator."""
    return T.fingerprint(F.concat(T.nz(role), T.nz(company)))


def description_key(description, company) -> Column:
    """O-D2: fingerprint(description[:100]) or fingerprint(company) without a description."""
    d = T.nz(description)
    return F.when(d != "", T.fingerprint(F.substring(d, 1, 100))).otherwise(T.fingerprint(company))


def triple_key(company, role, description) -> Column:
    """O-D3: ``company|role|description[:100]`` exactly, no normalising."""
    return F.concat_ws("|", T.nz(company), T.nz(role), F.substring(T.nz(description), 1, 100))


def page_key(page: str = "page_id", pos: str = "pos") -> Column:
    """Key of a job that no dedup applies to: single-job pages are appended unchecked."""
    return F.concat_ws("|", F.lit("P"), F.col(page).cast("string"), F.col(pos).cast("string"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every key value."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def cross_run(new: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """O-D4: drop keys already in the ``seen`` table, then first per key in this run.

    ``seen`` is a table of earlier runs' keys (distinct-ified here); the
    anti-join is planned by AQE (broadcast when ``seen`` is small at run
    time, sort-merge otherwise).
    """
    fresh = new.join(seen.select(key).distinct(), key, "left_anti")
    return first_per_key(fresh, key, order)


def seen_rows(kept: DataFrame, key: str, page_col: str, run_id: str) -> DataFrame:
    """Rows to append to the ``seen`` table after a run: (fingerprint, first_page_id, run_id)."""
    return kept.select(F.col(key).alias("fingerprint"), F.col(page_col).alias("first_page_id"), F.lit(run_id).alias("run_id"))


def distinct_urls(links: DataFrame, order: list[str]) -> DataFrame:
    """O-D5 across pages: first row per url."""
    return first_per_key(links, "url", order)
