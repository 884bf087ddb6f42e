"""The ``jobs`` row shape and helpers shared by the extractors.

An extractor is a Column function over one shredded page (``url``, ``buf``,
``nodes``) that returns ``ARRAY<STRUCT<…job fields…>>`` in document order;
:func:`explode_jobs` turns it into rows with ``pos`` (O-X5 → rows), so every
extractor is a narrow, shuffle-free projection of the node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, nz

STR_FIELDS = [
    "company", "job_role", "description", "location", "experience", "highlights", "education",
    "employment_type", "department", "industry", "source", "link",
]
ARR_FIELDS = ["description_bullets", "skills"]
JOB_COLUMNS = ["page_id", "pos", "url"] + STR_FIELDS[:3] + ARR_FIELDS + STR_FIELDS[3:]



def empty_strings() -> Column:
    return F.array().cast("array<string>")


def job(**fields) -> Column:
    """A job struct with every field present (absent = '' or []); ``single``: it is its page's only job (O-X7, O-X8)."""
    cols = []
    for f in STR_FIELDS:
        cols.append(nz(fields.get(f, F.lit(""))).cast("string").alias(f))
    for f in ARR_FIELDS:
        cols.append(F.coalesce(fields.get(f, empty_strings()), empty_strings()).alias(f))
    cols.append(F.lit(bool(fields.get("single", False))).alias("single"))
    return F.struct(*cols)


def empty_jobs() -> Column:
    return F.filter(F.array(job()), lambda x: F.lit(False))


def first_nonempty(*arrays) -> Column:
    """First array with at least one element (later arrays are not evaluated)."""
    if len(arrays) == 1:
        return arrays[0]
    return let(arrays[0], lambda a: F.when(F.size(a) > 0, a).otherwise(first_nonempty(*arrays[1:])))


def first_nonempty_text(*texts) -> Column:
    """Selector cascade (O-H6): first non-blank text, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def explode_jobs(pages: DataFrame, items: Column, extra: list | None = None, single: bool = False) -> DataFrame:
    """``(page_id, url, …)`` + job array → one row per job with 1-based ``pos`` (and ``single``, for dedup)."""
    keep = ["page_id", "url"] + (extra or [])
    # posexplode_outer: no inferred ``size(items) > 0`` filter, so the
    # extraction expression is evaluated once per page
    exploded = pages.select(*keep, F.posexplode_outer(items).alias("_p", "_j")).where(F.col("_j").isNotNull())
    return exploded.select(
        "page_id", (F.col("_p") + 1).cast("int").alias("pos"), "url",
        *[F.col("_j")[f].alias(f) for f in STR_FIELDS[:3] + ARR_FIELDS + STR_FIELDS[3:]],
        *(extra or []), *([F.col("_j")["single"].alias("single")] if single else []),
    )


def flat(jobs: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Arrays joined by newline so results compare as plain text."""
    cols = cols or JOB_COLUMNS
    out = []
    for c in cols:
        out.append(F.array_join(F.col(c), "\n").alias(c) if c in ARR_FIELDS else F.col(c))
    return jobs.select(*out)
