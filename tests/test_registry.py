"""Sites and sources of one's own, skills as one string, CSV fields, empty exports."""

import datetime
import os

import pytest
from conftest import pad, pages_df
from pyspark.sql import functions as F

from jobsift.functions import text as T
from jobsift.operators import extract_extension as E
from jobsift.operators import route, sinks
from jobsift.operators import select as S
from jobsift.operators.jobs import job
from jobsift.sources.pages import shred_pages

PAGE = '<html><body><div id="vacancy"><b class="who">Acme</b><i class="what">Welder</i></div><a href="/v/1">one</a></body></html>'


def scraped(spark, url, html=PAGE):
    nodes = shred_pages(pages_df(spark, [(1, url, pad(html))]))
    return nodes.select(E.scrape_page(F.col("url"), F.col("buf"), F.col("nodes")).alias("r")).first()["r"]


def acme_job(url, buf, nodes, custom=None):
    text = lambda css: T.clean_text(S.text(buf, S.select_one(nodes, css)))
    return job(company=text("b.who"), job_role=text("i.what"), source=F.lit("Acme"), link=url)


def test_site_rules_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(E, "SITES", dict(E.SITES))
    assert scraped(spark, "https://jobs.acme.test/1").page_type == "unknown"
    E.register_site("acme", E.SiteRules(
        is_listing=lambda u, b, n: S.count(n, "a") >= 1, is_job=lambda u, b, n: S.count(n, "#vacancy") >= 1,
        links=E.generic_links, job_page=acme_job, host="acme.test",
    ))
    r = scraped(spark, "https://jobs.acme.test/1")
    assert (r.page_type, r.data[0].company, r.data[0].job_role) == ("job", "Acme", "Welder")
    assert scraped(spark, "https://jobs.other.test/1").page_type == "unknown"  # the generic rules still hold elsewhere
    assert scraped(spark, "https://jobs.acme.test/1", PAGE.replace("vacancy", "x")).page_type == "listing"
    with pytest.raises(ValueError):
        E.register_site("nowhere", E.SITES["generic"])


def test_extractor_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(route, "REGISTRY", dict(route.REGISTRY))
    monkeypatch.setattr(route, "DETECT", {})
    route.register_extractor("Acme", lambda u, b, n, custom=None: F.array(acme_job(u, b, n)), lambda url: F.instr(url, "acme.test") > 0)
    pages = [(1, "https://jobs.acme.test/1", PAGE), (2, "https://jobs.acme.test/2", PAGE), (3, "https://www.indeed.com/viewjob?jk=1", "<h1>Cook</h1>")]
    nodes = shred_pages(pages_df(spark, [(i, u, pad(h)) for i, u, h in pages]))
    rows = {(r.page_id, r.company, r.job_role, r.source) for r in route.run_routed(nodes).collect()}
    assert rows == {(1, "Acme", "Welder", "Acme"), (3, "Indeed Featured Hiring Org", "Cook", "Indeed")}  # page 2 repeats page 1


def jobs(spark, skills, kind):
    return spark.createDataFrame(
        [(1, 1, "Acme", "Welder", "Welds, all day", [], skills, "", "", "Generic", None, None, None, None, None)],
        f"page_id INT, pos INT, company STRING, job_role STRING, description STRING, description_bullets ARRAY<STRING>, skills {kind}, location STRING, "
        "experience STRING, source STRING, education STRING, employment_type STRING, department STRING, industry STRING, link STRING",
    )


@pytest.mark.parametrize("variant", ["sheet", "engine"])
def test_skills_as_one_string(spark, variant):
    text, listed = jobs(spark, " React,, Go ", "STRING"), jobs(spark, ["React", "Go"], "ARRAY<STRING>")
    for make in (lambda j: sinks.sheet(j, variant=variant), sinks.csv_rows, lambda j: sinks.json_docs(j, variant)):
        assert make(text).collect() == make(listed).collect()
    none = [jobs(spark, "", "STRING"), jobs(spark, None, "STRING"), jobs(spark, [], "ARRAY<STRING>"), jobs(spark, None, "ARRAY<STRING>")]
    cells = {sinks.sheet(j, variant=variant).first()["key_skills"] for j in none}
    assert len(cells) == 1


def test_csv_fields_are_what_the_writer_writes(spark, tmp_path):
    values = ["plain", "a,b", 'say "hi"', "two\nlines", "cr\rhere", '"', "semi;colon"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    escaped = [r[0] for r in df.select(T.csv_escape("v")).collect()]
    assert escaped == ["plain", '"a,b"', '"say ""hi"""', '"two\nlines"', '"cr\rhere"', '""""', "semi;colon"]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), ["v"], ["v"])
    part = next(p for p in os.listdir(tmp_path / "c") if p.endswith(".csv"))
    assert (tmp_path / "c" / part).read_bytes().decode() == "v\n" + "\n".join(escaped) + "\n"
    assert spark.range(1).select(T.csv_escape(F.lit(None).cast("string"))).first()[0] == ""


def test_nothing_to_export(spark, tmp_path):
    empty = jobs(spark, "x", "STRING").where("false")
    assert sinks.export(empty, str(tmp_path / "s"), str(tmp_path / "j")) == {"rows": 0}
    assert os.listdir(tmp_path) == []
    asked = spark.createDataFrame([("Generic",), ("Indeed",), ("Generic",)], "source STRING")
    report = {tuple(r) for r in sinks.export_report(jobs(spark, "x", "STRING"), asked).collect()}
    assert report == {("Generic", 1, True), ("Indeed", 0, False)}


def test_output_names(spark):
    at = F.lit(datetime.datetime(2024, 3, 1, 7, 8, 9))
    names = [spark.range(1).select(T.output_name(F.lit(s), at)).first()[0] for s in ("Indeed, LinkedIn", "a/b:c_d-é", ";;", None)]
    assert names == ["jobs_Indeed LinkedIn_20240301_070809", "jobs_abc_d-é_20240301_070809", "jobs_scraped_20240301_070809", "jobs_scraped_20240301_070809"]
