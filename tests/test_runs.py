"""Runs keep every job: no cap, no length rule outside Naukri, no dedup of single-job pages."""

from conftest import pad, pages_df
from jobsift.operators import report as R
from jobsift.operators import route
from jobsift.plans.extract_queries import INDEED_EMPTY, INDEED_UNPARSED, site_jobs, site_outcomes
from jobsift.sources.pages import shred_pages

CARD = '<div class="cust-job-tuple"><a class="title" href="/job-listings-{i}">Role {i}</a><a class="comp-name" href="/c{i}">Company {i}</a></div>'


GENERIC = '<div class="company-card"><h3 class="company-name">Acme {i} Widgets Ltd</h3><span class="job-title">Welder</span></div>'


def test_sixty_cards_give_sixty_jobs_unless_limited(spark):
    html = "<body>" + "".join(CARD.format(i=i) for i in range(60)) + "</body>"
    pages = pages_df(spark, [(1, "https://www.naukri.com/x-jobs", html)])
    assert site_jobs(pages, "Naukri", prefer="cards").count() == 60
    assert site_jobs(pages, "Naukri", prefer="cards", max_jobs=20).count() == 20
    html = "<section>" + "".join(GENERIC.format(i=i) for i in range(60)) + "</section>"
    nodes = shred_pages(pages_df(spark, [(1, "https://x.example.com/jobs", html)]))
    assert route.run_routed(nodes).count() == 60
    assert route.run_routed(nodes, max_jobs=20).count() == 20


def test_short_pages_count_except_for_naukri(spark):
    generic = '<div class="company-card"><h3 class="company-name">Acme Widgets Ltd</h3><span class="job-title">Welder</span></div>'
    rows = [(1, "https://shop.example.com/jobs", generic), (2, "https://www.naukri.com/jobs", CARD.format(i=1)), (3, "https://www.naukri.com/jobs", pad(CARD.format(i=2)))]
    got = route.run_routed(shred_pages(pages_df(spark, rows))).collect()
    assert sorted((r.page_id, r.company) for r in got) == [(1, "Acme Widgets Ltd"), (3, "Company 2")]


def test_single_job_pages_are_not_deduplicated(spark):
    one = "<h1>Same title</h1><div id='jobDescriptionText'>Line one.</div>"
    rows = [(i, f"https://www.indeed.com/viewjob?jk={i}", one) for i in (1, 2)]
    rows += [(i, f"https://www.linkedin.com/jobs/view/{i}", "<h1>Same title</h1>") for i in (3, 4)]
    got = route.run_routed(shred_pages(pages_df(spark, rows))).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4]
    assert "single" not in got[0].asDict()


def test_outcomes_of_unread_and_unparsed_pages(spark):
    rows = [
        (1, "https://www.indeed.com/viewjob?jk=1", "<h1>Job</h1>"), (2, "https://www.indeed.com/viewjob?jk=2", "<p>nothing</p>"),
        (3, "https://www.indeed.com/jobs", None), (4, "https://www.indeed.com/jobs", ""),
    ]
    got = {r.page_id: (r.success, r.total_found, r.error_message) for r in site_outcomes(pages_df(spark, rows), "Indeed").collect()}
    assert got[1] == (True, 1, "") and got[2] == (False, 0, INDEED_UNPARSED)
    assert got[3] == got[4] == (False, 0, R.FETCH_FAILED)
    assert INDEED_EMPTY != INDEED_UNPARSED


def test_custom_selectors_are_filled_by_detection(spark):
    card = '<div class="company-card">{em}<h3 class="company-name">Acme Widgets Ltd</h3><span class="job-title">senior welder</span><p class="description">About it {i}</p></div>'
    pages = ["<em class=cc>custom co</em><em class=cr>custom role</em><em class=cd>cd</em>", "<em class=cc>custom co</em><em class=cd>cd</em>", "<em class=cr>custom role</em>", ""]
    rows = [(i, f"https://x.example.com/{i}", "<section>" + card.format(em=em, i=i) + "</section>") for i, em in enumerate(pages)]
    custom = {"company": "em.cc", "role": "em.cr", "description": "em.cd"}
    got = {r.page_id: (r.company, r.job_role, r.description) for r in route.run_routed(shred_pages(pages_df(spark, rows)), custom=custom).collect()}
    assert got[0] == ("custom co", "custom role", "cd")
    assert got[1] == ("custom co", "senior welder", "About it 1")
    assert got[2] == ("Acme Widgets Ltd", "custom role", "About it 2")
