"""Generic strategies (F11 … F13) and site extractors (F14 … F16)."""

from pyspark.sql import functions as F

from jobsift.operators import extract_generic as G
from jobsift.operators import extract_sites as X

from conftest import pad, pages_df
from jobsift.sources.shred import shred


def items(spark, html, fn, url="https://example.com/x"):
    n = shred(pages_df(spark, [(1, url, pad(html))]))
    return n.select(fn(F.col("url"), F.col("buf"), F.col("nodes")).alias("r")).first().r


def triples(rows):
    out = []
    for r in rows:
        d = r.asDict()
        out.append((d["company"], d["role"] if "role" in d else d["job_role"], d["description"]))
    return out


def test_jsonld_f11(spark):
    html = (
        '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"description":"D1"}</script>'
        '<script type="application/ld+json">[{"@type":["JobPosting"],"title":"Ops","hiringOrganization":"Beta"}, 5,'
        ' {"@type":"Organization","name":"Gamma"}]</script>'
        '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"name":"Delta"}},{"name":"Eps"},{"x":1}]}</script>'
        '<script type="application/ld+json">not json</script><script type="application/ld+json"></script>'
        '<script type="application/ld+json">{"@type":"JobPosting","title":"NoCompany"}</script>'
    )
    got = triples(items(spark, html, lambda u, b, n: G.jsonld_items(n)))
    assert got == [("Acme", "Dev", "D1"), ("Beta", "Ops", ""), ("Gamma", "Company", ""), ("Delta", "Listed Company", ""), ("Eps", "Listed Company", "")]


def test_jsonld_values_that_are_no_text(spark):
    """Such items count as found and give no job; empty values of any kind are missing."""
    one = lambda fields: '<script type="application/ld+json">{"@type":"JobPosting",' + fields + "}</script>"
    html = (
        one('"title":"A","hiringOrganization":"Acme","description":{"text":"x"}') + one('"title":"B","hiringOrganization":"Acme","description":[],"responsibilities":"Do B"')
        + one('"title":"C","hiringOrganization":"Acme","description":null,"responsibilities":["x"]') + one('"title":7,"hiringOrganization":"Acme"')
        + one('"title":"E","hiringOrganization":{"name":12}') + one('"title":"F","hiringOrganization":"Acme","description":0') + one('"title":false,"hiringOrganization":"Acme"')
    )
    found = items(spark, html, lambda u, b, n: G.jsonld_items(n))
    assert [(r.company, r.role, r.description) for r in found] == [
        ("Acme", "A", None), ("Acme", "B", "Do B"), ("Acme", "C", None), ("Acme", None, ""), (None, "E", ""), ("Acme", "F", ""),
    ]
    jobs = items(spark, html, lambda u, b, n: G.generic_jobs(G.heuristic_items(b, n)))
    assert [(r.job_role, r.description) for r in jobs] == [("B", "Do B"), ("F", "")]


def test_tables_f12(spark):
    html = (
        "<table><thead><tr><th>Company Name</th><th>Role</th><th>Employer name</th><th>About</th></tr></thead>"
        "<tr><td>A1</td><td>R1</td><td>Acme Inc.</td><td>D1</td></tr><tr><td>A2</td></tr></table>"
        "<table><tr><td>Only row</td></tr></table>"
        "<table><tr><td>Widgets Technologies</td><td>x</td></tr><tr><td>Acme Ltd</td><td>y</td></tr></table>"
    )
    got = triples(items(spark, html, lambda u, b, n: G.table_items(b, n)))
    # two headers hold "name": the last one wins; short row keeps no company; headerless table uses the hint cell
    assert got == [("Acme Inc.", "R1", "D1"), ("Widgets Technologies", "Listed Entry", ""), ("Acme Ltd", "Listed Entry", "")]


def test_cards_f13(spark):
    html = (
        '<div class="card"><h3 class="company-name">Acme Corp</h3><span class="job-title">backend dev</span>'
        '<p class="desc">Builds APIs</p><div class="card inner"><strong>Nested Labs</strong></div></div>'
        '<div class="card"><span class="title">only role</span></div>'
    )
    got = triples(items(spark, html, lambda u, b, n: G.card_items(b, n)))
    assert got == [("Acme Corp", "backend dev", "Builds APIs"), ("Nested Labs", "Listed Entry", "")]
    custom = triples(items(spark, html, lambda u, b, n: G.card_items(b, n, {"company": "h3", "role": "span.job-title", "description": "p"})))
    assert custom[0] == ("Acme Corp", "backend dev", "Builds APIs")


def test_text_patterns(spark):
    html = "<p>Join Acme Labs as a Data Engineer. Globex Solutions is hiring now. </p>"
    got = triples(items(spark, html, lambda u, b, n: G.text_pattern_items(b)))
    # the company group is lazy and "as a" is optional: the shortest company wins
    assert ("Acme", "Labs as a Data Engineer", "") in got
    assert ("Solutions is hiring", "Listed Entry", "") in got


def test_cascade_first_nonempty(spark):
    html = ('<script type="application/ld+json">{"@type":"Organization","name":"OnlyOrg"}</script>'
            '<table><tr><th>Company</th></tr><tr><td>T Co</td></tr></table>')
    got = triples(items(spark, html, lambda u, b, n: G.heuristic_items(b, n)))
    assert got == [("OnlyOrg", "Company", "")]


def test_naukri_f14(spark):
    single = "<h1 class='jd-header-title'>Data Eng</h1><a class='comp-name' href='/x'>Acme</a><section class='description'>2 to 5 Yrs work</section>"
    r = items(spark, single, lambda u, b, n: X.naukri_jobs(b, n))
    assert len(r) == 1 and (r[0].company, r[0].job_role, r[0].location, r[0].experience) == ("Acme", "Data Eng", "India / Remote", "0-5 Yrs")
    cards = ("<div class='cust-job-tuple'><a class='title' href='/job-listings-a'>Role A</a><span>2 to 5 Yrs Pune Bengaluru</span>"
             "<span class='skill'>SQL</span></div><div class='cust-job-tuple'><a class='title' href='/job-listings-b'>Role B</a><span>3 Yrs</span></div>")
    r = items(spark, cards, lambda u, b, n: X.naukri_jobs(b, n))
    assert [(x.company, x.job_role, x.experience, x.location, list(x.skills)) for x in r] == [
        ("Naukri Organization", "Role A", "2 to 5 Yrs", "Bengaluru", ["SQL"]), ("Naukri Organization", "Role B", "", "", [])]


def test_indeed_f15(spark):
    html = ('<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/rc/clk?jk=1"><span>Dev</span></a></h2>'
            '<span data-testid="company-name">Acme</span><div class="companyLocation">Pune</div></div>'
            '<div class="job_seen_beacon"><div>nothing</div></div>')
    r = items(spark, html, X.indeed_jobs, url="https://www.indeed.com/jobs?q=x")
    assert len(r) == 1
    assert (r[0].company, r[0].job_role, r[0].description, list(r[0].description_bullets), r[0].link) == (
        "Acme", "Dev", "Job posting for Dev at Acme.", ["Location: Pune"], "https://www.indeed.com/rc/clk?jk=1")
    single = items(spark, "<h1>Solo</h1><div id='jobDescriptionText'>Line one here ok.<br>Line two here ok.</div>", X.indeed_jobs,
                   url="https://www.indeed.com/viewjob?jk=9")
    assert (single[0].company, single[0].job_role, single[0].description) == ("Indeed Featured Hiring Org", "Solo", "Line one here ok. Line two here ok.")


def test_linkedin_f16(spark):
    html = ('<div class="base-card"><h3 class="base-search-card__title">ML Eng</h3>'
            '<a href="https://www.linkedin.com/jobs/view/5?trk=a">x</a><span class="job-location">Remote</span></div>')
    r = items(spark, html, X.linkedin_jobs, url="https://www.linkedin.com/jobs/search")
    assert (r[0].company, r[0].job_role, r[0].description, r[0].link, r[0].location) == (
        "LinkedIn Hiring Org", "ML Eng", "Job posting position for ML Eng at company.", "https://www.linkedin.com/jobs/view/5", "Remote")


def test_routing_forced_and_auto(spark):
    """O-C9: Auto-Detect routes by URL; a forced source applies one extractor to every page."""
    from jobsift.operators import route
    from jobsift.sources.shred import shred

    html = pad('<div class="job_seen_beacon"><h2 class="jobTitle"><span>Dev</span></h2><span class="companyName">Acme</span></div>'
               '<div class="card"><h3 class="company-name">Globex Corp</h3><span class="title">ops lead</span></div>')
    pages = pages_df(spark, [(1, "https://www.indeed.com/jobs?q=a", html), (2, "https://other.example/jobs", html)])
    nodes = shred(pages)
    auto = {(r.page_id, r.source, r.company) for r in route.run_routed(nodes).collect()}
    assert auto == {(1, "Indeed", "Acme"), (2, "Generic", "Globex Corp")}
    forced = {(r.page_id, r.source) for r in route.run_routed(nodes, source="Indeed").collect()}
    # one shared seen-set: the second page's Indeed row repeats role+company and is dropped
    assert forced == {(1, "Indeed")}
