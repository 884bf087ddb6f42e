"""URL functions (O-C4 … O-C8, O-C10, O-H10) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, let, nz

# netloc the way ``urllib.parse.urlsplit`` finds it: after ``scheme:`` and ``//``
NETLOC_RE = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"

SOURCE_DOMAINS = {"Indeed": "indeed.com", "LinkedIn": "linkedin.com", "Naukri": "naukri.com"}


def detect_source(url) -> Column:
    """O-C4: on the whole lower-cased URL (not the host)."""
    u = F.lower(nz(url))
    return (
        F.when(F.instr(u, "indeed.com") > 0, F.lit("Indeed"))
        .when((F.instr(u, "linkedin.com") > 0) & (F.instr(u, "jobs") > 0), F.lit("LinkedIn"))
        .when(F.instr(u, "naukri.com") > 0, F.lit("Naukri"))
        .otherwise(F.lit("Generic"))
    )


def netloc(url) -> Column:
    return F.regexp_extract(nz(url), NETLOC_RE, 1)


def host_contains(url, domain: str) -> Column:
    """O-C5: ``domain in urlparse(url).netloc.lower()`` (a substring test)."""
    return F.instr(F.lower(netloc(url)), domain) > 0


def is_indeed_url(url) -> Column:
    return host_contains(url, "indeed.com")


def is_linkedin_url(url) -> Column:
    return host_contains(url, "linkedin.com")


def is_naukri_url(url) -> Column:
    return host_contains(url, "naukri.com")


def is_single_job_url(url, source: str) -> Column:
    """O-C6: Indeed ``/viewjob``, ``jk=``, ``/rc/clk``; LinkedIn ``/jobs/view``, ``/jobs/collections``."""
    u = F.lower(nz(url))
    if source == "Indeed":
        return (F.instr(u, "/viewjob") > 0) | (F.instr(u, "jk=") > 0) | (F.instr(u, "/rc/clk") > 0)
    if source == "LinkedIn":
        return (F.instr(u, "/jobs/view") > 0) | (F.instr(u, "/jobs/collections") > 0)
    return F.lit(False)


def is_valid_url(url) -> Column:
    """O-C7: starts with ``http://`` or ``https://`` (case-sensitive)."""
    u = nz(url)
    return u.startswith("http://") | u.startswith("https://")


def is_batch_url(url) -> Column:
    """O-C7 (batch): a non-null URL that is not ``chrome://``, ``edge://`` or ``about:``."""
    u = F.col(url) if isinstance(url, str) else url
    return u.isNotNull() & (u != "") & ~u.startswith("chrome://") & ~u.startswith("edge://") & ~u.startswith("about:")


def source_mismatch(url, source) -> Column:
    """O-C8: the chosen source's domain is not in the URL."""
    s = F.col(source) if isinstance(source, str) else source
    u = F.lower(nz(url))
    dom = F.when(s == "Indeed", F.lit("indeed.com")).when(s == "LinkedIn", F.lit("linkedin.com")).when(s == "Naukri", F.lit("naukri.com"))
    return dom.isNotNull() & (F.instr(u, dom) == 0)


def page_url(url, source, k) -> Column:
    """O-C10: URL of page ``k`` (0-based) of a run started at ``url``; NULL when the run stops.

    ``start=N`` wins over ``page=N`` (every occurrence is replaced, also inside
    other names such as ``restart=``); with neither, Indeed appends
    ``start=k*10`` and other sources stop after the first page.
    """
    u = nz(url)
    s = F.col(source) if isinstance(source, str) else source
    k = F.col(k) if isinstance(k, str) else k
    nxt = (
        F.when(F.instr(u, "start=") > 0, F.regexp_replace(u, F.lit(f"start={DIGIT}+"), F.concat(F.lit("start="), (k * 10).cast("string"))))
        .when(F.instr(u, "page=") > 0, F.regexp_replace(u, F.lit(f"page={DIGIT}+"), F.concat(F.lit("page="), (k + 1).cast("string"))))
        .when(s == "Indeed", F.concat(u, F.when(F.instr(u, "?") > 0, F.lit("&")).otherwise(F.lit("?")), F.lit("start="), (k * 10).cast("string")))
    )
    return F.when(k == 0, u).otherwise(nxt)


def origin(url) -> Column:
    """``scheme://host[:port]`` of a URL (``window.location.origin``)."""
    return F.regexp_extract(nz(url), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def absolutize(href, base_url) -> Column:
    """O-H10 (extension rule): prefix the page origin when the href starts with '/'."""
    h = nz(href)
    return F.when(h.startswith("/"), F.concat(origin(base_url), h)).otherwise(h)


# RFC 3986, appendix B: scheme, authority, path, query, fragment, each with its delimiter
PARTS_RE = "^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(#.*)?$"


def _parts(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, "(?s)" + PARTS_RE, i)
    return F.struct(part(1).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986, 5.2.4, for a path that begins with a slash."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(segments, 2, 1 << 30), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(F.instr(path, "/.") > 0, F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def resolve(href, base) -> Column:
    """O-H10: the absolute URL of ``href`` on a page at ``base`` (RFC 3986, 5.2.2).

    An empty href is the page itself; one with a scheme but no authority
    (``mailto:``, ``javascript:``) stays as it is.
    """
    def merged(r, b):
        directory = F.regexp_extract(b["path"], "(?s)^(.*/)", 1)
        joined = F.concat(F.when((b["authority"] != "") & (b["path"] == ""), F.lit("/")).otherwise(directory), r["path"])
        return F.when(joined.startswith("/"), remove_dot_segments(joined)).otherwise(joined)

    def of(x):
        r, b = x["r"], x["b"]
        own = F.when(r["path"].startswith("/"), remove_dot_segments(r["path"])).otherwise(r["path"])
        site = F.concat(b["scheme"], b["authority"])
        tail = F.concat(r["query"], r["fragment"])
        return (
            F.when((r["scheme"] != "") & (r["authority"] == ""), F.concat(r["scheme"], r["path"], tail))
            .when(r["scheme"] != "", F.concat(r["scheme"], r["authority"], own, tail))
            .when(r["authority"] != "", F.concat(b["scheme"], r["authority"], own, tail))
            .when((r["path"] == "") & (r["query"] == ""), F.concat(site, b["path"], b["query"], r["fragment"]))
            .when(r["path"] == "", F.concat(site, b["path"], tail))
            .otherwise(F.concat(site, F.when(r["path"].startswith("/"), own).otherwise(merged(r, b)), tail))
        )

    return let(F.struct(_parts(trim_url(href)).alias("r"), _parts(nz(base)).alias("b")), of)


def trim_url(url) -> Column:
    """Without the white space that browsers ignore around a URL."""
    return F.regexp_replace(nz(url), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def urljoin_base(href, base: str) -> Column:
    """O-H10 (Indeed rule): ``href`` against a fixed site."""
    return resolve(href, F.lit(base))


def strip_query(href) -> Column:
    """O-H10 (LinkedIn rule): drop everything from the first '?'."""
    return F.substring_index(nz(href), "?", 1)
