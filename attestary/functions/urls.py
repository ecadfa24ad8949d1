"""URL identity as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Beginnings of hosts and parts of paths that mark engineering blogs; job boards' addresses (fixed values).
BLOG_HOSTS = ("engineering.", "blog.", "tech.", "research.")
BLOG_PATHS = ("blog", "engineering")
JOB_BOARDS = (
    ("greenhouse", r"^https?://(?:job-)?boards\.greenhouse\.io/([A-Za-z0-9_-]+)", "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"),
    ("lever", r"^https?://jobs\.lever\.co/([A-Za-z0-9_-]+)", "https://api.lever.co/v0/postings/{}?mode=json"),
    ("ashby", r"^https?://jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)", "https://api.ashbyhq.com/posting-api/job-board/{}"),
)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _encoded(part: Column) -> Column:
    """A query name or value, decoded and encoded again in form style; what can't be decoded stays as it is. Of what
    Spark's encoder leaves or changes, `*` is encoded and `~` is not."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Trimmed; scheme and host in lower case; without utm_ parameters, fragment and closing slashes; the query encoded
    anew, parameters without a value kept as name=. What is no absolute URL is only trimmed; null stays null."""
    url = F.trim(url)
    path = F.rtrim(_part(url, 3), F.lit("/"))
    params = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.array_join(
        F.transform(params, lambda p: F.concat(_encoded(F.substring_index(p, "=", 1)), F.lit("="),
                    _encoded(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")))), "&",
    )
    whole = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url.rlike(_URL), whole).otherwise(url)


def item_id(url: Column) -> Column:
    """The first 16 hexadecimal digits of the canonical URL's SHA-256."""
    return F.substring(F.sha2(canonical_url(url).cast("binary"), 256), 1, 16)


def host(url: Column) -> Column:
    """Lower case, without a leading www., with user and port as they stand."""
    return F.regexp_replace(F.lower(_part(F.trim(url), 2)), r"^www\.", "")


def is_bloglike(url: Column) -> Column:
    starts = [F.lower(_part(F.trim(url), 2)).startswith(h) for h in BLOG_HOSTS]
    return starts[0] | starts[1] | starts[2] | starts[3] | _part(F.trim(url), 3).rlike(f"/({'|'.join(BLOG_PATHS)})(/|$)")


def job_board(url: Column) -> Column:
    """struct<source_id, api> of the job board that a URL belongs to, or null."""
    return F.coalesce(*[
        F.when(url.rlike(p), F.struct(F.concat(F.lit(f"{kind}-"), F.lower(F.regexp_extract(url, p, 1))).alias("source_id"),
                                      F.replace(F.lit(api), F.lit("{}"), F.regexp_extract(url, p, 1)).alias("api")))
        for kind, p, api in JOB_BOARDS
    ])


def slug(text: Column, most: int = 80) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def talk_url(page: Column, key: Column) -> Column:
    """The address of one talk of a page: its key as one more parameter."""
    return F.concat(page, F.when(page.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("talk="), F.replace(_encoded(key), F.lit("+"), F.lit("%20")))


def absolute(base: Column, href: Column) -> Column:
    """A link as seen from a page: absolute ones as they are, others from the host or from the page's folder."""
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
