"""New sources from links: job boards, feeds and hosts that no source covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import feed_link_column
from ..functions.urls import absolute, canonical_url, host, is_bloglike, job_board, slug
from ..sources.staging import staged


def job_boards(links: DataFrame, known: DataFrame) -> DataFrame:
    """links(url, origin, at) -> (source_id, api, origin): job boards not known yet, the first link's origin wins."""
    hits = links.withColumn("board", job_board(F.col("url"))).where("board is not null").select("board.*", "origin", "at")
    first = hits.groupBy("source_id").agg(F.min_by(F.struct("api", "origin"), F.struct("at", "origin", "api")).alias("r"))
    return first.select("source_id", "r.*").join(known.select("source_id"), "source_id", "left_anti")


def cited_links(refs: DataFrame, links: DataFrame) -> DataFrame:
    """refs and links(url, origin, at): candidates' references first, then items' links, as one table in order."""
    first = refs.select("url", "origin", F.struct(F.lit(0).alias("part"), "at").alias("at"))
    return first.unionByName(links.select("url", "origin", F.struct(F.lit(1).alias("part"), "at").alias("at")))


def api_hosts(boards: DataFrame) -> DataFrame:
    """Hosts of job boards' interfaces: (host), to leave out of unmapped hosts."""
    return boards.select(host(F.col("api")).alias("host")).distinct()


def outside(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """rows(host, ...) whose host is none of domains(host) and lies under none: an equi-join of each host's ends, label by label."""
    labels = F.split("host", r"\.")
    ends = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    under = rows.select("host").distinct().select("host", F.explode(ends).alias("end")).join(domains.select(F.col("host").alias("end")), "end", "left_semi")
    return rows.join(under.select("host").distinct(), "host", "left_anti")


def discover(refs: DataFrame, links: DataFrame, sources: DataFrame, unmapped_: DataFrame, ignored: DataFrame, pages: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run: refs and links(url, origin, at), sources(source_id, url) and unmapped_(url) known so far, ignored(host), pages(url, html,
    error) as fetched -> (new sources(source_id, name, kind, url, provenance), new unmapped(url, feed, discovered_from), errors(message)).

    Job boards are found in references and links, the first one's origin wins. Then the references are taken in order: of each host
    that is not empty, ignored (with its subdomains), known, a new job board's, or named by an unmapped address, the first is
    fetched, at most `most` in all, failed ones included; if more are left the last error says so. A page that names a feed and
    looks like a blog is a source, unless its id is taken; any other is unmapped."""
    boards = job_boards(cited_links(refs, links), sources).withColumn("kind", F.lit("job_board"))
    known = sources.select(host(F.col("url")).alias("host")).unionByName(api_hosts(boards)).distinct()
    seen = unmapped_.select(canonical_url(F.col("url")).alias("canonical")).distinct()
    asked = refs.withColumn("host", host(F.col("url"))).where((F.col("host") != "") & job_board(F.col("url")).isNull())
    asked = asked.withColumn("canonical", canonical_url(F.col("url"))).join(seen, "canonical", "left_anti").join(known, "host", "left_anti")
    first = staged(outside(asked, ignored).groupBy("host").agg(F.min_by(F.struct("url", "origin", "at"), F.struct("at", "url", "origin")).alias("r")).select("host", "r.*"), "asked")
    fetched = first.orderBy("at", "host").limit(most).join(pages.select("url", "html", "error", F.lit(True).alias("there")), "url", "left")
    fetched = fetched.withColumn("error", F.when(F.col("there").isNull(), "not fetched").otherwise(F.col("error")))
    read = fetched.where("error is null").withColumns({"feed": absolute(F.col("url"), feed_link_column(F.col("html"))), "source_id": F.concat(F.lit("rss-"), slug(F.col("host")))})
    read = staged(read.withColumn("is_blog", F.col("feed").isNotNull() & is_bloglike(F.col("url"))), "read")
    own = read.where("is_blog").groupBy("source_id").agg(F.min_by(F.struct("host", "feed", "origin"), F.struct("at", "host")).alias("r"))
    own = own.join(sources.select("source_id").unionByName(boards.select("source_id")), "source_id", "left_anti")
    came = lambda c: F.concat(F.lit("discovered_from:"), c).alias("provenance")
    new = boards.select("source_id", F.col("source_id").alias("name"), "kind", F.col("api").alias("url"), came("origin"))
    new = new.unionByName(own.select("source_id", F.col("r.host").alias("name"), F.lit("rss").alias("kind"), F.col("r.feed").alias("url"), came(F.col("r.origin"))))
    rest = read.where("not is_blog").select("url", "feed", F.col("origin").alias("discovered_from"))
    failed = fetched.where("error is not null").select(F.concat_ws(": ", "url", "error").alias("message"))
    over = first.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(f"fetch cap {most} reached; remaining references skipped").alias("message"))
    return new, rest, failed.unionByName(over)


def unmapped(links: DataFrame, known_hosts: DataFrame, ignored: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """links(url, at) -> (host, url, bloglike): the first link to each host that is not empty, ignored (with its
    subdomains), known or a job board's; at most `most` hosts in link order."""
    rows = links.withColumn("host", host(F.col("url"))).where((F.col("host") != "") & job_board(F.col("url")).isNull())
    for h in ignored:
        rows = rows.where((F.col("host") != h) & ~F.col("host").endswith(f".{h}"))
    first = rows.groupBy("host").agg(F.min(F.struct("at", "url")).alias("r")).join(known_hosts.select("host"), "host", "left_anti")
    out = first.select("host", F.col("r.at").alias("at"), canonical_url(F.col("r.url")).alias("url"), is_bloglike(F.col("r.url")).alias("bloglike"))
    return out if most is None else out.orderBy("at", "host").limit(most)


def feeds(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, feed, source_id): the first RSS or Atom link that a page names as its alternate."""
    found = pages.select("url", feed_link_column(F.col("html")).alias("href")).where("href is not null")
    return found.select("url", absolute(F.col("url"), F.col("href")).alias("feed"), F.concat(F.lit("rss-"), slug(host(F.col("url")))).alias("source_id"))
