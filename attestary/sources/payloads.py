"""Fetched payloads to items. Each reader takes (source_id, url, body) and gives (source_id, url, title, published, text);
shapes that can't be read give no item and are listed by `unreadable`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import (
    embedded_column, extract_column, outline_column, plain_column, plain_list_column, region_column, sections_column, table_column, unescaped_column,
)
from ..functions.urls import absolute, slug, talk_url

_GREENHOUSE = "jobs array<struct<absolute_url string, title string, updated_at string, content string>>"
_LEVER = "array<struct<hostedUrl string, text string, createdAt bigint, openingPlain string, descriptionPlain string, additionalPlain string, lists array<struct<text string, content string>>>>"
_ASHBY = "jobs array<struct<jobUrl string, title string, publishedAt string, descriptionPlain string, isListed boolean>>"


def greenhouse(raw: DataFrame) -> DataFrame:
    jobs = raw.select("source_id", F.explode(F.from_json("body", _GREENHOUSE)["jobs"]).alias("j"))
    text = extract_column(unescaped_column(F.coalesce("j.content", F.lit(""))), F.col("j.absolute_url"))["text"]
    return jobs.where("j.absolute_url is not null").select(
        "source_id", F.col("j.absolute_url").alias("url"), F.coalesce("j.title", F.lit("")).alias("title"), F.col("j.updated_at").alias("published"), text.alias("text")
    )


def lever(raw: DataFrame) -> DataFrame:
    jobs = raw.select("source_id", F.explode(F.from_json("body", _LEVER)).alias("j")).where("j.hostedUrl is not null")
    contents = plain_list_column(F.col("j.lists.content"), F.col("j.hostedUrl"))
    lists = F.coalesce(F.zip_with("j.lists.text", contents, lambda t, c: F.concat_ws("\n", t, c)), F.array().cast("array<string>"))
    parts = F.filter(F.concat(F.array("j.openingPlain", "j.descriptionPlain"), lists, F.array("j.additionalPlain")), lambda p: p != "")
    published = F.date_format(F.timestamp_millis("j.createdAt"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return jobs.select(
        "source_id", F.col("j.hostedUrl").alias("url"), F.coalesce("j.text", F.lit("")).alias("title"), published.alias("published"),
                F.array_join(parts, "\n\n").alias("text")
    )


def ashby(raw: DataFrame) -> DataFrame:
    jobs = raw.select("source_id", F.explode(F.from_json("body", _ASHBY)["jobs"]).alias("j"))
    return jobs.where(F.coalesce("j.isListed", F.lit(True)) & F.col("j.jobUrl").isNotNull()).select(
        "source_id", F.col("j.jobUrl").alias("url"), F.coalesce("j.title", F.lit("")).alias("title"), F.col("j.publishedAt").alias("published"),
        F.coalesce("j.descriptionPlain", F.lit("")).alias("text"),
    )


def feed(raw: DataFrame, most: int) -> DataFrame:
    """RSS: the first `most` entries, then those without a link go. The text is what is visible of the content, or of the
    description; published before updated."""
    item = "struct<link string, title string, description string, `content:encoded` string, encoded string, pubDate string, updated string, `dc:date` string>"
    entries = raw.select("source_id", F.posexplode(F.from_xml("body", f"channel struct<item array<{item}>>")["channel"]["item"]).alias("pos",
            "e")).where(F.col("pos") < most)
    url, body = F.trim("e.link"), F.coalesce(F.col("e")["content:encoded"], F.col("e")["encoded"], F.col("e")["description"], F.lit(""))
    return entries.where("e.link is not null").select(
        "source_id", url.alias("url"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce(F.col("e")["pubDate"], F.col("e")["updated"],
                F.col("e")["dc:date"]).alias("published"),
        extract_column(body, url)["text"].alias("text"),
    )


READERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}


def items(raw: DataFrame) -> DataFrame:
    """raw(kind, source_id, url, body): every kind by its reader."""
    parts = [reader(raw.where(F.col("kind") == kind)) for kind, reader in READERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unreadable(raw: DataFrame) -> DataFrame:
    return raw.where(F.try_parse_json("body").isNull()).select("source_id", "url", F.lit("unreadable body").alias("error"))


def pages(raw: DataFrame, selector: str | None = None) -> DataFrame:
    """(url, html) -> (url, title, text, links); the title falls back to the URL. selector: only this part of a page is text;
    pages without it are left out and listed by `without_region`."""
    if selector is None:
        x = extract_column(F.col("html"), F.col("url"))
        return raw.select("url", x.alias("x")).select("url", F.coalesce(F.nullif("x.title", F.lit("")), "url").alias("title"), "x.text", "x.links")
    rows = raw.select("url", region_column(F.col("html"), F.col("url"), selector).alias("x")).where("x.found")
    return rows.select("url", F.coalesce(F.nullif("x.title", F.lit("")), "url").alias("title"), "x.text", "x.links")


def without_region(raw: DataFrame, selector: str) -> DataFrame:
    rows = raw.select("url", region_column(F.col("html"), F.col("url"), selector).alias("x")).where("not x.found")
    return rows.select("url", F.lit(f"{selector} fits nothing").alias("error"))


def grants(hits: DataFrame, details: DataFrame) -> DataFrame:
    """hits(source_id, id, title, agency, number, status, close_date), details(id, ceiling, funding, description) -> items
    whose text is a fixed block of fields; what is missing is empty."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda label, c: F.concat(F.lit(f"{label}: "), e(c))
    text = F.concat_ws("\n", field("Title", "title"), field("Agency", "agency"), field("Opportunity number", "number"), field("Status", "status"),
                       field("Close date", "close_date"), field("Award ceiling", "ceiling"), field("Estimated total funding", "funding"), F.lit(""),
                               e("description"))
    url = F.concat(F.lit("https://www.grants.gov/search-results-detail/"), "id")
    return hits.join(details, "id").select("source_id", url.alias("url"), e("title").alias("title"), text.alias("text"))


def dois(pages_: DataFrame) -> DataFrame:
    """(url, text) -> (url, pos, doi): distinct, in order of appearance, without closing marks."""
    found = F.regexp_extract_all("text", F.lit(r"\b10\.\d{4,9}/[^\s\"<>]+"), F.lit(0))
    clean = F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit(".,;)"))))
    return pages_.select("url", F.posexplode(clean).alias("pos", "doi"))


def abstracts(works_: DataFrame) -> DataFrame:
    """works(doi, inverted map<string, array<int>>) -> the abstract."""
    return works_.select("doi", abstract_text(F.col("inverted")).alias("abstract"))


_AUTHORS = "array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>"


def works(found: DataFrame, metadata: DataFrame, most: int = 30) -> DataFrame:
    """found(source_id, url, pos, doi), metadata(doi, body JSON) -> (items(source_id, url, title, published, text), missing(source_id, doi)):
    title, abstract and authors with their institutions; the first `most` DOIs of a page that have metadata."""
    read = metadata.select("doi", *[F.get_json_object("body", f"$.{c}").alias(c) for c in ("title", "publication_date")],
        F.from_json(F.get_json_object("body", "$.abstract_inverted_index"), "map<string,array<int>>").alias("inverted"),
        F.from_json(F.get_json_object("body", "$.authorships"), _AUTHORS).alias("authors"))
    own = F.transform(F.coalesce("authors", F.array().cast(_AUTHORS)), lambda a: F.concat(
        a["author"]["display_name"], F.lit(" ("), F.array_join(F.transform(F.coalesce(a["institutions"], F.array()), lambda i: i["display_name"]),
                ", "), F.lit(")")))
    said = abstract_text(F.col("inverted"))
    body = F.concat(F.when(said != "", F.concat(F.lit("Abstract: "), said)).otherwise("(no abstract)"), F.lit("\nAuthors: "), F.array_join(own, "; "))
    url = F.concat(F.lit("https://doi.org/"), "doi")
    met = found.join(read, "doi").select("source_id", F.col("url").alias("page"), "pos", url.alias("url"), F.coalesce("title", "doi").alias("title"),
            F.col("publication_date").alias("published"), body.alias("text"))
    w = Window.partitionBy("source_id", "page").orderBy("pos")
    items_ = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("page", "pos", "rank")
    return items_, found.join(read.select("doi"), "doi", "left_anti").select("source_id", "doi")


def abstract_text(inverted: Column) -> Column:
    """An abstract from words and their places."""
    at = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " "), F.lit(""))


def sections(raw: DataFrame, selector: str = "section", title: str = "h1, h2, h3, h4, h5, h6", most: int | None = None) -> DataFrame:
    """(source_id, url, html) -> an item for each part that the selector names and that has text: its address is the page's with
    its id, or else its heading's slug, as the parameter `talk`. most: the first so many of a page."""
    found = raw.select("source_id", F.col("url").alias("page"), F.posexplode(sections_column(F.col("html"), F.col("url"), selector, title)).alias("pos", "s"))
    found = found.withColumn("key", F.coalesce("s.id", slug(F.col("s.title")))).where("key <> '' and s.text <> ''")
    out = found.select("source_id", talk_url(F.col("page"), F.col("key")).alias("url"), "s.title", "s.text", "s.links", "page", "pos")
    if most is not None:
        w = Window.partitionBy("source_id", "page").orderBy("pos")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return out.drop("page", "pos")


def nested(raw: DataFrame, path: str) -> DataFrame:
    """(source_id, body JSON) -> (source_id, node JSON, at): what a dotted path leads to, `at` its place in the body; `*` goes to all elements
    of a list or all values of an object, missing keys lead nowhere, and a list at the end gives its elements."""
    rows = raw.select("source_id", F.col("body").alias("node"), F.array().cast("array<int>").alias("at"))
    as_list = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.map_values(F.from_json(c, "map<string, string>")))
    step_in = lambda r, c: r.select("source_id", "at", F.posexplode(c).alias("k", "node")).select("source_id", "node", F.concat("at",
            F.array("k")).alias("at"))
    for step in path.split("."):
        if step == "*":
            rows = step_in(rows, as_list(F.col("node")))
        else:
            rows = rows.select("source_id", F.get_json_object("node", f"$['{step}']").alias("node"), "at").where("node is not null")
    last = F.when(F.col("node").startswith("["), F.from_json("node", "array<string>")).otherwise(F.array("node"))
    return step_in(rows, last)


def session_items(raw: DataFrame, path: str, title: str, texts: tuple[str, ...], url_field: str | None = None, id_field: str | None = None,
                  date_field: str | None = None, embedded: str | None = None, most: int = 30) -> DataFrame:
    """(source_id, url, body) -> an item for each session at a path of a JSON body, or of the JSON in the part of a page that a selector
    names. Its address is a field's, seen from the page, or the page's with its id or its title's slug as the parameter
    `talk`. Its text is `field: value` for each text field with a value, HTML as what is visible of it. The first `most` of a page."""
    body = embedded_column(F.col("body"), embedded) if embedded else F.col("body")
    page = raw.select(F.struct("source_id", "url").alias("source_id"), body.alias("body"))
    s = nested(page, path).where(F.col("node").startswith("{"))
    get = lambda c: F.get_json_object("node", "$" + "".join(f"['{x}']" for x in c.split(".")))
    said = F.coalesce(get(title), F.lit(""))
    ident = F.coalesce(F.nullif(get(id_field), F.lit("")), slug(said)) if id_field else slug(said)
    base = F.col("source_id.url")
    own = talk_url(base, ident)
    url = F.when(F.coalesce(get(url_field), F.lit("")) != "", absolute(base, get(url_field))).otherwise(own) if url_field else own
    part = lambda c: F.when(~F.coalesce(get(c), F.lit("")).isin("", "[]"), F.concat(F.lit(f"{c}: "), plain_column(get(c), base)))
    rows = s.select(
        "source_id.source_id", F.col("source_id.url").alias("page"), "at", url.alias("url"), said.alias("title"),
        (get(date_field) if date_field else F.lit(None).cast("string")).alias("published"), F.concat_ws("\n", *map(part, texts)).alias("text"),
    )
    w = Window.partitionBy("source_id", "page").orderBy("at")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank", "page", "at")


def page_links(raw: DataFrame, selector: str = "a", pattern: str | None = None, below: str | None = None, marker: str | None = None,
        all_finished: bool = False) -> DataFrame:
    """(url, html) -> links(page, pos, href, text, heading_finished) of listing pages. A link is finished if a heading that `below`
    fits stands before it, `marker` fits its text, or all are; pattern: what addresses must fit."""
    rows = raw.select(F.col("url").alias("page"), outline_column(F.col("html"), F.col("url"), selector).alias("all"))
    ending = F.filter("all", lambda e: (e["kind"] == "heading") & e["text"].rlike(below)) if below else F.array()
    rows = rows.withColumn("ends", F.array_min(F.transform(ending, lambda e: e["pos"]))) if below else rows.withColumn("ends", F.lit(None).cast("int"))
    links = rows.select("page", "ends", F.explode(F.filter("all", lambda e: (e["kind"] == "link") & (e["href"].rlike(pattern) if pattern else F.lit(True)))).alias("l"))
    finished = F.lit(all_finished) | F.coalesce(F.col("l.pos") > F.col("ends"), F.lit(False)) | (F.col("l.text").rlike(marker) if marker else F.lit(False))
    return links.select("page", "l.pos", "l.href", "l.text", finished.alias("heading_finished"))


def listing_links(links: DataFrame, pattern: str, most: int, marker: str = "finished") -> DataFrame:
    """links(page, pos, href, text, heading_finished) -> child pages: those that match the pattern, once each by page, finished
    if any of their links says so or stands below a finished heading; at most `most` finished and `most` open ones."""
    own = links.where(F.col("href").rlike(pattern)).groupBy("page", "href").agg(
        F.min("pos").alias("pos"), F.bool_or(F.col("heading_finished") | F.lower("text").contains(marker)).alias("finished")
    )
    w = Window.partitionBy("page", "finished").orderBy("pos", "href")  # each task keeps its own first `most` before the shuffle
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page", "href", "finished")


_SCORE = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"


def leaderboard_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(challenge_id, html) of leaderboard pages -> (rows (challenge_id, pos, rank, team, score, is_baseline), bad (challenge_id, error)).

    Two layouts: columns #, Participants and a score column of class score-title, with rows titled Baseline; or rows with a
    data-rank, a column "Best private ..." and the team in bold in the third cell. Rows without a score are left out."""
    rows = raw.select("challenge_id", table_column(F.col("html")).alias("tr")).where(F.size("tr") > 0).withColumn("head", F.col("tr")[0]["cells"])
    rows = rows.select(
        "challenge_id", "tr",
        F.array_position(F.transform("head", lambda c: F.array_contains(c["classes"], "score-title")), True).alias("c"),
        F.array_position(F.transform("head", lambda c: c["text"]), "#").alias("r"),
        F.array_position(F.transform("head", lambda c: c["text"]), "Participants").alias("t"),
        F.array_position(F.transform("head", lambda c: c["text"].contains("Best private")), True).alias("p"),
    )
    first = (F.col("c") > 0) & (F.col("r") > 0) & (F.col("t") > 0)
    body = rows.where(first | (F.col("p") > 0)).select("challenge_id", "c", "r", "t", "p", first.alias("first"), F.posexplode(F.slice("tr", F.lit(2),
            F.size("tr"))).alias("pos", "row"))
    cell = lambda i: F.get("row.cells", F.col(i) - 1)
    said = F.when(F.col("first"), cell("c")["text"]).otherwise(cell("p")["text"])
    baseline = F.col("first") & F.array_contains("row.titles", "Baseline")
    name = F.when(F.col("first"), cell("t")["text"]).otherwise(F.get("row.cells", F.lit(2))["bold"])
    team = F.when(baseline, F.regexp_replace(name, r"^Baseline\s+", "")).otherwise(name)
    rank = F.when(F.col("first"), cell("r")["text"]).otherwise(F.col("row.data_rank"))
    out = body.select(
        "challenge_id", (F.col("pos") + 1).alias("pos"), F.when(rank.rlike(r"^\d{1,9}$"), rank).cast("int").alias("rank"), team.alias("team"),
        F.when(said.rlike(_SCORE), said.cast("double")).alias("score"), baseline.alias("is_baseline"), F.when(F.col("first"),
                rank.rlike(r"^\d+$")).otherwise(rank.isNotNull() & team.isNotNull()).alias("ranked"),
    )
    out = out.where(F.col("score").isNotNull() & (F.col("is_baseline") | F.col("ranked"))).drop("ranked")
    read = rows.where(first | (F.col("p") > 0)).select("challenge_id")
    return out, raw.join(read, "challenge_id", "left_anti").select("challenge_id", F.lit("no primary score column").alias("error"))


def atom(raw: DataFrame, most: int) -> DataFrame:
    """Atom: the first `most` entries, then those without a link go; content before summary, published before updated."""
    schema = "entry array<struct<title string, link array<struct<_href string>>, summary string, content string, published string, updated string>>"
    entries = raw.select("source_id", F.posexplode(F.from_xml("body", schema)["entry"]).alias("pos", "e")).where(F.col("pos") < most)
    link = F.get("e.link._href", 0)
    return entries.where(link.isNotNull()).select(
        "source_id", link.alias("url"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.published", "e.updated").alias("published"),
        plain_column(F.coalesce("e.content", "e.summary", F.lit("")), link).alias("text"),
    )
