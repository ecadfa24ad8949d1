"""Queries over payloads that are made of the given tables: pages, JSON bodies, session files, record files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import sessions, sources, value, verify
from ..sources import payloads, records
from ..sources.staging import spread, staging
from .bindings import bound, given, twin
from .catalog import query


def _tag(name, *inner, **attrs):
    """An element as text; attributes may be columns."""
    head = [F.lit(f"<{name}"), *[x for k, v in attrs.items() for x in (F.lit(f' {k.rstrip("_")}="'), v if not isinstance(v, str) else F.lit(v), F.lit('"'))], F.lit(">")]
    return F.concat(*head, *[x if not isinstance(x, str) else F.lit(x) for x in inner], F.lit(f"</{name}>"))


# ---- pages

_URL = "'https://p.example/' || p_partkey"


def _made_pages(spark, d):
    p = spread(given(spark, d, "part"))
    head = _tag("head", _tag("title", F.col("p_name")), "<style>x{}</style>")
    main = _tag("div", _tag("p", F.col("p_type")), F.col("p_brand"), _tag("a", "more", href=F.concat(F.lit("/x/"), "p_partkey", F.lit("#f"))), class_="main wide")
    body = _tag("body", _tag("nav", _tag("a", "home", href="/")), main, _tag("footer", "end"), _tag("p", "aside &amp; last"))
    html = F.concat(F.lit("<html>"), head, F.when(F.col("p_partkey") % 5 == 0, _tag("body", "bare")).otherwise(body), F.lit("</html>"))
    return p.select("p_partkey", F.concat(F.lit("https://p.example/"), "p_partkey").alias("url"), html.alias("html"))


@query(f"""SELECT {_URL} AS url, p_name AS title, CASE
  WHEN p_partkey % 5 = 0 THEN 'bare' ELSE p_type || chr(10) || p_brand || chr(10) || 'more' || chr(10) || 'aside & last' END AS text,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://p.example/x/' || p_partkey END AS links FROM part""")
def visible_text(spark, d):
    return payloads.pages(_made_pages(spark, d)).withColumn("links", F.array_join("links", " "))


@query(f"SELECT {_URL} AS url, p_name AS title, p_type || chr(10) || p_brand || chr(10) || 'more' AS text FROM part WHERE p_partkey % 5 <> 0")
def page_region(spark, d):
    """Only the part of a page that a selector names."""
    return payloads.pages(_made_pages(spark, d), "body .main").select("url", "title", "text")


@query(f"SELECT {_URL} AS url, 'body .main fits nothing' AS error FROM part WHERE p_partkey % 5 = 0")
def pages_without_region(spark, d):
    return payloads.without_region(_made_pages(spark, d), "body .main")


@query(f"""SELECT {_URL} AS url, CASE WHEN p_partkey % 7 = 0 THEN 'quote_too_short'
  WHEN p_partkey % 5 = 0 OR p_partkey % 3 <> 0 THEN 'quote_not_found' ELSE 'verified' END AS status
 FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT {_URL}, CASE WHEN p_partkey % 7 = 0 THEN 'quote_too_short' ELSE 'unfetchable' END
   FROM part WHERE p_partkey % 11 = 0""")
def verify_page_quotes(spark, d):
    """Quotes in other marks and capitals against made pages: some short, some of other pages, some pages not there."""
    pages = _made_pages(spark, d)
    texts = verify.page_texts(pages.select("url", "html")).withColumn("ok", F.lit(True)).join(pages.where("p_partkey % 11 <> 0").select("url"), "url", "left_semi")
    k = F.col("p_partkey")
    said = F.when(k % 7 == 0, "too short").when(k % 3 == 0, F.concat(F.lit("**"), F.upper("p_type"), F.lit("**  "), "p_brand",
            F.lit(" more."))).otherwise("words of another page")
    quotes = given(spark, d, "part").select(F.concat(F.lit("https://p.example/"), k).alias("url"), said.alias("quote"))
    return verify.verify_quotes(quotes, texts).select("url", "status")


_OLD = "o_orderdate < DATE '1996-01-01'"


@query(f"""WITH l AS (SELECT 'https://c.example/' || o_custkey AS page, 'https://c.example/c/' || o_orderkey AS href, {_OLD} OR o_orderstatus = 'F' AS finished,
   row_number() OVER (PARTITION BY o_custkey ORDER BY {_OLD}, o_orderkey) AS pos FROM orders)
 SELECT page, href, finished FROM l QUALIFY row_number() OVER (PARTITION BY page, finished ORDER BY pos) <= 3""")
def listing_pages(spark, d):
    """Listing pages from HTML: what stands below a heading, or says so itself, is finished."""
    o = given(spark, d, "orders").withColumn("old", F.expr(_OLD))
    link = _tag("li", _tag("a", F.when(F.col("o_orderstatus") == "F", "It has ended").otherwise("Open"), href=F.concat(F.lit("/c/"), "o_orderkey",
            F.lit("#top"))), _tag("a", "other", href="/about"), class_="entry")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("old", "o_orderkey", link.alias("li")))).alias("rows"))
    part = lambda old: F.array_join(F.transform(F.filter("rows", lambda r: r["old"] == old), lambda r: r["li"]), "")
    html = F.concat(F.lit("<h2>Now</h2><ul>"), part(False), F.lit("</ul><h2>Past <i>ones</i></h2><ul>"), part(True), F.lit("</ul>"))
    raw = spread(rows).select(F.concat(F.lit("https://c.example/"), "o_custkey").alias("url"), html.alias("html"))
    links = payloads.page_links(raw, selector="li.entry a", pattern="/c/", below="^Past", marker="ended$")
    return payloads.listing_links(links, "/c/", 3, marker="has ended")


# ---- JSON bodies

_TALK = """CASE p_partkey % 3 WHEN 0 THEN 'https://t.example/t/' || p_partkey WHEN 1 THEN 'https://t.example/day?talk=k' || p_partkey
 ELSE 'https://t.example/day?talk=' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END"""


@query(f"SELECT 't' AS source_id, {_TALK} AS url, p_name AS title, 'M' || p_size AS published, 'text: ' || p_type || chr(10) || 'speaker.org: ' || p_brand AS text FROM part")
def items_from_talks(spark, d):
    """Sessions of JSON that is embedded in a page, to items."""
    p, k = spread(given(spark, d, "part")), F.col("p_partkey") % 3
    talk = F.struct(F.col("p_name").alias("name"), F.when(k == 0, F.concat(F.lit("/t/"), "p_partkey")).alias("link"), F.when(k == 1,
            F.concat(F.lit("k"), "p_partkey")).alias("ref"),
        F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("text"), F.struct(F.col("p_brand").alias("org")).alias("speaker"), F.concat(F.lit("M"),
                "p_size").alias("day"))
    body = F.concat(F.lit('<p>x</p><script id="data" type="application/json">'),
            F.to_json(F.struct(F.struct(F.struct(F.array(talk).alias("talks")).alias("mon")).alias("days"))), F.lit("</script>"))
    raw = p.select(F.lit("t").alias("source_id"), F.lit("https://t.example/day").alias("url"), body.alias("body"), "p_partkey")
    raw = raw.select("source_id", F.concat("url", F.lit("#"), "p_partkey").alias("url"), "body")  # pages of their own, so the limit is by page
    out = payloads.session_items(raw, "days.*.talks", "name", ("text", "speaker.org"), url_field="link", id_field="ref", date_field="day", embedded="script#data")
    return out.withColumn("url", F.regexp_replace("url", "#[0-9]+", ""))


@query("""SELECT 'w' AS source_id, 'https://doi.org/10.1234/a' || p_partkey AS url, CASE
  WHEN p_partkey % 3 = 0 THEN '10.1234/a' || p_partkey ELSE p_name END AS title, '2024-01-02' AS published,
 CASE WHEN p_partkey % 5 = 0 THEN '(no abstract)' ELSE 'Abstract: ' || p_type END || chr(10) || 'Authors: ' || p_brand || ' (' || 'M' || p_size || ', Lab)' AS text FROM part WHERE p_partkey % 4 <> 0""")
def items_from_works(spark, d):
    p = given(spark, d, "part")
    found = p.select(F.lit("w").alias("source_id"), "p_partkey", F.concat(F.lit("10.1234/a"), "p_partkey").alias("doi"))
    words = F.split("p_type", " ")
    inverted = F.map_from_arrays(words, F.transform(words, lambda w, i: F.array(i)))
    org = lambda c: F.struct(c.alias("display_name"))
    author = F.struct(org(F.col("p_brand")).alias("author"), F.array(org(F.concat(F.lit("M"), "p_size")), org(F.lit("Lab"))).alias("institutions"))
    body = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.lit("2024-01-02").alias("publication_date"),
        F.when(F.col("p_partkey") % 5 != 0, inverted).alias("abstract_inverted_index"), F.array(author).alias("authorships")))
    metadata = p.where("p_partkey % 4 <> 0").select(F.concat(F.lit("10.1234/a"), "p_partkey").alias("doi"), body.alias("body"))
    pages = found.select("source_id", F.col("p_partkey").cast("string").alias("url"), F.lit(0).alias("pos"), "doi")
    return payloads.works(pages, metadata)[0].select("source_id", "url", "title", "published", "text")


@query("""SELECT 'f' AS source_id, 'https://f.example/' || p_partkey AS url, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Mon' ELSE 'Tue' END AS published,
 CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || p_brand ELSE p_brand END AS text FROM part""")
def feed_contents(spark, d):
    """Feeds whose entries have content in HTML or a description only, and one date or the other."""
    k = F.col("p_partkey") % 2 == 0
    esc = lambda c: F.concat(F.lit("&lt;p&gt;"), c, F.lit("&lt;/p&gt;"))
    content = F.when(k, _tag("encoded", esc(F.col("p_type")), esc(F.col("p_brand")))).otherwise("")
    dates = F.when(k, "<pubDate>Mon</pubDate><updated>Tue</updated>").otherwise("<updated>Tue</updated>")
    item = _tag("item", _tag("link", F.concat(F.lit("https://f.example/"), "p_partkey")), _tag("title", F.col("p_name")), _tag("description",
            esc(F.col("p_brand"))), content, dates)
    raw = spread(given(spark, d, "part")).select(F.lit("f").alias("source_id"), _tag("rss", _tag("channel", item)).alias("body"))
    return payloads.feed(raw, 5)


# ---- leaderboards of the other layout

@query(twin("board") + " SELECT challenge_id, pos::INT AS pos, pos::INT AS rank, team, round_even(score, 3) AS score, false AS is_baseline FROM board WHERE pos % 4 <> 0 AND challenge_id % 9 <> 0")
def leaderboard_rows_private(spark, d):
    b = bound(spark, d, "board")
    tr = F.concat(F.when(F.col("pos") % 4 == 0, F.lit("<tr>")).otherwise(F.concat(F.lit('<tr data-rank="'), "pos", F.lit('">'))), _tag("td",
            F.col("pos").cast("string")), _tag("td", ""),
        _tag("td", _tag("span", F.col("team"), class_="x fw-bold"), " and others"), _tag("td", F.format_string("%.3f", F.bround("score", 3))), F.lit("</tr>"))
    rows = b.groupBy("challenge_id").agg(F.array_sort(F.collect_list(F.struct("pos", tr.alias("tr")))).alias("rows"))
    last = F.when(F.col("challenge_id") % 9 == 0, "Public score").otherwise("Best private score")
    html = F.concat(F.lit("<table><thead><tr>"), _tag("th", "Rank"), _tag("th", ""), _tag("th", "Team"), _tag("th", last),
            F.lit("</tr></thead><tbody>"), F.array_join("rows.tr", ""), F.lit("</tbody></table>"))
    return payloads.leaderboard_rows(rows.select("challenge_id", html.alias("html")))[0]


# ---- sessions as files of JSON lines

def _lines(spark, d):
    s, k = bound(spark, d, "sessions"), F.col("line_no") % 4
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("b"), "line_no").alias("id"), F.col("tool").alias("name"),
            F.struct(F.col("text").alias("query")).alias("input"))
    back = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("b"), F.col("line_no") - 1).alias("tool_use_id"), F.when(k != 2,
            "output provided successfully").otherwise("bad input").alias("content"))
    message = lambda kind, b: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(b).alias("content")).alias("message")))
    line = F.when(F.col("role") == "assistant", message("assistant", call)).when(F.col("role") == "user", message("user", back)).otherwise("no JSON at all")
    return sessions.session_lines(s.select("session_id", "line_no", line.alias("line")))


@query(twin("sessions") + """ SELECT session_id, count_if(tool = 'WebSearch') AS searches, count_if(tool = 'WebFetch') AS fetches,
  coalesce(string_agg(text, '|' ORDER BY line_no) FILTER (tool = 'WebSearch'), '') AS queries,
 count_if(tool = 'WebSearch') >= 1 AS sufficient FROM sessions WHERE role = 'assistant' GROUP BY 1""")
def session_file_searches(spark, d):
    return sessions.search_summary(sessions.tool_calls(_lines(spark, d))).withColumn("queries", F.array_join("queries", "|"))


@query(twin("sessions") + """ SELECT a.session_id, arg_max(a.text, a.line_no) AS value FROM sessions a
  JOIN sessions u ON u.session_id = a.session_id AND u.line_no = a.line_no + 1
 WHERE a.role = 'assistant' AND u.role = 'user' AND u.line_no % 4 <> 2 GROUP BY 1""")
def session_file_output(spark, d):
    lines = _lines(spark, d)
    outputs = sessions.tool_calls(lines).withColumn("value", F.col("query"))
    return sessions.accepted_output(outputs, sessions.accepted_blocks(lines))


@query("""SELECT user_id AS session_id, sum(event_id % 100 + event_id % 7)::BIGINT AS input_tokens, sum(event_id % 50)::BIGINT AS output_tokens,
 round_even(sum((event_id % 8) / 4.0), 4) AS cost, round_even(sum(event_id % 1000) / 1000, 1) AS seconds FROM events GROUP BY 1""")
def session_file_usage(spark, d):
    e = F.col("event_id")
    usage = F.struct((e % 100).alias("input_tokens"), (e % 7).alias("cache_read_input_tokens"), (e % 50).alias("output_tokens"))
    line = F.to_json(F.struct(F.lit("result").alias("type"), usage.alias("usage"), ((e % 8) / 4.0).alias("total_cost_usd"), (e % 1000).alias("duration_ms")))
    raw = given(spark, d, "events").select(F.col("user_id").alias("session_id"), e.alias("line_no"), line.alias("line"))
    return sessions.usage(sessions.session_results(sessions.session_lines(raw))).withColumn("cost", F.round("cost", 4))


# ---- record files

@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'unreadable' WHEN s_suppkey % 5 = 0 THEN 'missing: name' END AS message, CASE
  WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN s_name END AS name FROM supplier""")
def load_records(spark, d):
    """A folder of record files, JSON and YAML, to typed rows and a list of what can't be read."""
    path, s = staging(spark, "records"), given(spark, d, "supplier")
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("name")))
    as_yaml = F.concat(F.lit("# a record\nid: "), "s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("\nname: "), "s_name")).otherwise(""))
    text = F.when(F.col("s_suppkey") % 7 == 0, "{no: record: at all").when(F.col("s_suppkey") % 2 == 0, as_yaml).otherwise(record)
    files = spread(s).select(text.alias("value"), F.col("s_suppkey").alias("file")).write.partitionBy("file")
    files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks put their files in place, not the driver one by one
    good, bad = records.read_records(spark, f"{path}/*", "id bigint, name string", ("id", "name"))
    number = lambda c: F.regexp_extract(c, "file=([0-9]+)", 1).cast("long")
    none = F.lit(None).cast("string")
    return good.select("id", none.alias("message"), "name").unionByName(bad.select(number("file").alias("id"), "message", none.alias("name")))


# ---- reports and checks

@query("""WITH r AS (SELECT 'src-' || user_id AS source_id, CASE event_type WHEN 'error' THEN 'item_error' WHEN 'signup' THEN 'new'
  WHEN 'click' THEN 'changed' WHEN 'purchase' THEN 'filtered' ELSE 'unchanged' END AS outcome,
   event_id % 5 = 0 AS truncated, event_id % 7 = 0 AS finished FROM events WHERE event_id % 3 <> 0),
 o AS (SELECT source_id, count_if(outcome = 'new') AS new, count_if(outcome = 'changed') AS changed, count_if(outcome = 'unchanged') AS unchanged,
   count_if(outcome = 'filtered') AS filtered,
   count_if(truncated AND outcome IN ('new', 'changed', 'unchanged')) AS truncated, count_if(outcome = 'item_error') AS item_errors,
     count_if(finished AND outcome IN ('new', 'changed', 'unchanged')) AS finished FROM r GROUP BY 1),
 e AS (SELECT 'src-' || user_id AS source_id, min('E' || event_id) AS error FROM events WHERE event_id % 30 = 0 GROUP BY 1)
 SELECT source_id, coalesce(new, 0) AS new, coalesce(changed, 0) AS changed, coalesce(unchanged, 0) AS unchanged, coalesce(filtered, 0) AS filtered,
   coalesce(truncated, 0) AS truncated,
  coalesce(item_errors, 0) AS item_errors, coalesce(finished, 0) AS finished, error FROM o FULL JOIN e USING (source_id)""")
def scan_report(spark, d):
    e = given(spark, d, "events").withColumn("source_id", F.concat(F.lit("src-"), "user_id"))
    t = F.col("event_type")
    outcome = F.when(t == "error", "item_error").when(t == "signup", "new").when(t == "click", "changed").when(t == "purchase", "filtered").otherwise("unchanged")
    results = e.where("event_id % 3 <> 0").select("source_id", outcome.alias("outcome"), (F.col("event_id") % 5 == 0).alias("truncated"),
            (F.col("event_id") % 7 == 0).alias("finished"))
    return sources.scan_report(results, e.where("event_id % 30 = 0").select("source_id", F.concat(F.lit("E"), "event_id").alias("error")))


@query(twin("problem_sources") + """ SELECT problem_id, pos, CASE WHEN l_linenumber % 4 = 0 THEN floor(l_extendedprice / 1000) * 1000.0
  WHEN l_linenumber % 4 = 1 THEN l_quantity * 1e6 ELSE l_quantity * 1000.0 END AS low,
 CASE WHEN l_linenumber % 4 = 0 THEN floor(l_extendedprice / 1000) * 1000.0 WHEN l_linenumber % 4 = 1 THEN l_quantity * 1e6 ELSE l_quantity * 1000.0 END AS high,
 CASE WHEN l_linenumber % 4 = 0 THEN 'USD' WHEN l_linenumber % 4 = 1 THEN 'GBP' WHEN source_id LIKE 'grants-gov-%' THEN 'USD'
   WHEN source_id LIKE 'aria-%' THEN 'GBP' END AS currency,
 replace(stated, 'Award ceiling: ', '') AS text, l_linenumber % 4 < 2 AS scaled FROM problem_sources WHERE stated <> '' AND l_linenumber % 4 <> 3""")
def stated_amounts(spark, d):
    found = money.amounts_column(F.col("stated"), value.default_currency(F.col("source_id")))
    return bound(spark, d, "problem_sources").select("problem_id", "pos", F.explode(found).alias("a")).select("problem_id", "pos", "a.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_linenumber % 3 <> 0 AND NOT (l_linenumber % 2 = 0
  AND abs(l_discount - l_quantity / 100) < 1e-9) THEN 'claim: ' || CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(printf('%.2f', l_discount), '0') END END,
 CASE WHEN l_linenumber % 2 <> 0 THEN 'claim: ' || l_quantity::BIGINT || '%' END) AS warnings FROM lineitem""")
def unsupported_numbers(spark, d):
    """Decimals and percentages of a claim that neither a quote states nor an earlier record holds."""
    percent = F.concat(F.col("l_quantity").cast("long"), F.lit("%"))
    rows = given(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("a gain of "), F.format_string("%.2f", "l_discount"), F.lit(" in 30 years, "), percent).alias("claim"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.concat(F.lit("it is "), percent))).otherwise(F.array(F.lit("none"))).alias("quotes"),
        F.when(F.col("l_linenumber") % 3 == 0, F.array("l_discount")).otherwise(F.array().cast("array<double>")).alias("backed"))
    out = verify.unsupported_in(rows, ("claim",), "quotes", "backed")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 2 = 0 AND length(trim(split_part(coalesce(text, ''),
  chr(10), 1))) > 0 THEN 'strong' ELSE 'none' END AS kept_level FROM documents""")
def interest_check(spark, d):
    """An interest counts only if its quote is a whole line of one of the profile's files."""
    docs = given(spark, d, "documents").select("doc_id", F.col("source").alias("profile_id"), F.col("doc_id").alias("path"), "text")
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    quote = F.when(F.col("doc_id") % 2 == 0, line).otherwise(F.concat(F.lit("not a line: "), line))
    asked = docs.select("doc_id", "profile_id", F.when(F.col("doc_id") % 3 == 0, "none").otherwise("strong").alias("level"), quote.alias("quote"))
    return verify.interest_check(asked, docs).select("doc_id", "kept_level")
