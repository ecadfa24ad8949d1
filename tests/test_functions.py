import pytest
from pyspark.sql import functions as F

from attestary.functions import html, money, quotes, urls


def amounts(text, default=None):
    return [(low, high, currency) for low, high, currency, _, _ in money.amounts(text, default)]


@pytest.mark.parametrize(("text", "expected"), [
    ("a seed round of $7.25M", [(7.25e6, 7.25e6, "USD")]),
    ("almost £36m in all", [(3.6e7, 3.6e7, "GBP")]),
    ("between €91,000 – €118,500 EUR", [(91e3, 118.5e3, "EUR")]),
    ("$6.2-7.8bn", [(6.2e9, 7.8e9, "USD")]),
    ("12 billion euros", [(1.2e10, 1.2e10, "EUR")]),
    ("from 22 to 31 mn", [(2.2e7, 3.1e7, None)]),
    ("€4.250.000 paid", [(4.25e6, 4.25e6, "EUR")]),
    ("GBP 640 or usd 9k", [(640.0, 640.0, "GBP"), (9e3, 9e3, "USD")]),
    ("5 USD 6", [(5.0, 5.0, "USD")]),
    ("since 1998 all 34 crews", []),
    ("the 22nd of 41, 3.5 percent", []),
    ("6.1e-4 M per litre", []),
    ("8m, then x_usd 8", [(8e6, 8e6, None)]),
    ("", []), (None, []),
])
def test_amounts(text, expected):
    assert amounts(text) == expected


def test_default_currency_only_where_none_is_stated():
    assert amounts("up to 73,400 a team", "USD") == [(73.4e3, 73.4e3, "USD")]
    assert amounts("€8k", "USD") == [(8e3, 8e3, "EUR")]


def test_decimals():
    assert money.decimals("In 2019 the 3rd run rose 4.75 points, or 18 % and 2.5percent; v2.7_1 of x3.1 is 6.") == [(4.75, False), (18.0, True), (2.5, True)]
    assert money.decimals(None) == []


def test_figures(spark):
    rows = spark.createDataFrame(
        [(0.642, None, "64.2%"), (70.0, None, "0.7"), (0.29, "%", "some 29% of it"), (0.29, "%", "0.29 of all"), (60.0, "USD", "$600"),
         (9e6, "USD", "$7.5-9.0m"), (9e6, "GBP", "$7.5-9.0m")], "value double, kind string, quote string")
    figs = rows.withColumn("f", money.figures_column(F.col("quote")))
    got = figs.select(money.figure_in_quote(F.col("value"), F.col("f"), F.col("kind")).alias("a"), money.stated(F.col("value"), F.col("f")).alias("b")).collect()
    assert [r.a for r in got] == [False, False, True, True, False, True, False]
    assert [r.b for r in got] == [True, False, True, True, False, True, True]


@pytest.mark.parametrize(("quote", "text", "found"), [
    ("“Hello” world", 'say "hello"  world now', True),
    ("lasts 30", "it lasts 300 days", False),
    ("lasts 30.", "it lasts 30, at most", True),
    ("the **bold** word", "The bold word", True),
    ("ends here", "it ends\nhere .", True),
    ("...", "...", False),
    (r"a\Eb c", r"x a\eb c y", True),
])
def test_quotes(spark, quote, text, found):
    row = spark.createDataFrame([(quote, text)], "q string, t string")
    q = quotes.normal_quote(quotes.normal_column(F.col("q")))
    assert row.select(quotes.normal_column(F.col("t")).alias("n"), q.alias("q")).select(quotes.states(F.col("n"), F.col("q"))).first()[0] is found


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTPS://A.example/x/?utm_source=z&id=3#frag", "https://a.example/x?id=3"),
    ("https://a.example", "https://a.example/"),
    ("https://a.example/x?a&b=1 2&UTM_x=1", "https://a.example/x?a=&b=1+2"),
    ("https://a.example/?q=%zz~*", "https://a.example/?q=%25zz~%2A"),
    ("mailto:x@y", "mailto:x@y"), (None, None),
])
def test_canonical_url(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical_url(F.col("u"))).first()[0] == expected


def test_html():
    got = html.extract(
        '<html><head><title>A  title</title><style>x</style></head><body><nav><a href="/n">n</a></nav><p>One <b>two</b>'
        '<p>three<script>s()</script><a href="b#c">l</a><a href="b">l</a><a href="mailto:x">m</a></body>', "https://x.example/a/"
    )
    assert got == {"title": "A title", "text": "One\ntwo\nthree\nl\nl\nm", "links": ["https://x.example/a/b"]}
    assert html.extract(None) == {"title": "", "text": "", "links": []}


def test_job_board(spark):
    rows = spark.createDataFrame([("https://jobs.lever.co/Acme/1",), ("https://x.example/",)], "u string")
    got = [r[0] for r in rows.select(urls.job_board(F.col("u"))).collect()]
    assert got[0].source_id == "lever-acme" and got[1] is None
