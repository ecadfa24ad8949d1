"""Is what was cited really there? Quotes against pages, figures against quotes, claims against evidence."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_column
from ..functions.money import amounts_column, decimals_column, figure_in_quote, figures_by_quote, figures_column, same_number, stated
from ..functions.quotes import holds, normal_column, normal_quote, states
from ..sources.staging import staged
from .candidates import words

MIN_QUOTE_WORDS = 3


def page_texts(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, normal): each page's text is extracted and brought to normal form once."""
    text = extract_column(F.col("html"), F.col("url"))["text"]
    return pages.select("url", normal_column(text).alias("normal"))


def _sought(quote: str, normal: bool) -> Column:
    return normal_quote(normal_column(F.col(quote))) if normal else F.col(quote)


def verify_quotes(quotes: DataFrame, pages: DataFrame, normal: bool = True) -> DataFrame:
    """quotes(url, quote, ...), pages(url, normal, ok) -> quotes with status, first rule first: quote_too_short,
    unfetchable (no such page, or not ok), verified, quote_not_found. With normal false, the column normal is the page's own text
    and a quote must stand in it character by character. Page text is shuffled once, by url."""
    q, is_in = quotes.withColumn("norm", _sought("quote", normal)), states if normal else holds
    status = (
        F.when(words(F.col("quote")) < MIN_QUOTE_WORDS, "quote_too_short").when(~F.coalesce("ok", F.lit(False)), "unfetchable")
        .when(is_in(F.col("normal"), F.col("norm")), "verified").otherwise("quote_not_found")
    )
    return q.join(pages, "url", "left").select(*quotes.columns, status.alias("status"))


def _led(by: str, texts: str) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(by), t))


#: What a text is cut into for the search: runs of letters and digits of ASCII, and every other character but white space by
#: itself. A quote that stands in a normal form from word boundary to word boundary has whole tokens there.
_TOKENS = {True: r"[0-9a-z]+|[^0-9a-z\s]", False: r"[0-9A-Za-z]+|[^0-9A-Za-z\s]"}
#: So many different strings of quotes, told apart by so many marks each, are sent to all tasks at most.
MOST_GRAMS, _MARKS_A_GRAM = 1 << 20, 16


def _grams(rows: DataFrame, key: str, tokens: str, sizes: list[int]) -> DataFrame:
    """(key, gram): hashes of the strings of as many tokens as any of the sizes, each once a row."""
    for n in sizes:
        rows = NGram(n=n, inputCol=tokens, outputCol=f"grams_{n}").transform(rows)
    hashed = lambda n: F.transform(f"grams_{n}", lambda g: F.xxhash64(F.lit(n), g))
    own = [hashed(n) for n in sizes]
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*own)))).alias("gram"))


def quote_search(quotes: DataFrame, texts: DataFrame, k: int = 4, normal: bool = True) -> DataFrame:
    """quotes(quote_id, quote), texts(text_id, text) -> (quote_id, text_id): which texts state which quotes, in normal form
    from word boundary to word boundary; or, with normal false, contain them character by character. Quotes under three words are
    no evidence and left out; equal quotes are looked for once.

    A quote's strings of k tokens, or of as many as it has, are counted over all texts, and its rarest one is the key it meets
    texts by; so a common word or phrase is no key as long as the quote holds a rarer one. Texts are read once for all lengths. As
    long as the quotes have at most MOST_GRAMS different strings, marks of these, as many bits as their number asks
    for, are sent to all tasks, and only strings with a mark are shuffled; beyond that the strings themselves are joined."""
    form = normal_column if normal else (lambda c: F.coalesce(c, F.lit("")))
    token = lambda c: F.regexp_extract_all(c, F.lit(_TOKENS[normal]), F.lit(0))
    said = normal_quote(form(F.col("quote"))) if normal else F.col("quote")
    asked = staged(quotes.where(words(F.col("quote")) >= MIN_QUOTE_WORDS).select("quote_id", said.alias("said")).where("said <> ''"), "quotes")
    own = asked.select("said").distinct().withColumn("tokens", token(F.col("said")))
    if not normal:  # without boundaries the first and the last token may go on in a text
        own = own.withColumn("tokens", F.slice("tokens", 2, F.size("tokens") - 2))
    own = own.withColumn("size", F.least(F.lit(k), F.size("tokens"))).where("size > 0")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # k at most
    if not sizes:
        return quotes.limit(0).join(texts.limit(0), F.lit(True)).select("quote_id", "text_id")
    grams = None
    for n in sizes:
        part = _grams(own.where(F.col("size") == n), "said", "tokens", [n])
        grams = part if grams is None else grams.unionByName(part)
    grams = staged(grams, "quote-grams")
    every = grams.select("gram").distinct()
    many = every.count()
    found = _grams(texts.select("text_id", token(form(F.col("text"))).alias("tokens")), "text_id", "tokens", sizes)
    if many <= MOST_GRAMS:
        bits = (many * _MARKS_A_GRAM).bit_length()
        mark = F.col("gram").bitwiseAND((1 << bits) - 1)
        found = found.withColumn("mark", mark).join(F.broadcast(every.select(mark.alias("mark")).distinct()), "mark", "left_semi").drop("mark")
    found = staged(found.join(every, "gram", "left_semi"), "text-grams")  # a table, so that the adaptive join can split a frequent string's rows
    often = found.groupBy("gram").agg(F.count("*").alias("n"))
    key = grams.join(often, "gram").groupBy("said").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    pairs = staged(found.join(key, "gram").select("text_id", "said"), "pairs")
    there = texts.join(pairs.select("text_id").distinct(), "text_id", "left_semi").select("text_id", form(F.col("text")).alias("form"))
    holds = states(F.col("form"), F.col("said")) if normal else F.col("form").contains(F.col("said"))
    met = pairs.join(there, "text_id").where(holds).select("text_id", "said")
    return met.join(asked, "said").select("quote_id", "text_id").distinct()


def figure_support(claims: DataFrame) -> DataFrame:
    """claims(value, kind, quote) with supported: the quote states the value as that kind of figure; and stated: as a plain
    number or percentage."""
    figs = claims.withColumn("figs", figures_column(F.col("quote")))
    return figs.withColumn("supported", figure_in_quote(F.col("value"), F.col("figs"), F.col("kind"))).withColumn(
        "stated", stated(F.col("value"), F.col("figs"))
    ).drop("figs")


def unsupported_amounts(rows: DataFrame, text: str, quotes: str, backed: str) -> DataFrame:
    """Adds unsupported: the amounts of `text`, with a currency or a magnitude, that no quote states, both ends in one quote, and
    no backed values equal at both ends. The scans run once a row, before the comparison."""
    rows = rows.withColumn("_said", amounts_column(F.col(text))).withColumn("_figs", figures_by_quote(F.col(quotes)))
    end = lambda x: F.exists(backed, lambda b: same_number(x, b))
    quoted = lambda a: F.exists("_figs", lambda f: figure_in_quote(a["low"], f, a["currency"]) & figure_in_quote(a["high"], f, a["currency"]))
    missing = F.filter("_said", lambda a: (a["currency"].isNotNull() | a["scaled"]) & ~quoted(a) & ~(end(a["low"]) & end(a["high"])))
    return rows.withColumn("unsupported", F.transform(missing, lambda a: a["text"])).drop("_said", "_figs")


def short_number(value: Column) -> Column:
    """A number with six digits that count, without zeros at its end."""
    plain = F.when(value == 0, "0").otherwise(F.format_string("%.6g", value))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def unsupported_numbers(rows: DataFrame, text: str, quotes: str, backed: str) -> DataFrame:
    """Adds unsupported_numbers: the decimals and percentages of `text` that no quote states and no backed value equals, as
    `value` or `value%`."""
    rows = rows.withColumn("_said", decimals_column(F.col(text))).withColumn("_figs", figures_column(F.array_join(quotes, "\n")))
    quoted = lambda n: F.when(n["percent"], figure_in_quote(n["value"] / 100, F.col("_figs"), F.lit("%"))).otherwise(stated(n["value"], F.col("_figs")))
    missing = F.filter("_said", lambda n: ~quoted(n) & ~F.exists(backed, lambda b: same_number(n["value"], b)))
    as_text = F.transform(missing, lambda n: F.concat(short_number(n["value"]), F.when(n["percent"], "%").otherwise("")))
    return rows.withColumn("unsupported_numbers", as_text).drop("_said", "_figs")


def unsupported_in(rows: DataFrame, texts: tuple[str, ...], quotes: str, backed: str) -> DataFrame:
    """Adds warnings: of several texts, the amounts and then the numbers that nothing supports, each as `column: what`."""
    parts = []
    for t in texts:
        rows = unsupported_amounts(rows, t, quotes, backed).withColumn(f"_a_{t}", _led(f"{t}: ", "unsupported")).drop("unsupported")
        rows = unsupported_numbers(rows, t, quotes, backed).withColumn(f"_n_{t}", _led(f"{t}: ", "unsupported_numbers")).drop("unsupported_numbers")
        parts.append(t)
    both = F.flatten(F.array(*[f"_a_{t}" for t in parts], *[f"_n_{t}" for t in parts]))
    return rows.withColumn("warnings", both).drop(*[f"_{k}_{t}" for k in "an" for t in parts])


def verified_fraction(works: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(problem_id, status) -> the verified share by problem, to two digits; of all problems, if given: 0 for those without works."""
    share = F.avg(F.when(F.col("status") == "verified", 1.0).otherwise(0.0))
    out = works.groupBy("problem_id").agg(F.coalesce(F.bround(share, 2), F.lit(0.0)).alias("verified_fraction"))
    if problems is None:
        return out
    return problems.select("problem_id").join(out, "problem_id", "left").select("problem_id", F.coalesce("verified_fraction", F.lit(0.0)).alias("verified_fraction"))


def interest_check(interests: DataFrame, files: DataFrame) -> DataFrame:
    """interests(profile_id, level, quote), files(profile_id, path, text) -> with kept_level: the level if it is none or the quote is a
    whole line of one of the profile's files, in normal form, else none."""
    lines = files.select("profile_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = lines.select("profile_id", F.trim(normal_column(F.col("line"))).alias("_line"), F.lit(True).alias("_is")).where("_line <> ''").distinct()
    j = interests.withColumn("_line", F.trim(normal_column(F.col("quote")))).join(lines, ["profile_id", "_line"], "left")
    kept = (F.col("level") == "none") | F.coalesce("_is", F.lit(False))
    return j.withColumn("kept_level", F.when(kept, F.col("level")).otherwise("none")).drop("_line", "_is")


def advantage_check(claims: DataFrame, files: DataFrame, self_rated: tuple[str, ...] | Column = (), normal: bool = True) -> DataFrame:
    """claims(path, quote, ...), files(path, text) -> claims with why_not (no profile file, short quote, not found, or null)
    and basis: self_rating if the file is one of self-ratings (paths, or a condition on the path), else profile. With normal false, quotes are looked for character by character."""
    texts = files.select("path", (normal_column(F.col("text")) if normal else F.coalesce("text", F.lit(""))).alias("normal"))
    q, is_in = claims.withColumn("norm", _sought("quote", normal)), states if normal else holds
    why = (
        F.when(F.col("normal").isNull(), "not a profile file").when(words(F.col("quote")) < MIN_QUOTE_WORDS, "quote too short")
        .when(~is_in(F.col("normal"), F.col("norm")), "quote not found")
    )
    rated = self_rated if isinstance(self_rated, Column) else F.col("path").isin(*self_rated)
    basis = F.when(rated, "self_rating").otherwise("profile")
    return q.join(texts, "path", "left").select(*claims.columns, why.alias("why_not"), F.when(why.isNull(), basis).alias("basis"))


def solution_check(solutions: DataFrame, top: DataFrame) -> DataFrame:
    """solutions(challenge_id, team, score, quote, verified), top(challenge_id, team, score) -> kept: its evidence is
    verified; score_kept: the quote states the score, or the leaderboard has the same team, in any case, with the same."""
    rows = solutions.withColumn("_figs", figures_column(F.col("quote"))).withColumn("_team", F.lower("team"))
    board = top.select("challenge_id", F.lower("team").alias("_team"), F.col("score").alias("_score")).distinct()
    board = board.groupBy("challenge_id", "_team").agg(F.collect_set("_score").alias("_scores"))
    on_board = F.coalesce(F.exists("_scores", lambda x: same_number(F.col("score"), x)), F.lit(False))
    out = rows.join(board, ["challenge_id", "_team"], "left").withColumns({
        "kept": F.col("verified"), "score_kept": F.col("verified") & (stated(F.col("score"), F.col("_figs")) | on_board),
    })
    return out.drop("_figs", "_team", "_scores")


def baseline_check(rows: DataFrame) -> DataFrame:
    """rows(value, quote, verified): none, evidence not verified, not stated, or accepted."""
    figs = rows.withColumn("_figs", figures_column(F.coalesce("quote", F.lit(""))))
    verdict = (
        F.when(F.col("value").isNull(), "none").when(~F.coalesce("verified", F.lit(False)), "evidence not verified")
        .when(~stated(F.col("value"), F.col("_figs")), "not stated").otherwise("accepted")
    )
    return figs.withColumn("baseline_check", verdict).drop("_figs")


def candidate_verified(rows: DataFrame, normal: bool = True) -> DataFrame:
    """rows(text, unsolved, evidence, ptype, pay_evidence) with verified: each required quote is stated in the item's text.
    The evidence is required if an unsolved signal is present, the payment's if a type is stated; an empty required quote
    is not stated, and without any the row counts as verified. With normal false, quotes are looked for character by character, and
    whether a text that is null states one is not known."""
    text, is_in = normal_column(F.col("text")) if normal else F.col("text"), states if normal else holds
    norm = rows.withColumns({"_text": text, "_q1": _sought("evidence", normal), "_q2": F.coalesce(_sought("pay_evidence", normal), F.lit(""))})
    asks = F.coalesce(F.col("ptype"), F.lit("none_stated")) != "none_stated"
    first = ~F.coalesce("unsolved", F.lit(False)) | is_in(F.col("_text"), F.col("_q1"))
    return norm.withColumn("verified", first & (~asks | is_in(F.col("_text"), F.col("_q2")))).drop("_text", "_q1", "_q2")


def wtp_check(rows: DataFrame) -> DataFrame:
    """rows(signal, quote, verification) of willingness to pay, quote and verification null if the evidence is out of range:
    adds check: evidence not verified, amount not in quote, or accepted."""
    rows = rows.withColumn("_quotes", F.array(F.coalesce("quote", F.lit("")))).withColumn("_none", F.array().cast("array<double>"))
    out = unsupported_amounts(rows, "signal", "_quotes", "_none")
    verdict = (
        F.when(~F.coalesce(F.col("verification") == "verified", F.lit(False)), "evidence not verified")
        .when(F.size("unsupported") > 0, "amount not in quote").otherwise("accepted")
    )
    return out.withColumn("check", verdict).drop("_quotes", "_none", "unsupported")


def backing(quotes: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """What an opportunity's numbers may rest on, by problem: quotes(problem_id, quote, verified) that are verified,
    fields(problem_id, text, inferred) that are stated and not inferred, and the ends of values(problem_id, low, high)."""
    told = quotes.where("verified").select("problem_id", F.col("quote").alias("text")).unionByName(fields.where("not inferred").select("problem_id", "text"))
    texts = told.groupBy("problem_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    ends = values.select("problem_id", F.array_compact(F.array("low", "high")).alias("numbers"))
    return texts.join(ends, "problem_id", "full").select(
        "problem_id", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), F.coalesce("numbers", F.array().cast("array<double>")).alias("numbers")
    )
