"""The funnel: problems with all later stages, what is stale or waiting, filters, sorts, pages and the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ordering import numbered, slice_of


def funnel(problems: DataFrame, novelty: DataFrame, values: DataFrame, fits: DataFrame, opportunities: DataFrame, digest: Column) -> DataFrame:
    """One row for each problem. digest: the current profile's, by problem; fit_stale is null without a fit.
    waiting names the stages that a problem has not been through; an opportunity is waited for only where there is a fit."""
    j = (
        problems.select("problem_id", "revision", "statement")
        .join(novelty.select("problem_id", F.col("revision").alias("novelty_revision"), F.col("status").alias("novelty")), "problem_id", "left")
        .join(values.select("problem_id", F.col("revision").alias("value_revision"), "low", "high"), "problem_id", "left")
        .join(fits.select("problem_id", F.col("revision").alias("fit_revision"), F.col("score").alias("fit"), "problem_revision", "profile_digest"), "problem_id", "left")
        .join(opportunities.drop("revision"), "problem_id", "left")
    )
    missing = lambda c, name: F.when(F.col(c).isNull(), name)
    return j.withColumns({
        "fit_stale": F.when(F.col("fit_revision").isNotNull(), (F.col("problem_revision") != F.col("revision")) | (F.col("profile_digest") != digest)),
        "waiting": F.array_compact(F.array(missing("novelty", "novelty"), missing("value_revision", "economic value"), missing("fit_revision", "fit"),
            F.when(F.col("fit_revision").isNotNull(), missing("opportunity_id", "opportunity")))),
        "stale": stale_inputs(),
    })


def stale_inputs() -> Column:
    """Names of an opportunity's inputs that changed since: null to a value is a change."""
    changed = lambda recorded, now, name: F.when(~F.col(recorded).eqNullSafe(F.col(now)), name)
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(
        changed("in_problem", "revision", "problem"), changed("in_fit", "fit_revision", "fit"), changed("in_fit_score", "fit", "fit"),
        changed("in_novelty", "novelty_revision", "novelty"), changed("in_value", "value_revision", "economic value"),
    ))))
    return F.when(F.col("opportunity_id").isNotNull(), names)


def opportunity_stale(opportunities: DataFrame, problems: DataFrame, novelty: DataFrame, values: DataFrame, fits: DataFrame) -> DataFrame:
    """(problem_id, stale): changed inputs, or that the problem or the fit is gone."""
    one = lambda d, c, n: d.select("problem_id", F.col(c).alias(n))
    j = opportunities.join(one(problems, "revision", "revision"), "problem_id", "left").join(one(novelty, "revision", "novelty_revision"), "problem_id", "left")
    j = j.join(one(values, "revision", "value_revision"), "problem_id", "left")
    j = j.join(fits.select("problem_id", F.col("revision").alias("fit_revision"), F.col("score").alias("fit")), "problem_id", "left")
    gone = F.col("revision").isNull() | F.col("fit_revision").isNull()
    return j.select("problem_id", F.when(gone, F.array(F.lit("problem or fit removed"))).otherwise(stale_inputs()).alias("stale"))


def problem_filter(rows: DataFrame, q: str | None = None, has_fit: bool | None = None, fit_min: int | None = None, novelty=None, stale: bool | None = None,
                   waiting: str | None = None, tier: str | None = None, recommendation: str | None = None) -> DataFrame:
    """The funnel's rows that fit all that is asked: words in id or statement, with or without a fit, its least score, novelty
    (one or several), anything stale or not, a stage waited for, best tier, recommendation."""
    if q:
        rows = rows.where(F.lower(F.concat_ws(" ", "problem_id", "statement")).contains(q.lower()))
    if has_fit is not None:
        rows = rows.where(F.col("fit").isNotNull() == has_fit)
    if fit_min is not None:
        rows = rows.where(F.col("fit") >= fit_min)
    if novelty:
        rows = rows.where(F.col("novelty").isin(*([novelty] if isinstance(novelty, str) else novelty)))
    if stale is not None:
        rows = rows.where((F.coalesce("fit_stale", F.lit(False)) | F.coalesce(F.size("stale") > 0, F.lit(False))) == stale)
    for column, value in (("best_tier", tier), ("recommendation", recommendation)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows if waiting is None else rows.where(F.array_contains("waiting", waiting))


def problem_order(by: str) -> list[Column]:
    """Orders of problems: sources (most first, then tier), tier (then most sources), fit, value (each greatest first, none last), id."""
    rank, many, name = F.col("best_tier").asc_nulls_last(), F.col("n_sources").desc_nulls_last(), F.col("problem_id").asc()
    return {
        "sources": [many, rank, name], "tier": [rank, many, name], "fit": [F.col("fit").desc_nulls_last(), name],
        "value": [F.col("high").desc_nulls_last(), name], "id": [name],
    }[by]


def fit_list(fits: DataFrame, problems: DataFrame, digest: Column) -> tuple[DataFrame, list[Column]]:
    """(fits with the problem's statement and whether they are stale, their order): one whose problem is gone is stale."""
    j = fits.join(problems.select("problem_id", "statement", F.col("revision").alias("_now")), "problem_id", "left")
    stale = F.col("_now").isNull() | (F.col("problem_revision") != F.col("_now")) | (F.col("profile_digest") != digest)
    rows = j.select("problem_id", "score", stale.alias("stale"), F.coalesce("statement", F.lit("(problem removed)")).alias("statement"))
    return rows, [F.col("score").desc_nulls_last(), F.col("problem_id").asc()]


def opportunity_order() -> list[Column]:
    rank = F.when(F.col("recommendation") == "investigate", 0).when(F.col("recommendation") == "contact", 1).otherwise(2)
    return [rank, F.col("opportunity_id").asc()]


def opportunity_view(opportunities: DataFrame, stale: DataFrame, problems: DataFrame, q: str | None = None, recommendation: str | None = None, is_stale: bool | None = None) -> DataFrame:
    """Opportunities with the statement of their problem and what is stale, filtered."""
    rows = opportunities.join(stale.select("problem_id", "stale"), "problem_id", "left").join(problems.select("problem_id", "statement"), "problem_id", "left")
    if q:
        rows = rows.where(F.lower(F.concat_ws(" ", "opportunity_id", "problem_id", "statement")).contains(q.lower()))
    rows = rows if recommendation is None else rows.where(F.col("recommendation") == recommendation)
    return rows if is_stale is None else rows.where((F.coalesce(F.size("stale"), F.lit(0)) > 0) == is_stale)


def investigation_list(investigations: DataFrame, problems: DataFrame, least: int = 3) -> DataFrame:
    """investigations(problem_id, status, searches) with the problem's statement; insufficient: fewer than `least` searches."""
    j = investigations.join(problems.select("problem_id", "statement"), "problem_id", "left")
    return j.select("problem_id", "status", F.coalesce("statement", F.lit("(problem file missing)")).alias("statement"), (F.col("searches") < least).alias("insufficient"))


def assessment_list(assessments: DataFrame, warnings: DataFrame) -> DataFrame:
    """assessments(problem_id, low, high), warnings(problem_id, kind, text) -> how many warnings of each kind an assessment has, by
    kind, in all, and whether its value is unknown."""
    own = warnings.groupBy("problem_id", "kind").agg(F.count("*").alias("n")).groupBy("problem_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("warnings"), F.sum("n").alias("n_warnings")
    )
    j = assessments.select("problem_id", "low", "high").join(own, "problem_id", "left")
    return j.select("problem_id", "low", "high", F.col("low").isNull().alias("unknown"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), "warnings")


def dossier(problems: DataFrame, sources: DataFrame, candidates: DataFrame, novelty: DataFrame, values: DataFrame, fits: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row for each problem: the statement, its sources in order, each with its candidate's statement where there is one, and the records of
    all later stages. A problem's sources are one array, so they must fit in a row."""
    cited = sources.join(candidates.select("candidate_id", F.col("statement").alias("candidate_statement")), "candidate_id", "left")
    own = cited.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source_id", "ptype", "candidate_id", "candidate_statement"))).alias("sources"))
    record = lambda d, name: d.select("problem_id", F.struct(*[c for c in d.columns if c != "problem_id"]).alias(name))
    j = problems.select("problem_id", "statement").join(own, "problem_id", "left")
    for d, name in ((novelty, "novelty"), (values, "value"), (fits, "fit"), (opportunities, "opportunity")):
        j = j.join(record(d, name), "problem_id", "left")
    return j


def triage_view(rows: DataFrame, triage: DataFrame, keep: str) -> DataFrame:
    """keep: shortlist, reject, not_rejected or untriaged; a problem without a mark has `none`."""
    marked = rows.join(triage, "problem_id", "left").withColumn("mark", F.coalesce("mark", F.lit("none")))
    rule = {"not_rejected": F.col("mark") != "reject", "untriaged": F.col("mark") == "none"}
    return marked.where(rule.get(keep, F.col("mark") == keep))


def triage_set(triage: DataFrame, orders: DataFrame) -> DataFrame:
    """triage(problem_id, mark, note), orders(problem_id, mark, note, at): each item's last order sets its mark and note, trimmed;
    mark none without a note clears the item."""
    last = orders.groupBy("problem_id").agg(F.max_by(F.struct("mark", F.trim(F.coalesce("note", F.lit(""))).alias("note")), F.struct("at", "mark", "note")).alias("r"))
    last = last.select("problem_id", "r.*")
    kept = triage.select("problem_id", "mark", "note").join(last.select("problem_id"), "problem_id", "left_anti")
    return kept.unionByName(last.where("mark <> 'none' or note <> ''"))


def value_gate(problems: DataFrame, novelty: DataFrame, force: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Before an assessment, for all problems or for asked(problem_id): refused (no such problem, malformed or solved), not_investigated,
    forced, or passed."""
    known = ("unsolved", "partially_solved", "solved", "unclear")
    s = F.col("status")
    gate = (
        F.when(F.col("_there").isNull(), "refused: no such problem").when(s.isNull(), "not_investigated").when(~s.isin(*known), "refused: malformed")
        .when(s == "solved", "forced" if force else "refused: solved").otherwise("passed")
    )
    rows = (problems if asked is None else asked).select("problem_id").join(problems.select("problem_id", F.lit(True).alias("_there")), "problem_id", "left")
    return rows.join(novelty.select("problem_id", "status"), "problem_id", "left").select("problem_id", gate.alias("gate"))


def opportunity_ready(problems: DataFrame, fits: DataFrame, novelty: DataFrame) -> DataFrame:
    """Why an opportunity can't be made yet, or ready."""
    j = problems.join(fits.select("problem_id", "problem_revision"), "problem_id", "full").join(novelty.select("problem_id", "status"), "problem_id", "left")
    why = (
        F.when(F.col("revision").isNull(), "no problem").when(F.col("problem_revision").isNull(), "no fit")
        .when(F.coalesce(F.col("status"), F.lit("unclear")).isin("unsolved", "partially_solved", "solved", "unclear") == F.lit(False), "bad novelty")
        .when(F.col("problem_revision") < F.col("revision"), "fit on an older revision").otherwise("ready")
    )
    return j.select("problem_id", why.alias("readiness"))


def overview(rows: DataFrame, candidates: DataFrame | None = None, challenges: DataFrame | None = None) -> DataFrame:
    """By stage: how many have it, wait, are stale. Problems wait for novelty, opportunities are waited for where there is a fit, and
    nothing waits in novelty itself. One pass over the funnel; with candidates(processed) and challenges(verdict) also these
    stages, each in a pass of its own."""
    has = {"problem": "problem_id", "novelty": "novelty", "economic value": "value_revision", "fit": "fit_revision", "opportunity": "opportunity_id"}
    waits = {"problem": "novelty", "economic value": "economic value", "fit": "fit", "opportunity": "opportunity"}
    stale = {"fit": F.count_if("fit_stale"), "opportunity": F.count_if(F.size("stale") > 0)}
    none = F.lit(0).cast("long")
    waiting = lambda s: F.count_if(F.array_contains("waiting", waits[s])) if s in waits else none
    sums = [F.struct(F.lit(s).alias("stage"), F.count(c).alias("n"), waiting(s).alias("waiting"), stale.get(s, none).alias("stale")).alias(s) for s, c in has.items()]
    out = rows.agg(*sums).select(F.inline(F.array(*[F.col(f"`{s}`") for s in has])))
    for d, name, waits in ((candidates, "candidate", "not processed"), (challenges, "challenge", "verdict is null")):
        if d is not None:
            out = out.unionByName(d.agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.count_if(F.expr(waits)).alias("waiting"), F.lit(0).cast("long").alias("stale")))
    return out


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """A page of sorted rows and the counts; the number is clamped. The rows are evaluated once, and of a deep page only the
    ranges of the order that hold it are sorted."""
    rows = staged(rows, "paged")
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return slice_of(rows, order, (number - 1) * size, size), {"total": total, "pages": pages, "page": number}


def record_history(runs: DataFrame, order: str, *fields: str) -> DataFrame:
    """runs of a record (problem_id, order, fields): revision counts up and history holds what came before, in order."""
    w = Window.partitionBy("problem_id").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({"revision": F.row_number().over(w), "history": F.collect_list(F.struct(order, *fields)).over(before)})


def last_record(runs: DataFrame, order: str, *fields: str) -> DataFrame:
    """runs of a record (problem_id, order, fields) -> one row for each record: the last run's fields, revision, the number of its
    runs, and history, what came before, in order and once. A record's runs are one row, by contract."""
    every = F.array_sort(F.collect_list(F.struct(order, *fields)))
    rows = runs.groupBy("problem_id").agg(every.alias("runs"))
    last = F.element_at("runs", -1)
    return rows.select("problem_id", F.size("runs").alias("revision"), *[last[c].alias(c) for c in (order, *fields)], F.slice("runs", F.lit(1), F.size("runs") - 1).alias("history"))


def assign_ids(wanted: DataFrame, known: DataFrame, prefix: str = "OPP-") -> DataFrame:
    """(problem_id, request) -> ids: a known problem keeps its own, new ones count on from the greatest in request order.
    Only new ones are numbered."""
    old = wanted.join(known.select("problem_id", "number"), "problem_id", "left")
    new = numbered(old.where("number is null").select("problem_id", "request"), "request", "problem_id", name="at")
    start = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("start"))
    new = new.crossJoin(F.broadcast(start)).select("problem_id", (F.col("start") + F.col("at") + 1).alias("number"))
    both = old.where("number is not null").select("problem_id", "number").unionByName(new)
    return both.select("problem_id", F.concat(F.lit(prefix), F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 4, "0")).otherwise(F.col("number").cast("string"))).alias("opportunity_id"))
