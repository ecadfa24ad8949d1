"""Candidates: validity, link numbers, outcome against items, what is still to process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .value import deadline_day

#: Most words of each text field (fixed values).
WORD_LIMITS = {"statement": 60, "title": 30, "evidence": 50, "stated": 50}


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def length_violations(columns: dict[str, int]) -> Column:
    """Names of the columns with more words than their limit, in the given order."""
    return F.array_compact(F.array(*[F.when(words(F.col(c)) > n, F.lit(c)) for c, n in columns.items()]))


def resolve_refs(refs: Column, links: Column, most: int = 50) -> Column:
    """Links named by 1-based numbers: only the first `most` links count, repeats once, in order."""
    known = F.slice(links, 1, most)
    return F.transform(F.array_distinct(F.filter(refs, lambda n: n.between(1, F.size(known)))), lambda n: F.element_at(known, n.cast("int")))


def bad_refs(refs: Column, n: Column) -> Column:
    return F.filter(refs, lambda r: ~r.between(1, n))


MOST_FOUND = 3


def valid_answers(answers: DataFrame, most: int = MOST_FOUND) -> tuple[DataFrame, DataFrame]:
    """answers(item_id, found array, ...) -> (valid ones, rejected(item_id, error)): an answer with more than `most` candidates, or
    none readable, is rejected as a whole."""
    why = F.when(F.col("found").isNull(), "unreadable").when(F.size("found") > most, "too many candidates")
    rows = answers.withColumn("_why", why)
    return rows.where("_why is null").drop("_why"), rows.where("_why is not null").select("item_id", F.col("_why").alias("error"))


def explode_answers(answers: DataFrame) -> DataFrame:
    """answers(item_id, revision, links, found array<struct<statement, refs>>, output_tokens) -> a candidate each, with
    the id that its item, revision and place give, its links and its rounded share of the tokens."""
    rows = answers.select("item_id", "revision", "links", "output_tokens", F.size("found").alias("n"), F.posexplode("found").alias("idx", "c"))
    return rows.select(
        F.concat_ws("-", F.lit("cand"), "item_id", F.concat(F.lit("r"), "revision"), "idx").alias("candidate_id"),
        F.col("c.statement").alias("statement"),
        resolve_refs(F.col("c.refs"), F.col("links")).alias("urls"),
        bad_refs(F.col("c.refs"), F.least(F.size("links"), F.lit(50))).alias("unresolved"),
        F.bround(F.col("output_tokens") / F.col("n")).cast("long").alias("tokens"),
    )


def outcome(candidates: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """What becomes of each candidate, first rule first: no item → failure, a finished item → finished, another revision
    of the item → superseded, else eligible."""
    state = items.select(key, F.col("revision").alias("item_revision"), "finished")
    return candidates.join(state, key, "left").withColumn(
        "outcome",
        F.when(F.col("item_revision").isNull(), "failure").when(F.col("finished"), "finished")
        .when(F.col("item_revision") != F.col("revision"), "superseded").otherwise("eligible"),
    )


def unprocessed(candidates: DataFrame, processed: DataFrame, categories: tuple = (), ids: tuple = ()) -> DataFrame:
    """Candidates without a decision: of the given categories, or exactly the given ids."""
    rows = candidates.join(processed.select("candidate_id"), "candidate_id", "left_anti")
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    return rows.where(F.col("candidate_id").isin(*ids)) if ids else rows


def unusable_ids(candidates: DataFrame, processed: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(candidate_id) -> those that can't be processed, with why: unknown or already processed."""
    j = asked.join(candidates.select("candidate_id", F.lit(True).alias("_known")), "candidate_id", "left")
    j = j.join(processed.select("candidate_id", F.lit(True).alias("_done")).distinct(), "candidate_id", "left")
    why = F.when(F.col("_known").isNull(), "unknown").when(F.col("_done"), "already processed")
    return j.select("candidate_id", why.alias("why")).where("why is not null")


def work_order() -> list[Column]:
    """Best tier first, oldest first within a tier."""
    return [F.col("tier").asc(), F.col("day").asc(), F.col("candidate_id").asc()]


def candidate_view(candidates: DataFrame, processed: DataFrame, q: str | None = None, tiers: tuple = (), category: str | None = None,
                   is_processed: bool | None = None, passed: bool | None = None, today: Column | None = None) -> DataFrame:
    """Candidates with problem and decision, blank problem ids as null; processed tells whether there is a decision, and, with
    today, due_passed whether the candidate's deadline lies before it (a rolling, unreadable or missing one never does).
    Filters: words in id, statement or title, tiers, category, processed or not, deadline passed or not."""
    links = processed.select("candidate_id", F.nullif("problem_id", F.lit("")).alias("problem_id"), "decision")
    rows = candidates.join(links, "candidate_id", "left").withColumn("processed", F.col("decision").isNotNull())
    if q:
        rows = rows.where(matches(q, "candidate_id", "statement", "title"))
    if tiers:
        rows = rows.where(F.col("tier").isin(*tiers))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if is_processed is not None:
        rows = rows.where(F.col("processed") == is_processed)
    if today is not None:
        rows = rows.withColumn("due_passed", F.coalesce(deadline_day(F.col("deadline")) < today, F.lit(False)))
    return rows if passed is None else rows.where(F.col("due_passed") == passed)


def merge_report(candidates: DataFrame, items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """One run: candidates(candidate_id, revision, output_tokens, key), items(key, revision, finished), decisions(candidate_id, decision,
    evidence_verified, merge_with, ...) -> one row of counts. A decision other than merged whose answer named a target is an invalid merge."""
    rows = outcome(candidates, items, key).join(decisions, "candidate_id", "left")
    n = lambda c, v: F.count_if(F.col(c) == v)
    more = []
    if "evidence_verified" in decisions.columns:
        more.append(F.count_if(F.col("decision").isin("new", "merged") & ~F.coalesce("evidence_verified", F.lit(True))).alias("unverified"))
    if "merge_with" in decisions.columns:
        more.append(F.count_if(F.col("merge_with").isNotNull() & (F.col("decision") != "merged")).alias("invalid_merges"))
    return rows.agg(
        F.count("*").alias("processed"), n("decision", "new").alias("new"), n("decision", "merged").alias("merged"), n("outcome", "superseded").alias("superseded"),
        n("outcome", "finished").alias("finished"), n("outcome", "failure").alias("failures"), (F.sum("output_tokens") / F.count("*")).alias("tokens_per_candidate"), *more,
    )


def matches(q: str, *columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(q.lower())
