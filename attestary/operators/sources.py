"""Sources: which are due, health and yield over the scan log, lifecycle, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FAILURES, MIN_SCANS, MAX_DRY = 5, 5, 20


def due(sources: DataFrame, categories: DataFrame, now: Column, force: bool = False, category=None, tier: str | None = None, ids: tuple = ()) -> DataFrame:
    """Sources to scan now: not retired, of an enabled category, never scanned or last scanned a cadence ago or earlier,
    compared by the second; of one category or tier if asked. Sources named by id are scanned whatever their state."""
    j = sources.join(categories.select("category", "tier", "enabled"), "category")
    if ids:
        return j.where(F.col("source_id").isin(*ids)).drop("enabled")
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_scanned")
    ready = F.col("last_scanned").isNull() | (waited >= F.col("cadence_hours") * 3600) | F.lit(force)
    j = j.where(F.col("enabled") & (F.col("status") != "retired") & ready)
    j = j if category is None else j.where(F.col("category") == category)
    return (j if tier is None else j.where(F.col("tier") == tier)).drop("enabled")


def scan_stats(log: DataFrame) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return log.groupBy("source_id").agg(*[count(o) for o in ("new", "changed", "unchanged", "failed", "candidate")], F.count("*").alias("scans"))


def scan_report(results: DataFrame, errors: DataFrame) -> DataFrame:
    """results(source_id, outcome, truncated, finished) of a run's items, outcome new, changed, unchanged, filtered or
    item_error; errors(source_id, error) of sources that could not be read -> a row for each source, with the first of its errors."""
    count = lambda o, n: F.count_if(F.col("outcome") == o).alias(n)
    kept = F.col("outcome").isin("new", "changed", "unchanged")
    own = results.groupBy("source_id").agg(
        *[count(o, o) for o in ("new", "changed", "unchanged", "filtered")], F.count_if(kept & F.col("truncated")).alias("truncated"),
        count("item_error", "item_errors"), F.count_if(kept & F.col("finished")).alias("finished"),
    )
    failed = errors.groupBy("source_id").agg(F.min("error").alias("error"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in own.columns[1:]]
    return own.join(failed, "source_id", "full").select("source_id", *zero, "error")


def health(log: DataFrame) -> DataFrame:
    """log(source_id, seq, outcome, n_items): the running state after each scan: consecutive failures (a success resets
    them), scans, items seen (those of scans that didn't fail), candidates, and scans with new or changed items since the last
    candidate.

    A counter that resets is a count within islands: the running number of resets names the island. A source's log is
    one window partition and is sorted once for all counters."""
    upto = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    o = F.col("outcome")
    log = log.withColumns({
        "ok_island": F.count_if(o != "failed").over(upto), "hit_island": F.count_if(o == "candidate").over(upto),
        "scans": F.count("*").over(upto), "items_seen": F.coalesce(F.sum(F.when(o != "failed", F.col("n_items"))).over(upto), F.lit(0)),
    })
    failures = Window.partitionBy("source_id", "ok_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    dry = Window.partitionBy("source_id", "hit_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({
        "consecutive_failures": F.count_if(o == "failed").over(failures), "candidates": F.col("hit_island"),
        "dry_scans": F.count_if(o.isin("new", "changed")).over(dry),
    }).drop("ok_island", "hit_island")


def latest(running: DataFrame) -> DataFrame:
    keep = [c for c in running.columns if c not in ("source_id",)]
    return running.groupBy("source_id").agg(F.max_by(F.struct(*keep), "seq").alias("r")).select("source_id", "r.*")


def lifecycle(state: DataFrame, failures: int = MAX_FAILURES, scans: int = MIN_SCANS, dry: int = MAX_DRY) -> DataFrame:
    """The next status, first rule first: retired stays; too many failures retire; a candidate source with a yield becomes
    active, one scanned often enough without retires; an active one that has been dry for long retires."""
    broken = F.col("consecutive_failures") >= failures
    trial = F.col("status") == "candidate"
    rule = (
        F.when(F.col("status") == "retired", "stays").when(broken, "retired: failing")
        .when(trial & (F.col("candidates") > 0), "active: has a yield").when(trial & (F.col("scans") >= scans), "retired: no yield")
        .when((F.col("status") == "active") & (F.col("dry_scans") >= dry), "retired: dry").otherwise("stays")
    )
    return state.withColumn("rule", rule).withColumn("next_status", F.when(rule == "stays", F.col("status")).otherwise(F.substring_index("rule", ":", 1)))


def extract_stats(rows: DataFrame) -> DataFrame:
    """rows(source_id, candidates, output_tokens) of answered items -> by source: items, candidates, tokens, and tokens a
    candidate, to which items without candidates don't count."""
    used = F.sum(F.when(F.col("candidates") > 0, F.col("output_tokens")).otherwise(0))
    n = F.sum("candidates")
    return rows.groupBy("source_id").agg(
        F.count("*").alias("items"), n.alias("candidates"), F.sum("output_tokens").alias("output_tokens"),
        F.when(n > 0, used / n).alias("tokens_per_candidate"),
    )


def over_budget(stats: DataFrame, budget: float) -> DataFrame:
    """stats(source_id, output_tokens, empty_output_tokens, candidates): sources, and ALL pooled over all of them, whose
    tokens a candidate are above the budget; without candidates there is no ratio."""
    used = F.sum(F.col("output_tokens") - F.col("empty_output_tokens"))
    pooled = stats.rollup("source_id").agg(used.alias("used"), F.sum("candidates").alias("candidates"), F.grouping("source_id").alias("all"))
    ratio = F.when(F.col("candidates") > 0, F.col("used") / F.col("candidates"))
    return pooled.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("source_id")).alias("source_id"), ratio.alias("ratio")).where(F.col("ratio") > budget)


def failure_log(*parts: DataFrame) -> DataFrame:
    """One table of (source_id, item_id, error) from the jobs' rejected rows; without an id: *."""
    out = None
    for p in parts:
        p = p.select(F.coalesce("source_id", F.lit("*")).alias("source_id"), F.coalesce(F.col("item_id").cast("string"), F.lit("*")).alias("item_id"), "error")
        out = p if out is None else out.unionByName(p)
    return out


def first_of_each(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first `most` rows of each key; every task keeps no more than that of a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def override(state: DataFrame, orders: DataFrame) -> DataFrame:
    """orders(source_id, wanted): a status set by hand; back to active also clears the failures and the dry counter."""
    j = state.join(orders, "source_id", "left")
    clear = F.coalesce(F.col("wanted") == "active", F.lit(False))
    zero = lambda c: F.when(clear, 0).otherwise(F.col(c))
    return j.withColumns({
        "status": F.coalesce("wanted", "status"), "consecutive_failures": zero("consecutive_failures"), "dry_scans": zero("dry_scans"),
    }).drop("wanted")
