"""Challenges: metric bounds, direction of leaderboards, headroom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verify import short_number

#: (pattern, direction, ceiling) by definition of the metric, the first match decides (fixed values).
METRIC_BOUNDS = (
    ("log ?loss|logloss|cross.?entropy", "lower_is_better", 0.0),
    (r"\berror\b|\brmse\b|\bmae\b|\bmse\b|\bwer\b|\bcer\b", "lower_is_better", 0.0),
    (r"centipawn|\bacpl\b", "lower_is_better", 0.0),
    (r"accuracy|auroc|\bauc\b|\bf1\b|f-score|\biou\b|jaccard|dice|\bmap\b|mean average precision|precision|recall", "higher_is_better", 1.0),
    ("mean normalized reward", "higher_is_better", 1.0),
)
UP, DOWN = "higher_is_better", "lower_is_better"


def metric_bounds(metric: Column, bounds=METRIC_BOUNDS) -> Column:
    """struct<direction, ceiling> of the first pattern that occurs in the metric's name, or null."""
    return F.coalesce(*[
        F.when(metric.rlike(f"(?i){p}"), F.struct(F.lit(d).alias("direction"), F.lit(c).alias("ceiling"))) for p, d, c in bounds
    ])


def top_rows(board: DataFrame, n: int = 10) -> DataFrame:
    """The first n ranked rows of each board."""
    w = Window.partitionBy("challenge_id").orderBy("pos")
    return board.where("not is_baseline").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("challenge_id", "rank", "team", "score")


def headroom(board: DataFrame, threshold: float = 0.1, bounds=METRIC_BOUNDS, looked_up: DataFrame | None = None) -> DataFrame:
    """board(challenge_id, pos, team, score, is_baseline, metric) -> a row for each board with ranked rows. looked_up(challenge_id,
    value): baselines found elsewhere, for boards that list none.

    The winner is the first ranked row. The rank order's direction is the sign of all steps, null if they disagree or
    all scores are equal. It must agree with the metric's own direction. The strongest baseline scales the gap between
    winner and ceiling; where there is none, the ceiling itself does if higher is better, else nothing does."""
    w = Window.partitionBy("challenge_id").orderBy("pos")
    ranked = board.where("not is_baseline").withColumn("step", F.signum(F.col("score") - F.lag("score").over(w)))
    boards = ranked.groupBy("challenge_id").agg(
        F.min("metric").alias("metric"), F.min_by(F.struct("team", "score"), "pos").alias("winner"),
        F.min("step").alias("low_step"), F.max("step").alias("high_step"), F.count("*").alias("n_ranked"),
    )
    named = lambda f: f(F.struct("score", F.col("team").alias("name")))
    base = board.where("is_baseline").groupBy("challenge_id").agg(named(F.max).alias("most"), named(F.min).alias("least"))
    j = boards.join(base, "challenge_id", "left").withColumn("bound", metric_bounds(F.col("metric"), bounds))
    found = F.lit(None).cast("double")
    if looked_up is not None:
        j, found = j.join(looked_up.select("challenge_id", F.col("value").alias("_found")), "challenge_id", "left"), F.col("_found")
    by_rank = F.when((F.col("high_step") <= 0) & (F.col("low_step") < 0), UP).when((F.col("low_step") >= 0) & (F.col("high_step") > 0), DOWN)
    varied = (F.col("low_step") != 0) | (F.col("high_step") != 0)
    j = j.withColumn("by_rank", by_rank).withColumn("direction", F.coalesce("bound.direction", "by_rank"))
    up = F.col("direction") == UP
    order_warning = (
        F.when(F.col("bound").isNull(), "unknown bound").when(varied & F.col("by_rank").isNull(), "not sorted")
        .when(F.col("by_rank").isNotNull() & (F.col("by_rank") != F.col("bound.direction")), "order contradicts metric")
    )
    listed = F.when(up, F.col("most")).when(~up, F.col("least"))
    j = j.withColumns({"baseline": F.coalesce(listed["score"], found), "baseline_name": listed["name"], "order_warning": order_warning})
    sound, c, b, s = F.col("order_warning").isNull(), F.col("bound.ceiling"), F.col("baseline"), F.col("winner.score")
    gap = F.when(up, c - s).otherwise(s - c)
    scale = F.when(b.isNotNull(), F.when(up, c - b).otherwise(b - c)).otherwise(F.when(up, c))
    j = j.withColumns({"gap": F.when(sound, gap), "scale": F.when(sound, scale)})
    g, k = F.col("gap"), F.col("scale")
    scale_warning = (
        F.when(~sound, None).when(g < 0, "beyond the ceiling").when(k <= 0, "no positive scale")
        .when(b.isNotNull() & (g > k), "worse than the baseline")
    )
    # a board without a baseline may be beyond the ceiling, too: both are said
    j = j.withColumns({"base_warning": F.when(sound & k.isNull(), "no baseline"), "scale_warning": scale_warning})
    ratio = F.when(sound & F.col("base_warning").isNull() & F.col("scale_warning").isNull(), g / k)
    return j.withColumn("headroom", ratio).select(
        "challenge_id", "metric", "direction", F.col("winner.team").alias("winner"), F.col("winner.score").alias("winner_score"), "baseline", "baseline_name", "headroom",
        F.when(F.col("headroom").isNull(), "unclear").when(F.col("headroom") < threshold - 1e-9, "solved").otherwise("headroom").alias("verdict"),
        F.concat_ws("; ", "order_warning", "base_warning", "scale_warning").alias("warnings"),
        (F.col("headroom").isNull() & (F.col("direction") == DOWN) & b.isNull() & c.isNotNull()).alias("needs_baseline"),
    )


def with_top_rows(boards: DataFrame, board: DataFrame, n: int = 10) -> DataFrame:
    """Boards with their first n ranked rows, as an array."""
    top = top_rows(board, n).groupBy("challenge_id").agg(F.array_sort(F.collect_list(F.struct("rank", "team", "score"))).alias("top"))
    return boards.join(top, "challenge_id", "left")


def headline(verdict: Column, ratio: Column) -> Column:
    """The verdict, with the headroom in whole percent where there is one."""
    return F.when(ratio.isNull(), verdict).otherwise(F.concat(verdict, F.lit(" "), F.bround(ratio * 100).cast("long").cast("string"), F.lit("%")))


def challenge_view(finished: DataFrame, records: DataFrame, q: str | None = None, checked: bool | None = None, verdict: str | None = None,
                   investigated: bool | None = None) -> DataFrame:
    """finished(challenge_id, title, ...) items with their record(challenge_id, verdict, headroom, winner, winner_score, metric,
    investigated), where there is one: null verdict and headline without. Filtered by words in id or title, and by what the record says."""
    r = records.select(
        "challenge_id", "verdict", "headroom", headline(F.col("verdict"), F.col("headroom")).alias("headline"),
        F.concat_ws(" ", short_number(F.col("winner_score")), "metric").alias("winner"),
        (F.coalesce("investigated", F.lit(False)) if "investigated" in records.columns else F.lit(False)).alias("investigated"),
    )
    j = finished.join(r, "challenge_id", "left").withColumn("investigated", F.coalesce("investigated", F.lit(False)))
    if q:
        j = j.where(F.lower(F.concat_ws(" ", "challenge_id", "title")).contains(q.lower()))
    j = j if checked is None else j.where(F.col("verdict").isNotNull() == checked)
    j = j if verdict is None else j.where(F.col("verdict") == verdict)
    return j if investigated is None else j.where(F.col("investigated") == investigated)


def refusal(asked: DataFrame, items: DataFrame, records: DataFrame, force: bool = False) -> DataFrame:
    """asked(challenge_id), items(challenge_id, finished), records(challenge_id, verdict) -> (challenge_id, refusal), before any money is
    spent: no such finished challenge, or found solved by the headroom check unless forced; null where it may run."""
    j = asked.select("challenge_id").join(items.select("challenge_id", "finished"), "challenge_id", "left").join(records.select("challenge_id", "verdict"), "challenge_id", "left")
    solved = F.lit(not force) & (F.col("verdict") == "solved")
    return j.select("challenge_id", F.when(~F.coalesce("finished", F.lit(False)), "not a finished challenge").when(solved, "found solved").alias("refusal"))


def challenge_order() -> list[Column]:
    """Greatest headroom first; none, and none left, last."""
    return [F.when(F.col("headroom") != 0, F.col("headroom")).desc_nulls_last(), F.col("challenge_id").asc()]
