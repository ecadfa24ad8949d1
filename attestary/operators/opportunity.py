"""Rules on scores: what earlier stages found bounds them, and thresholds decide the recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least value of each known dimension for a recommendation, and the most novelty by status (fixed values).
THRESHOLDS = {"personal_advantage": 7, "tractability": 5, "novelty": 5, "economic_value": 4}
NOVELTY_MOST = {"solved": 3, "partially_solved": 7}
NO_ADVANTAGE_CAP, SELF_RATING_CAP = 2, 5


def contradiction(novelty_status: Column, novelty_score: Column, has_value: Column, value_score: Column) -> Column:
    """Why scores contradict the stages before, or null."""
    unknown = novelty_status.isNull() | (novelty_status == "unclear")
    most = F.coalesce(*[F.when(novelty_status == s, m) for s, m in NOVELTY_MOST.items()], F.lit(10))
    return (
        F.when(unknown & novelty_score.isNotNull(), "novelty must be null").when(~unknown & novelty_score.isNull(), "novelty missing")
        .when(~unknown & (novelty_score > most), "novelty too high").when(has_value & value_score.isNull(), "value missing")
        .when(~has_value & value_score.isNotNull(), "value must be null")
    )


def recommendation(novelty_status: Column, dimensions: dict[str, Column], step: Column, thresholds=THRESHOLDS) -> dict[str, Column]:
    """ignore unless every known dimension reaches its threshold, else the given step; with the reasons."""
    short = F.array_compact(F.array(*[F.when(c < thresholds[n], F.lit(n)) for n, c in dimensions.items()]))
    solved = F.coalesce(novelty_status == "solved", F.lit(False))
    low = F.size(short) > 0
    return {
        "recommendation": F.when(solved | low, "ignore").otherwise(step),
        "reason": F.when(solved, "solved").when(low, F.array_join(short, "; ")).otherwise("all reached"),
    }


def capped_fit(score: Column, kept: Column, self_rated: Column, no_advantage=NO_ADVANTAGE_CAP, self_rating=SELF_RATING_CAP) -> Column:
    """A fit's score without any kept advantage, or with only self-rated ones, is capped."""
    return F.when(kept == 0, F.least(score, F.lit(no_advantage))).when(kept == self_rated, F.least(score, F.lit(self_rating))).otherwise(score)
