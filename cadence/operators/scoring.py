"""Weighted child-to-parent scoring.

Per child row ('match'): goal difference, result, knockout flag, opponent
strength flags.  Per parent ('tournament'):
    score = sum(goals for - goals against) + 2*wins + 3*phases passed
            + 4*knockout wins + 0.3*wins vs strong - 0.2*losses vs weak
and score per match = score / matches.  'Phases passed' is not fully specified
at the source; we use: distinct phases reached - 1, plus 1 when the last
recorded match is a knockout win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.exprs import safe_div

# The scoring weights and opponent-strength thresholds.
W_WIN, W_PHASE, W_KO_WIN, W_STRONG_WIN, W_WEAK_LOSS = 2.0, 3.0, 4.0, 0.3, -0.2
STRONG_TITLES, STRONG_TOP4, WEAK_APPEARANCES = 1, 2, 2
GROUP_PHASE = "group"

# Scores are accumulated exactly in integer tenths and divided once at the
# end, so the result does not depend on summation order or engine.
T_WIN, T_PHASE, T_KO_WIN, T_STRONG_WIN, T_WEAK_LOSS = (
    int(round(w * 10)) for w in (W_WIN, W_PHASE, W_KO_WIN, W_STRONG_WIN, W_WEAK_LOSS))


def match_flags(df: DataFrame) -> DataFrame:
    """Row-level flags: result W/D/L (a drawn knockout won on a shoot-out
    counts as a win), knockout, strong and weak opponent, per-match points."""
    gf, ga = F.col("goals_for"), F.col("goals_against")
    ko = F.col("phase") != GROUP_PHASE
    win = (gf > ga) | ((gf == ga) & (F.col("shootout_win") == 1) & ko)
    loss = (gf < ga)
    result = F.when(win, "W").when(loss, "L").otherwise("D")
    strong = (F.col("rival_titles") >= STRONG_TITLES) | (F.col("rival_top4") >= STRONG_TOP4)
    weak = (F.col("rival_appearances") < WEAK_APPEARANCES) & (F.col("rival_ko_wins") == 0)
    d = df.withColumns({"result": result, "is_knockout": ko.cast("int"),
                        "strong_rival": strong.cast("int"), "weak_rival": weak.cast("int")})
    w = (F.col("result") == "W").cast("int")
    lo = (F.col("result") == "L").cast("int")
    tenths = (10 * (gf - ga) + T_WIN * w + T_KO_WIN * w * F.col("is_knockout")
              + T_STRONG_WIN * w * F.col("strong_rival") + T_WEAK_LOSS * lo * F.col("weak_rival"))
    return d.withColumn("match_points", tenths.cast("double") / 10.0)


def parent_scores(matches: DataFrame, parent: str = "parent_id", order: str = "match_no") -> DataFrame:
    """One grouped aggregate per parent (partial aggregation first)."""
    d = match_flags(matches)
    w = (F.col("result") == "W").cast("int")
    lo = (F.col("result") == "L").cast("int")
    # the last recorded match; equal match numbers are broken by the outcome
    # so the result does not depend on row order
    ko_win = F.col("is_knockout") * w
    last = F.max(F.col(order).cast("long") * 2 + ko_win) % 2
    g = d.groupBy(parent).agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum(w).alias("wins"),
        F.sum(F.col("goals_for") - F.col("goals_against")).alias("goal_diff"),
        F.sum(w * F.col("is_knockout")).alias("ko_wins"),
        F.sum(w * F.col("strong_rival")).alias("wins_vs_strong"),
        F.sum(lo * F.col("weak_rival")).alias("losses_vs_weak"),
        F.countDistinct("phase").alias("phases"),
        F.max("is_knockout").alias("reached_knockout"),
        last.alias("_last"))
    passed = F.col("phases") - 1 + F.abs("_last")
    g = g.withColumn("phases_passed", passed.cast("int")).drop("_last")
    tenths = (10 * F.col("goal_diff") + T_WIN * F.col("wins") + T_PHASE * F.col("phases_passed")
              + T_KO_WIN * F.col("ko_wins") + T_STRONG_WIN * F.col("wins_vs_strong")
              + T_WEAK_LOSS * F.col("losses_vs_weak"))
    total = tenths.cast("double") / 10.0
    return g.withColumns({"score_total": total,
                          "score_per_match": safe_div(total, F.col("matches"))})
