"""Training data as the target sees it: some entities are dropped, so that their targets are orphans, and what depended on them is computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context, folds


def reverse_context(pairs: DataFrame, dropped: DataFrame) -> DataFrame:
    """(src, s, t, rev_rank, rev_gap, rev_n, rev_gap2) without the pairs of dropped entities (s)."""
    left = pairs.join(dropped.select("s"), "s", "left_anti")
    ranked = context.group_stats(left, ["src", "t"], "score", ["s"], "__r_")
    return ranked.select("src", "s", "t", F.col("__r_rank").alias("rev_rank"), (F.col("score") - F.col("__r_max")).alias("rev_gap"), F.col("__r_n").alias("rev_n"), context._margin("score", "__r_").alias("rev_gap2"))


def simulated(pairs: DataFrame, dropped: DataFrame, predict: Callable[[DataFrame], DataFrame], affected: DataFrame, least: float = 0.02) -> DataFrame:
    """The training table of a simulation: pairs (src, s, t, score, p1, ...) less those of dropped entities, with new reverse context, p1 predicted anew for the entities in ``affected`` (s), probability context over all, and admission.

    ``predict`` maps pairs with features to (src, s, t, p1).
    """
    new = reverse_context(pairs, dropped)
    names = ["rev_rank", "rev_gap", "rev_n", "rev_gap2"]
    left = pairs.drop(*names).join(new, ["src", "s", "t"])
    again = predict(left.join(affected.select("s").distinct(), "s", "left_semi"))
    merged = folds.replaced(left, again, ["src", "s", "t"], "p1")
    return context.admitted_context(merged, least)
