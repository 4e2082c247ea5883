"""Correction of scores for a prior that differs between training and target data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10_000


def priors(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by..., prior): share of true rows."""
    return rows.groupBy(*by).agg(F.avg(label).alias("prior"))


def adjust(p: Column, prior: Column, target: Column) -> Column:
    """p under another prior: a p / (a p + b (1 - p)), with a = target / prior and b = (1 - target) / (1 - prior). A prior of 0 or 1 leaves p as it is."""
    a, b = target / prior, (1 - target) / (1 - prior)
    return F.when((prior <= 0) | (prior >= 1), p).otherwise(a * p / (a * p + b * (1 - p)))


def em_prior(rows: DataFrame, prior: DataFrame, by: list[str], p: str = "p", steps: int = 500, tolerance: float = 1e-8, bins: int = BINS) -> DataFrame:
    """(by..., prior, target): the target prior of each group at the fixed point of target <- mean of the adjusted p.

    Scores are first summed into ``bins`` equal bins (their count and mean), so a step costs a pass over at most ``bins`` rows a group,
    however many rows there are, and one task holds a group's histogram, not its rows. The steps run inside one higher-order fold, and a group
    that has settled stays as it is.
    """
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    histogram = rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(p).alias("m"))
    grouped = histogram.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "m"))).alias("h"), F.sum("n").alias("total")).join(prior, by)

    def step(state: Column, _: Column) -> Column:
        now = state["v"]
        new = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x["n"] * adjust(x["m"], F.col("prior"), now)) / F.col("total")
        moved = F.when(state["done"], now).otherwise(new)
        return F.struct(moved.alias("v"), (state["done"] | (F.abs(new - now) < tolerance)).alias("done"))

    start = F.struct(F.col("prior").alias("v"), F.lit(False).alias("done"))
    got = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["v"])
    return grouped.select(*by, "prior", got.alias("target"))


def segment(addr_empty: Column, house_eq: Column) -> Column:
    """noaddr, house_eq, house_ne or house_na (unknown)."""
    return F.when(addr_empty == 1, "noaddr").when(house_eq == 1, "house_eq").when(house_eq == 0, "house_ne").otherwise("house_na")


def corrected(rows: DataFrame, labelled: DataFrame, by: list[str], p: str = "p", steps: int = 500) -> DataFrame:
    """``rows`` with p_adj: priors from ``labelled``, target priors from the rows, by group; groups that were never labelled keep p."""
    return corrected_from(rows, priors(labelled, by), by, p, steps)


def corrected_from(rows: DataFrame, known: DataFrame, by: list[str], p: str = "p", steps: int = 500) -> DataFrame:
    """As ``corrected``, from priors (by..., prior) that were kept."""
    shift = em_prior(rows, known, by, p, steps)
    return rows.join(F.broadcast(shift), by, "left").withColumn("p_adj", F.coalesce(adjust(F.col(p), F.col("prior"), F.col("target")), F.col(p))).drop("prior", "target")  # one row a group
