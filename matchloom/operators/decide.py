"""Which pairs are matches: thresholds, exclusivity, expected-F subsets, and the metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .folds import complete_join

#: The grid of rules that are tried.
THRESHOLDS = [round(0.30 + 0.02 * i, 2) for i in range(33)]
MISS, ALPHA, MIN_P = (0.0, 0.02, 0.05), (0.8, 1.0, 1.2, 1.5, 2.0), (0.05, 0.2, 0.4)


def threshold(pairs: DataFrame, least: float, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= least)


def exclusive(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Of the pairs that claim a target, the likeliest; of equals, the smaller s."""
    best = Window.partitionBy("src", "t").orderBy(F.desc(p), "s")
    return pairs.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def expected_f(pairs: DataFrame, miss: float | Column = 0.03, alpha: float | Column = 1.0, min_p: float | Column = 0.0, p: str = "p", by: list[str] = ()) -> DataFrame:
    """The subset of each s that maximises the expected F-0.5, or none if the expected value of an empty answer is higher.

    With rows of p > min_p by p descending: E[n] = sum p / (1 - miss), F(j) = 1.25 * (sum of the first j p) / (0.25 E[n] + j), and the empty
    answer is worth alpha * prod(1 - p) * (1 - miss). The shortest prefix within 1e-12 of the best is taken.
    """
    miss, alpha, min_p = (x if isinstance(x, Column) else F.lit(x) for x in (miss, alpha, min_p))
    keys = [*by, "s"]
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc(p), "src", "t")
    value = F.col(p)
    out = pairs.where(value > min_p).withColumns({
        "__j": F.row_number().over(order),
        "__cum": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__n": F.sum(value).over(every) / (1 - miss),
        "__none": alpha * F.exp(F.sum(F.log1p(-F.least(value, F.lit(1 - 1e-9)))).over(every)) * (1 - miss),
    }).withColumn("__ef", 1.25 * F.col("__cum") / (0.25 * F.col("__n") + F.col("__j")))
    out = out.withColumn("__best", F.max("__ef").over(every))
    out = out.withColumn("__stop", F.min(F.when(F.col("__ef") >= F.col("__best") - 1e-12, F.col("__j"))).over(every))
    return out.where((F.col("__j") <= F.col("__stop")) & (F.col("__best") > F.col("__none"))).drop("__j", "__cum", "__n", "__none", "__ef", "__best", "__stop")


def apply_rule(pairs: DataFrame, rule: dict) -> DataFrame:
    """``rule``: kind ("threshold", "threshold_top" or "expected_f"), which probability, its parameters, and whether targets are exclusive."""
    p = rule.get("prob", "p")
    if rule["kind"] == "expected_f":
        got = expected_f(pairs, rule["miss"], rule["alpha"], rule["min_p"], p)
    else:
        got = threshold(pairs, rule["threshold"], p)
        if rule["kind"] == "threshold_top":
            best = Window.partitionBy("src", "t").orderBy(F.desc("p1"), "s")
            ranked = pairs if "p1_t_rank" in pairs.columns else pairs.withColumn("p1_t_rank", F.row_number().over(best) - 1)
            got = threshold(ranked.where("p1_t_rank = 0"), rule["threshold"], p).select(*pairs.columns)
    return exclusive(got, p) if rule.get("exclusive") else got


def true_counts(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """(s, n_true) of every entity, 0 where truth has none."""
    return entities.select("s").join(truth.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n_true"))


def f05(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """1.25 tp / (0.25 n_true + n_pred); 1 if both are 0."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def macro_f05(counts: DataFrame, selected: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean F-0.5 over all entities of ``counts`` (s, n_true); ``selected``: (s, label) of the chosen pairs, whose s must be among them. One row, or one for each value of ``by`` that selects something."""
    got = selected.groupBy(*by, "s").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    # Entities without a choice need no row for each rule: their sum is that of all, less those with one.
    empty = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(f05(F.lit(0), F.col("n_true"), F.lit(0))).alias("all_empty"))
    own = complete_join(got, counts, ["s"], "n_true").groupBy(*by).agg(F.sum(f05(F.col("tp"), F.col("n_true"), F.col("n_pred"))).alias("f"), F.sum(f05(F.lit(0), F.col("n_true"), F.lit(0))).alias("instead"))
    return own.join(F.broadcast(empty)).select(*by, ((F.col("f") + F.col("all_empty") - F.col("instead")) / F.col("n")).alias("macro_f05"))  # ``empty`` is one row


def rules() -> list[dict]:
    """The 177 rules: 2 probabilities x 33 thresholds, plain and exclusive, and 45 of expected F."""
    out = [{"prob": p, "kind": kind, "threshold": t} for p in ("p1", "p2") for kind in ("threshold", "threshold_top") for t in THRESHOLDS]
    return out + [{"prob": "p2", "kind": "expected_f", "miss": m, "alpha": a, "min_p": x} for m in MISS for a in ALPHA for x in MIN_P]


def best_rule(grid: DataFrame) -> dict | None:
    """The rule of a grid that scores best, as ``apply_rule`` takes it; of equal scores the first by kind and parameters."""
    row = grid.orderBy(F.desc(F.round("macro_f05", 9)), "kind", "prob", "threshold", "miss", "alpha", "min_p").head()
    return None if row is None else {k: v for k, v in row.asDict().items() if v is not None}


def rule_grid(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, prob, threshold, miss, alpha, min_p, macro_f05) of every rule that chooses something, over pairs (src, s, t, p1, p2, label).

    The pairs are read once. No rule needs rows of its own: an entity's choice changes only where its sorted pairs pass a threshold, and
    rules of expected F differ by sums over one order of an entity's pairs, as those above a least p are its first ones.
    """
    top = Window.partitionBy("src", "t").orderBy(F.desc("p1"), "s")
    ranked = pairs.select("src", "s", "t", "p1", "p2", "label", (F.row_number().over(top) == 1).alias("top"))
    base = staged(complete_join(ranked, counts, ["s"], "n_true"), "grid")
    every = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(f05(F.lit(0), F.col("n_true"), F.lit(0))).alias("empty"))  # one row
    parts = _threshold_gains(base).unionByName(_expected_gains(base))
    return parts.join(F.broadcast(every)).select("kind", "prob", "threshold", "miss", "alpha", "min_p", ((F.col("empty") + F.col("gain")) / F.col("n")).alias("macro_f05"))


def _gain(tp: Column, n_pred: Column) -> Column:
    """What a choice is worth more than none."""
    return f05(tp, F.col("n_true"), n_pred) - f05(F.lit(0), F.col("n_true"), F.lit(0))


def _threshold_gains(base: DataFrame) -> DataFrame:
    """For each threshold the sum of gains. An entity's gain holds from the step that its pair passes down to that of its next pair, so gains are summed by both steps first."""
    kinds = [(kind, p) for p in ("p1", "p2") for kind in ("threshold", "threshold_top")]
    passed = [reduce(Column.__add__, ((F.col(p) >= t).cast("int") for t in THRESHOLDS)).alias(f"k_{p}") for p in ("p1", "p2")]
    variants = F.array(*(F.struct(F.lit(i).alias("v"), (F.when(F.col("top"), F.col(f"k_{p}")).otherwise(0) if kind == "threshold_top" else F.col(f"k_{p}")).alias("k")) for i, (kind, p) in enumerate(kinds)))
    each = base.select("s", "n_true", "label", "top", *passed).select("s", "n_true", "label", F.inline(variants)).where("k > 0")
    each = each.groupBy("s", "v", "k").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"), F.first("n_true").alias("n_true"))
    down = Window.partitionBy("s", "v").orderBy(F.desc("k"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.select("v", "k", F.lead("k", 1, 0).over(down).alias("next"), _gain(F.sum("tp").over(so_far), F.sum("n").over(so_far)).alias("gain"))
    edges = run.groupBy("v", "k", "next").agg(F.sum("gain").alias("gain"))  # at most 34 x 33 rows a variant
    edges = edges.select("v", "gain", F.explode(F.sequence(F.col("next") + 1, "k")).alias("k")).groupBy("v", "k").agg(F.sum("gain").alias("gain"))
    name = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in kinds)), F.col("v") + 1)
    none = F.lit(None).cast("double")
    return edges.select(name(0).alias("kind"), name(1).alias("prob"), F.element_at(F.array(*(F.lit(t) for t in THRESHOLDS)), F.col("k")).alias("threshold"), none.alias("miss"), none.alias("alpha"), none.alias("min_p"), "gain")


def _expected_gains(base: DataFrame) -> DataFrame:
    """For each rule of expected F the sum of gains: one order of an entity's pairs, and one shuffle, serve all of them."""
    every, order = Window.partitionBy("s"), Window.partitionBy("s").orderBy(F.desc("p2"), "src", "t")
    combos = [(m, x) for m in MISS for x in MIN_P]
    p = F.col("p2")
    rows = base.select("s", "n_true", "label", "p2", F.row_number().over(order).alias("j"), F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"),
        *(c for i, x in enumerate(MIN_P) for c in (F.sum(F.when(p > x, p)).over(every).alias(f"sum{i}"), F.sum(F.when(p > x, F.log1p(-F.least(p, F.lit(1 - 1e-9))))).over(every).alias(f"log{i}"))))
    value = {c: F.when(p > x, 1.25 * F.col("cum") / (0.25 * F.col(f"sum{MIN_P.index(x)}") / (1 - m) + F.col("j"))) for c, (m, x) in enumerate(combos)}
    rows = rows.select("*", *(v.alias(f"ef{c}") for c, v in value.items()))
    rows = rows.select("*", *(F.max(f"ef{c}").over(every).alias(f"best{c}") for c in value))
    rows = rows.select("*", *(F.min(F.when(F.col(f"ef{c}") >= F.col(f"best{c}") - 1e-12, F.col("j"))).over(every).alias(f"stop{c}") for c in value))
    of_s = rows.groupBy("s", "n_true").agg(*(a for c in value for a in (F.sum(F.when(F.col("j") <= F.col(f"stop{c}"), F.col("label"))).alias(f"tp{c}"), F.max(f"stop{c}").alias(f"n{c}"), F.max(f"best{c}").alias(f"best{c}"))), *(F.max(f"log{i}").alias(f"log{i}") for i in range(len(MIN_P))))
    sums, rules_ = [], []
    for c, (m, x) in enumerate(combos):
        for a in ALPHA:
            chosen = F.col(f"best{c}") > a * F.exp(f"log{MIN_P.index(x)}") * (1 - m)
            rules_.append(F.struct(F.lit(m).alias("miss"), F.lit(a).alias("alpha"), F.lit(x).alias("min_p"), F.col(f"r{len(sums)}").alias("gain")))
            sums.append(F.sum(F.when(chosen, _gain(F.col(f"tp{c}"), F.col(f"n{c}")))).alias(f"r{len(sums)}"))
    got = of_s.agg(*sums).select(F.explode(F.filter(F.array(*rules_), lambda r: r["gain"].isNotNull())).alias("r"))
    return got.select(F.lit("expected_f").alias("kind"), F.lit("p2").alias("prob"), F.lit(None).cast("double").alias("threshold"), "r.miss", "r.alpha", "r.min_p", "r.gain")


def half(key: str = "s") -> Column:
    """Which half of the evaluation entities a key is in: 0 or 1, by its hash."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 2


def honest_half_split(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The rule that is best on half 0, and what it scores on half 1: (kind, prob, parameters, tuned, honest)."""
    tuned = rule_grid(pairs.where(half() == 0), counts.where(half() == 0)).orderBy(F.desc(F.round("macro_f05", 9)), "kind", "prob", "threshold", "miss", "alpha", "min_p").limit(1)
    other = rule_grid(pairs.where(half() == 1), counts.where(half() == 1)).withColumnRenamed("macro_f05", "honest")
    keys = ["kind", "prob", "threshold", "miss", "alpha", "min_p"]
    a, b = tuned.alias("a"), other.alias("b")
    return a.join(b, reduce(lambda x, k: x & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.lit(True))).select(*(F.col(f"a.{k}") for k in keys), F.col("a.macro_f05").alias("tuned"), "b.honest")


def pair_precision_recall(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs chosen, chosen, true, precision, recall."""
    got = selected.agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    return got.join(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n_true")))).select("tp", "n_pred", "n_true", (F.col("tp") / F.col("n_pred")).alias("precision"), (F.col("tp") / F.col("n_true")).alias("recall"))
