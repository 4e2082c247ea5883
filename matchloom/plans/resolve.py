"""The end-to-end run: normalise, block, describe, train on one split and score another, correct, decide, write, validate. Steps meet in Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..operators import context, decide, difference, evaluation, features, folds, legacy_blocking, models, retrieval, shift, simulate, validate
from ..operators.evaluation import truth_pairs
from ..sources import io
from ..sources.stage import staged

#: The rule where none was tuned: expected F-0.5 with these parameters, one owner a target.
RULE = {"kind": "expected_f", "prob": "p2", "miss": 0.02, "alpha": 1.5, "min_p": 0.4, "exclusive": True}
#: Share of all records that the simulation drops.
DROPPED = 0.19
_PAIR = ["src", "s", "t"]
_NO_FEATURE = (*models.KEYS, "miss", "extra", "apply_fold")


def normalised(records: DataFrame) -> DataFrame:
    """(entity_id, country, business_name, business_address) with all normalised fields; ``id`` is the entity id."""
    out = text.normalize_address(text.normalize_name(records, "business_name", "__n"), "business_address", "country", "__a")
    return out.select(
        F.col("entity_id").alias("id"), "entity_id", "country", F.col("__n.full").alias("name_full"), F.col("__n.core").alias("name_core"), F.col("__n.dba").alias("name_dba"), text.skeleton(F.col("__n.core")).alias("name_skel"),
        *(F.col(f"__a.{f}").alias(f) for f in ("addr", "state", "postal", "house", "city", "nums")), F.col("__n.is_domain").alias("is_domain"), text.has_indic("business_name").alias("name_indic"),
    )


def block(s: DataFrame, t: DataFrame) -> DataFrame:
    """Pruned candidates of normalised records; ``t`` has src."""
    s_tokens = tokens.long_tokens(s, ["id", "country"])
    t_tokens = tokens.long_tokens(t, ["src", "id", "country"])
    s_sizes = s.groupBy("country").agg(F.count(F.lit(1)).alias("n_s"))
    t_sizes = t.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n_t"))
    return retrieval.candidates(retrieval.postings(s_tokens, t_tokens, s_sizes, t_sizes))


def described(candidates: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """Candidates with context, string features and differences."""
    out = context.candidate_context(candidates).withColumns(folds.hit_bits(F.col("hit")) | {"is_s3": (F.col("src") == 3).cast("int")})
    joined = difference.difference_features(features.pair_features(features.sides(out, s, t)))
    return joined.drop(*(c for c in joined.columns if c[:2] in ("a_", "b_")))


class Split:
    """The tables of one split, each made once and again when its inputs change."""

    def __init__(self, spark: SparkSession, paths: io.Paths, name: str, truth: str | None = None) -> None:
        self.spark, self.paths, self.name, self.truth = spark, paths, name, truth
        self.mark = io.fingerprint(spark, *(paths.raw(name, n) for n in (1, 2, 3)))
        parts = {n: io.materialised(spark, paths.normalised(name, n), lambda n=n: normalised(io.read_tsv(spark, paths.raw(name, n))), io.fingerprint(spark, paths.raw(name, n))) for n in (1, 2, 3)}
        self.s, self.t = parts[1], parts[2].withColumn("src", F.lit(2)).unionByName(parts[3].withColumn("src", F.lit(3)))

    def candidates(self) -> DataFrame:
        return io.materialised(self.spark, self.paths.table("candidates", self.name), lambda: block(self.s, self.t), self.mark)

    def known(self) -> DataFrame:
        """True pairs; none without a truth file."""
        if not self.truth:
            return self.spark.createDataFrame([], "src int, s string, t string")
        return truth_pairs(io.read_tsv(self.spark, self.truth, io.TRUTH))

    def rows(self) -> DataFrame:
        """Candidates with features, label and fold. Only a split with a truth has folds: elsewhere no model has seen any row."""
        fold = F.coalesce(folds.fold(F.col("s")), F.lit("none")) if self.truth else F.lit("none")
        mark = io.fingerprint(self.spark, *([self.truth] if self.truth else []), before=self.mark)
        return io.materialised(self.spark, self.paths.table("features", self.name), lambda: folds.labelled(described(self.candidates(), self.s, self.t).withColumn("fold", fold), self.known()), mark)


def predicted(rows: DataFrame, two: tuple[models.Scorer, models.Scorer], out: str) -> DataFrame:
    """``rows`` with a probability from models that did not see them."""
    return models.score_two(rows, two).withColumn(out, folds.out_of_fold(F.col("fold"), F.col("p_a"), F.col("p_b"))).drop("p_a", "p_b")


def with_log_odds(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    out = rows.withColumn("apply_fold", difference.apply_fold())
    for side, table in tables.items():
        out = difference.apply_log_odds(out, table, side, _PAIR, side, ["apply_fold"])
    return out


def simulated_rows(rows: DataFrame, s: DataFrame, first: tuple[models.Scorer, models.Scorer], share: float = DROPPED) -> DataFrame:
    """Rows (with p1) as a target split would have them: some records are dropped, so their targets are orphans; what competed with them is described and scored anew."""
    dropped = staged(folds.drop_sample(s.select(F.col("id").alias("s")), "s", share), "dropped")
    touched = rows.join(dropped, "s", "left_semi").select("src", "t").distinct()
    affected = rows.join(touched, ["src", "t"], "left_semi").join(dropped, "s", "left_anti").select("s").distinct()
    return simulate.simulated(rows, dropped, lambda df: predicted(df.drop("p1"), first, "p1").select(*_PAIR, "p1"), affected)


def evaluated(rows: DataFrame, counts: DataFrame, rule: dict) -> float | None:
    """Macro F-0.5 of a rule over the entities of ``counts``."""
    row = decide.macro_f05(counts, decide.apply_rule(rows, rule)).head()
    return row and row["macro_f05"]


def blocking_report(spark: SparkSession, paths: io.Paths, split: str, truth: str) -> dict:
    """How many true pairs the candidates of a split hold: recall by search and rank, quantiles of true pairs' scores, and the pruning sweep; kept under ``work``/reports."""
    own = Split(spark, paths, split, truth)
    known, cand = own.known(), own.candidates()
    tables = {"recall": evaluation.recall(known, cand), "quantiles": evaluation.score_quantiles(known, cand), "sweep": evaluation.prune_sweep(known, cand)}
    out = {name: [r.asDict() for r in df.collect()] for name, df in tables.items()}  # a few rows a source
    io.write_json(spark, paths.table("reports", f"blocking_{split}"), out)
    return out


def older_blocking(spark: SparkSession, paths: io.Paths, split: str, single: bool = False) -> dict:
    """The older blockers on one split: candidates of both target sources as one list a record, and how many there are."""
    def side(n: int) -> DataFrame:
        rows = text.simple_normalised(io.read_tsv(spark, paths.raw(split, n)))
        return rows.select("entity_id", "country", F.col("norm_name_no_suffix").alias("name"), F.col("norm_address").alias("addr"))

    s, parts = staged(side(1), "older"), [staged(side(n), "older") for n in (2, 3)]
    pairs = staged(reduce(DataFrame.unionByName, (legacy_blocking.all_blocks(s, t) for t in parts)), "older-pairs")
    lists = legacy_blocking.candidate_lists(s, pairs).withColumnsRenamed({"entity_id": "source1_entity_id", "candidates": "candidate_entity_ids"})
    io.write_lists(lists, f"{paths.output}/{split}_older_candidates.tsv", single)
    return evaluation.output_summary(pairs, s.select(F.col("entity_id").alias("s"))).head().asDict()


def with_country(rows: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs with the country of their record ``s``."""
    return rows.join(s.select(F.col("id").alias("s"), "country"), "s")


def _segmented(rows: DataFrame) -> DataFrame:
    return rows.withColumn("segment", shift.segment(F.col("addr_empty_b"), F.col("house_eq")))


def corrected(scored: DataFrame, labelled: DataFrame, by_segment: bool = True) -> DataFrame:
    """Scores of a target split corrected for priors by country and source, or by country and segment."""
    if by_segment:
        scored, labelled = _segmented(scored), _segmented(labelled)
    return shift.corrected(scored, labelled, ["country", "segment" if by_segment else "src"], "p2")


def train(spark: SparkSession, paths: io.Paths, truth: str, split: str = "train", ablation: bool = False) -> dict:
    """Fits both stages, the log odds, the rule and the priors on one split, and keeps them under ``work``/models; returns what was measured.

    Stage 2 learns from the simulation, in which some records are missing as they are in a target split. The rule is the best of the grid on fold
    EVAL of the simulated rows; its honest value comes from two halves of that fold. ``ablation`` also fits stage 2 without the differences.
    """
    own = Split(spark, paths, split, truth)
    rows = own.rows()
    columns = models.feature_columns(rows, _NO_FEATURE)
    first = models.fit_two(rows, columns, models.STAGE1)
    p1 = staged(predicted(rows, first, "p1"), "p1")
    table = staged(simulated_rows(p1, own.s, first), "simulated")
    tables = {}
    for side in ("miss", "extra"):
        io.write_table(difference.cross_fitted(table, side), paths.table("models", f"log_odds_{side}"))
        tables[side] = spark.read.parquet(paths.table("models", f"log_odds_{side}"))
    tabled = staged(with_log_odds(table, tables), "second")
    second = models.feature_columns(tabled, _NO_FEATURE)
    last = models.fit_two(tabled, second, models.STAGE2)
    scored = staged(predicted(tabled, last, "p2"), "p2")
    for name, scorers in (("stage1", first), ("stage2", last)):
        for half, scorer in zip("ab", scorers, strict=True):
            scorer.save(paths.table("models", f"{name}_{half}"))
    io.write_table(shift.priors(_segmented(with_country(scored, own.s)), ["country", "segment"]), paths.table("models", "priors"))
    kept = own.s.select(F.col("id").alias("s")).where(folds.fold(F.col("s")) == "EVAL")
    counts = staged(decide.true_counts(kept, own.known().join(kept, "s", "left_semi")), "counts")
    held = staged(scored.where("fold = 'EVAL'"), "held")
    rule = decide.best_rule(decide.rule_grid(held, counts))
    score = rule and rule.pop("macro_f05")
    half = decide.honest_half_split(held, counts).head()
    decision = (rule or {k: v for k, v in RULE.items() if k != "exclusive"}) | {"exclusive": True}
    measured = {"tuned": score, "honest": half and half["honest"], "exclusive": evaluated(held, counts, decision), "importances": last[0].importances()[:20]}
    if ablation:
        plain = [c for c in second if c not in DIFFERENCES]
        other = staged(predicted(tabled, models.fit_two(tabled, plain, models.STAGE2), "p2").where("fold = 'EVAL'"), "plain")
        measured["without_differences"] = evaluated(other, counts, decision)
    io.write_json(spark, paths.table("models", "splits"), {"shares": folds.SHARES, "dropped": DROPPED})
    io.write_json(spark, paths.table("models", "features"), {"stage1": columns, "stage2": second})
    io.write_json(spark, paths.table("models", "decision"), decision)
    io.write_json(spark, paths.table("models", "measured"), measured)
    return measured


#: Features of stage 2 that say how two records differ.
DIFFERENCES = frozenset("n_miss n_extra miss_frac extra_frac legal_n_a legal_n_b legal_jacc h_digits_eq h_substr h_ndiff h_logdist nums_miss nums_extra miss_lo_min miss_lo_sum extra_lo_min extra_lo_sum".split())


def score(spark: SparkSession, paths: io.Paths, split: str, truth: str | None = None, correct: bool = True) -> DataFrame:
    """A split's admitted pairs with p1, p2 and p_adj, from the models under ``work``. ``truth`` says that the models were fitted on this split, whose rows then take the model that did not see them. Corrected scores take the place of p2 in the rule; a group without a known prior keeps its scores."""
    own = Split(spark, paths, split, truth)
    load = lambda name: tuple(models.Scorer.load(spark, paths.table("models", f"{name}_{half}")) for half in "ab")
    rows = own.rows()
    mark = io.fingerprint(spark, *(paths.table("models", n) for n in ("stage1_a", "stage1_b", "stage2_a", "stage2_b", "log_odds_miss", "log_odds_extra", "priors")), paths.table("features", split), correct=correct)

    def make() -> DataFrame:
        p1 = staged(predicted(rows, load("stage1"), "p1"), "p1")
        admitted = staged(context.admitted_context(p1), "admitted")
        tabled = staged(with_log_odds(admitted, {side: spark.read.parquet(paths.table("models", f"log_odds_{side}")) for side in ("miss", "extra")}), "second")
        p2 = staged(_segmented(with_country(predicted(tabled, load("stage2"), "p2"), own.s)), "p2")
        if not correct:
            return p2.withColumn("p_adj", F.col("p2"))
        return shift.corrected_from(p2, spark.read.parquet(paths.table("models", "priors")), ["country", "segment"], "p2")

    return io.materialised(spark, paths.table("scored", split), make, mark)


def output(spark: SparkSession, paths: io.Paths, split: str, chosen: DataFrame, matching_only: bool = False, single: bool = False) -> int:
    """Writes the matches (and, unless ``matching_only``, the candidates) as lists, validates them, and returns the exit code."""
    own = Split(spark, paths, split)
    entities, matching, among = own.s.select("entity_id"), f"{paths.output}/{split}_matching.tsv", f"{paths.output}/{split}_candidates.tsv"
    io.write_lists(io.match_lists(entities, chosen), matching, single)
    if not matching_only:
        io.write_lists(io.match_lists(entities, own.candidates(), "candidate_entity_ids"), among, single)
    found = staged(validate.validate(spark, matching, entities, None if matching_only else among, own.t.select("entity_id")), "findings")
    code = validate.exit_code(found)
    io.write_json(spark, f"{paths.output}/{split}_findings", {"exit_code": code, "findings": [r.asDict() for r in found.collect()]})  # at most a row a rule
    return code


def resolve(spark: SparkSession, paths: io.Paths, split: str, truth: str | None = None, correct: bool = True) -> DataFrame:
    """The chosen pairs (src, s, t, p2) of a split, by the models and the rule that were kept."""
    scored = score(spark, paths, split, truth, correct)
    rule = io.read_json(spark, paths.table("models", "decision"))
    return decide.apply_rule(scored.drop("p2").withColumnRenamed("p_adj", "p2"), rule).select(*_PAIR, "p2")


def run(spark: SparkSession, paths: io.Paths, split: str = "train", truth: str | None = None, output_: bool = True, matching_only: bool = False) -> DataFrame:
    """Resolves a split. With a truth table it trains on that split first, and no row is scored by a model that saw it; without one the models of an earlier training are used."""
    if truth:
        train(spark, paths, truth, split)
    chosen = resolve(spark, paths, split, truth, correct=not truth)
    if output_:
        output(spark, paths, split, chosen, matching_only)
    return chosen
