"""Checks of result files: their form, their ids, and how they agree with each other.

Findings are rows (rule, severity, n, examples), the first five examples in order; a file is valid if no finding is an error. A rule that finds
nothing has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLES = 5
MATCHING = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
FINDING = T.StructType([T.StructField("rule", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("n", T.LongType()), T.StructField("examples", T.ArrayType(T.StringType()))])


def finding(df: DataFrame, rule: str, example: Column | str, severity: str = "error") -> DataFrame:
    """One row if ``df`` has any. The examples are the smallest five, found by a top-n sort."""
    example = F.col(example) if isinstance(example, str) else example
    named = df.select(example.cast("string").alias("e"))
    first = named.distinct().orderBy("e").limit(EXAMPLES).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    return named.agg(F.count(F.lit(1)).alias("n")).where("n > 0").join(F.broadcast(first)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")  # both are one row


def parse_lists(lines: DataFrame) -> DataFrame:
    """(line, key, ids) of result lines (line, value): trimmed ids of a comma-joined list; a line without a tab has null ids."""
    parts = F.split("value", "\t", 2)
    ids = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select("line", "value", F.trim(F.get(parts, F.lit(0))).alias("key"), F.when(F.contains("value", F.lit("\t")), ids).alias("ids"))


def header_problem(head: str | None, columns: tuple[str, str]) -> str | None:
    if head is None or not head.strip():
        return "empty_file"
    if "\t" not in head and "," in head:
        return "comma_separated"
    return None if [c.strip().lower() for c in head.rstrip("\r\n").split("\t")] == list(columns) else "wrong_header"


def check_lists(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> list[DataFrame]:
    """Findings on parsed lists (key, ids). ``required``: the ids that must each have a row. ``known``: all ids that may occur in a list, if that is to be checked."""
    whole = rows.where(F.col("ids").isNotNull())
    each = whole.select("key", F.explode("ids").alias("id"))
    need = required.select(F.col(required.columns[0]).alias("key")).distinct()
    found = [
        finding(rows.where(F.col("ids").isNull()), "row_without_tab", "value" if "value" in rows.columns else "key"),
        finding(whole.groupBy("key").count().where("count > 1"), "duplicate_row", "key"),
        finding(whole.where(F.size("ids") > F.size(F.array_distinct("ids"))), "repeated_id", "key"),
        finding(each.where(F.startswith("id", F.lit("S1-"))), "source1_id_in_list", "id"),
        finding(each.where(~F.col("id").rlike("^S[123]-")), "bad_prefix", "id"),
        finding(need.join(whole.select("key"), "key", "left_anti"), "missing_row", "key"),
        finding(whole.select("key").distinct().join(need, "key", "left_anti"), "unexpected_row", "key"),
    ]
    if known is not None:
        every = known.select(F.col(known.columns[0]).alias("id")).distinct()
        found.append(finding(each.where(F.col("id").rlike("^S[23]-")).select("id").distinct().join(every, "id", "left_anti"), "unknown_id", "id"))
    return found


def check_subset(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for matched ids that are not among the candidates of their row."""
    both = matching.where("ids is not null").join(candidates.where("ids is not null").select("key", F.col("ids").alias("among")), "key", "left")
    extra = F.array_except("ids", F.coalesce("among", F.array().cast("array<string>")))
    return finding(both.where(F.size(extra) > 0), "not_a_candidate", "key", "warning")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of a folder's files in order, numbered from 1. A line's number is its place in its block of the file and the counts of the blocks before it, so any number of tasks may read."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    blocks = read.groupBy("file", "at").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a block of a file
    return read.join(F.broadcast(base), ["file", "at"]).select((F.col("base") + F.col("m") - F.col("first") + 1).alias("line"), "value")


def _read(spark: SparkSession, path: str, columns: tuple[str, str]) -> tuple[DataFrame | None, list[DataFrame]]:
    from ..sources.io import exists

    def one(rule: str, example: str = "") -> DataFrame:
        return spark.createDataFrame([(rule, "error", 1, [example or path])], FINDING)

    if not exists(spark, path):
        return None, [one("no_such_file")]
    lines = numbered_lines(spark, path)
    first = lines.where("line = 1").head()
    if problem := header_problem(first and first["value"], columns):
        return None, [one(problem, first["value"] if first else "")]
    bad = finding(lines.where(~F.is_valid_utf8("value")), "not_utf8", "line")
    rows = parse_lists(lines.where((F.col("line") != 1) & (F.trim("value") != "")))
    return rows, [bad]


def validate(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """All findings on a matching file, and on a candidate file if there is one."""
    rows, found = _read(spark, matching, MATCHING)
    if rows is not None:
        found += check_lists(rows, required, known)
    if candidates is not None:
        more, other = _read(spark, candidates, CANDIDATES)
        found += [f.withColumn("rule", F.concat(F.lit("candidates:"), "rule")) for f in other + (check_lists(more, required, known) if more is not None else [])]
        if rows is not None and more is not None:
            found.append(check_subset(rows, more))
    return reduce(DataFrame.unionByName, found)


def exit_code(findings: DataFrame) -> int:
    return int(not findings.where("severity = 'error'").isEmpty())
