"""A training corpus from raw documents: language ID, near duplicates, benchmark decontamination, PII, packing.

Each stage takes what its predecessor kept, reads no table but that one and the benchmark, and all but the last return the columns of
documents. Rows without a key pass the stages that go by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, language, neardup, packing, pii
from matchloom.llm._util import dropped, staged
from matchloom.llm.queries import table, tokenizer_paths

#: A document is rejected if its most likely language is not this many times as likely as chance (1 / number of languages), or if it has no letter. Scores are
#: calibrated, so a short text in one language can lie well below 1, and stays.
OVER_CHANCE = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter, or whose language can't be told."""
    model = language.fit_language_id(docs)
    out = "language_id"
    while out in docs.columns:
        out += "_"
    got = language.predict_language(docs, model, out=out)
    sure = (F.col(out)["lang"] != language.UND) & (F.col(out)["score"] * len(model.languages) >= (OVER_CHANCE if len(model.languages) > 1 else 1))
    return got.where(sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each near-duplicate class."""
    return neardup.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and counts n_chars anew."""
    return pii.redact_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, *tokenizer_paths())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express MinHash classes, learned languages or tokenizers; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
