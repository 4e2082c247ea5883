"""IDF weights of token channels. A doc-term matrix is the relation (side, keys, channel, token, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import WEIGHTS

PART = ["src", "country"]
POST = [*PART, "channel", "token"]


def channel_weight(channel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), channel)


def document_frequency(s: DataFrame, t: DataFrame) -> DataFrame:
    """(src, country, channel, token, df_s, df_t): in how many records of either side a token occurs. ``s`` and ``t`` hold each token once a record."""
    both = s.select(*POST, F.lit(1).alias("one"), F.lit(0).alias("two")).unionByName(t.select(*POST, F.lit(0).alias("one"), F.lit(1).alias("two")))
    return both.groupBy(*POST).agg(F.sum("one").alias("df_s"), F.sum("two").alias("df_t"))


def idf(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``df`` with idf = ln((N + 1) / (df + 1)) + 1 over both sides; ``sizes``: (src, country, n_s, n_t), one small row a partition."""
    n = F.col("n_s") + F.col("n_t")
    return df.join(sizes, PART).withColumn("idf", F.log((n + 1) / (F.col("df_s") + F.col("df_t") + 1)) + 1)


def weighted(tokens: DataFrame, idfs: DataFrame) -> DataFrame:
    """Postings of one side: w = channel weight x idf / length of the record's channel vector. The length counts every token, capped or not."""
    own = Window.partitionBy(*PART, "id", "channel")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(own))
    return tokens.join(idfs, POST).withColumn("w", channel_weight(F.col("channel")) * F.col("idf") / norm)


def cap(side: Column) -> Column:
    """Tokens in more records than this of the indexed side are not looked up."""
    return F.greatest(F.lit(200), F.floor(F.lit(0.002) * side))
