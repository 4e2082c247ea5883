"""Folds, samples and look-ups by key. A fold follows from the key's hash, so it is the same wherever and whenever it is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of entities, in order; the rest has no fold.
SHARES = {"A": 0.30, "B": 0.30, "ES": 0.08, "EVAL": 0.24}


def bucket(key: Column, salt: str = "") -> Column:
    """0 to 2^32 - 1 from the first 8 hexadecimal digits of the md5 of the salted key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long")


def fold(key: Column, shares: dict[str, float] = SHARES, salt: str = "") -> Column:
    share, upto, out = bucket(key, salt) / float(2**32), 0.0, None
    for name, part in shares.items():
        upto += part
        test = share < round(upto, 9)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def sample(df: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """The ``n`` rows whose keys' hashes are lowest (a sampling operator; of equal hashes the smaller key). The hash up to which they reach follows from counts of its leading bits, so only the rows at that border are sorted."""
    if n <= 0:
        return df.limit(0)
    step = 1 << 20
    by = df.withColumn("__bucket", bucket(F.col(key), salt))
    counts = sorted((r["b"], r["count"]) for r in by.groupBy(F.floor(F.col("__bucket") / step).alias("b")).count().collect())  # at most 4,096 rows
    taken, border = 0, None
    for b, count in counts:
        if taken + count > n:
            border = b
            break
        taken += count
    if border is None:
        return by.drop("__bucket")
    below = by.where(F.col("__bucket") < border * step)
    rest = by.where((F.col("__bucket") >= border * step) & (F.col("__bucket") < (border + 1) * step)).orderBy("__bucket", key).limit(n - taken)
    return below.unionByName(rest).drop("__bucket")


def drop_sample(entities: DataFrame, key: str, share: float = 0.19, salt: str = "drop") -> DataFrame:
    """Keys that a simulation drops: the share of *all* entities, taken from those without a fold by the order of their hashes."""
    n = int(share * entities.count())
    return sample(entities.where(fold(F.col(key)).isNull()), key, n, salt).select(key)


def out_of_fold(fold: Column, p_a: Column, p_b: Column) -> Column:
    """Rows of fold A take the model of B, those of B that of A, others the mean."""
    return F.when(fold == "A", p_b).when(fold == "B", p_a).otherwise((p_a + p_b) / 2)


def hit_bits(hit: Column) -> dict[str, Column]:
    return {f"hit_{n}": (hit.bitwiseAND(b) > 0).cast("int") for n, b in (("name", 1), ("addr", 2), ("comb", 4), ("rev", 8))}


def competitor_closure(pairs: DataFrame, subset: DataFrame) -> DataFrame:
    """Pairs of the entities of ``subset`` (s), and every pair on a target that one of them retrieved."""
    own = pairs.join(subset.select("s").distinct(), "s", "left_semi")
    return pairs.join(own.select("src", "t").distinct(), ["src", "t"], "left_semi")


def replaced(pairs: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``pairs`` with the values of ``column`` that ``new`` has, the old ones elsewhere."""
    return pairs.join(new.select(*keys, F.col(column).alias("__new")), keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with label 1 where truth (src, s, t) has them."""
    return pairs.join(truth.select("src", "s", "t", F.lit(1).alias("__y")).distinct(), ["src", "s", "t"], "left").withColumn("label", F.coalesce("__y", F.lit(0))).drop("__y")


def complete_join(left: DataFrame, right: DataFrame, keys: list[str], probe: str) -> DataFrame:
    """A left join that must find every row: a row without a partner raises when it is read."""
    out = left.join(right, keys, "left")
    return out.withColumn(probe, F.when(F.col(probe).isNull(), F.raise_error(F.lit(f"no partner for a row by {keys}")).cast(out.schema[probe].dataType)).otherwise(F.col(probe)))
