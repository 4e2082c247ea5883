"""Token channels of a normalised record: what blocking looks up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

#: Weight of each channel, and which channels each search uses.
WEIGHTS = {"n": 0.45, "k": 0.25, "g": 0.30, "p": 0.30, "a": 0.80, "x": 0.60, "m": 0.50}
NAME, ADDRESS = ("n", "k", "g", "p"), ("a", "x")


def _longer(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]+$"))


def _cross(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))


def channels(core: Column, skeleton: Column, addr: Column) -> dict[str, Column]:
    """Channel -> array of tokens. n: name words. k: skeleton words. g: 4-grams of the name without spaces. p: pairs of name words. a: address words. x: number with word of the address. m: name word with address word."""
    name, address = _longer(words(core)), words(addr)
    packed = F.replace(core, F.lit(" "), F.lit(""))
    grams = F.when(F.length(packed) >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.length(packed) - 3, F.lit(1))), lambda i: F.substr(packed, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    six = F.array_sort(F.array_distinct(F.slice(name, 1, 6)))
    pairs = F.flatten(F.transform(six, lambda x: F.transform(F.filter(six, lambda y: x < y), lambda y: F.concat(x, F.lit("|"), y))))
    numbers = F.slice(F.array_distinct(F.filter(address, lambda w: w.rlike("^[0-9]+$"))), 1, 3)
    alpha = F.array_distinct(F.filter(address, lambda w: w.rlike("^[a-z]{3,}$")))
    return {
        "n": name,
        "k": F.filter(words(skeleton), lambda w: F.length(w) >= 2),
        "g": grams,
        "p": pairs,
        "a": address,
        "x": _cross(numbers, alpha),
        "m": _cross(F.filter(F.slice(name, 1, 2), lambda w: F.length(w) >= 3), F.filter(alpha, lambda w: F.length(w) >= 4)),
    }


def long_tokens(records: DataFrame, keys: list[str], core: str = "name_core", skeleton: str = "name_skel", addr: str = "addr") -> DataFrame:
    """(keys..., channel, token), each token once a record and channel: a sparse matrix as a relation."""

    def tagged(channel: str, bag: Column) -> Column:
        return F.transform(F.array_distinct(bag), lambda t: F.struct(F.lit(channel).alias("channel"), t.alias("token")))

    bags = F.flatten(F.array(*(tagged(*c) for c in channels(F.col(core), F.col(skeleton), F.col(addr)).items())))
    return records.select(*keys, F.explode(bags).alias("b")).select(*keys, "b.channel", "b.token")
