"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for strings that no pattern knows.

A candidate is a long run of key-like characters that holds a letter and a digit, and stands behind a sensitive word. Its novelty is the
number of compressed bytes that it adds to its surroundings, over its length. The compressor is primed by a dictionary trained on the names and
descriptions that Python's standard library publishes (an identifier dictionary made by rule), whose entropy tables code even short strings, and by dates, digits and
alphabets in order; the text on both sides stands before the candidate. Words, paths, slugs, class names, dates and
repetitions compress; keys don't. A candidate at NOVEL or above is reported.

Defined results: a null or empty text has no spans; texts are scanned whole; rows never interact; an existing column of the output's
name is replaced, other columns are kept. The dictionary depends on the Python release alone.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache
from importlib import import_module

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import each
from .pii import joined, of_kinds

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs are matched whole, so shorter ones never match and the look-behind only saves time.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: Words, and pairs of words, that make what follows them sensitive.
SENSITIVE = frozenset("password passwords passwd pwd passphrase secret secrets token tokens apikey credential credentials bearer auth authorization signature private session".split())
SENSITIVE_PAIRS = frozenset([("api", "key"), ("access", "key"), ("license", "key"), ("encryption", "key"), ("signing", "key")])
#: Characters around a candidate that prime the compressor, and before it among which a sensitive word counts.
AROUND, NEAR = 512, 48
#: Compressed bytes per character from which a candidate is incompressible. Ordinary names measure 0.1 to 0.79, random keys 0.75 to 1.2.
NOVEL = 0.8
#: Standard modules whose names and descriptions train the dictionary, and its bytes.
MODULES = (
    "argparse asyncio builtins calendar collections configparser datetime email.message functools http.client http.server inspect itertools json logging os pathlib "
    "shutil smtplib socket ssl string subprocess tarfile threading unittest urllib.request xml.dom.minidom zipfile"
).split()
DICTIONARY = 1 << 16
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _published() -> Iterator[str]:
    """Names and descriptions of the modules, in order."""
    for name in MODULES:
        module = import_module(name)
        yield module.__doc__ or ""
        for key in sorted(vars(module)):
            value = getattr(module, key)
            inner = [f"{key} {getattr(v, '__doc__', None) or ''}" for key, v in sorted(vars(value).items())] if isinstance(value, type) else []
            yield from (f"{key} {value.__doc__ if isinstance(value.__doc__, str) else ''}", *inner)


@cache
def _primed() -> zstandard.ZstdCompressor:
    """The compressor: trained entropy tables and content, and behind them dates, digits and alphabets in order."""
    trained = zstandard.train_dictionary(DICTIONARY, [x.encode("utf-8", "replace") for x in _published() if len(x) >= 8]).as_bytes()
    dates = " ".join(f"{year}-{month:02}-{year % 28 + 1:02}T{year % 24:02}" for year in range(1990, 2040) for month in range(1, 13))
    ordered = f" {dates} {string.ascii_lowercase}{string.ascii_uppercase} {string.digits}{string.ascii_lowercase}{string.digits}"
    dictionary = zstandard.ZstdCompressionDict(trained + ordered.encode(), dict_type=zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that ``candidate`` adds to what stands around it, per character."""
    around = (before + " " + after + " ").encode("utf-8", "replace")
    return (len(_primed().compress(around + candidate.encode())) - len(_primed().compress(around))) / len(candidate)


def sensitive(before: str) -> bool:
    """Whether a text ends near a sensitive word; names such as "authToken" count by their parts, "author" is no part of "auth"."""
    words = [w.lower() for w in _NAME_PART.findall(before)]
    return not SENSITIVE.isdisjoint(words) or not SENSITIVE_PAIRS.isdisjoint(zip(words, words[1:], strict=False))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            for m in _ASSIGN.finditer(text):
                if len(m[2]) >= 8:
                    yield "assign", *m.span()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 16:
                yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()


def _novel(text: str, known: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if not (_DIGIT.search(m[0]) and _LETTER.search(m[0])) or any(x < b and a < y for _, x, y in known):
            continue
        if sensitive(text[max(0, a - NEAR) : a]) and novelty(m[0], text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= NOVEL:
            yield "novel", a, b


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, (kind, start, end) by start, then kind as listed, in code points, end exclusive. Base spans always stay."""
    base = list(_base(text or ""))
    return sorted([*base, *_novel(text or "", base)], key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(_TYPE)
def _scan_column(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in each(text)], _SPANS)


def find_secrets(df: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end) of each row's text."""
    return df.withColumn(spans, _scan_column(F.col(text)))


def digest(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """The contract's columns: counts of the base kinds, sha256 of the base spans, all spans."""
    every = F.col(spans)
    return found.select(
        "doc_id",
        *(F.size(of_kinds(every, (k,))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of_kinds(every, BASE)), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
