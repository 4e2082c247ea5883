"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score.

Beside the base kinds there are numbers that a checksum confirms: IBAN (mod 97), VIN (weighted mod 11), IMEI (Luhn), US bank routing numbers
(weights 3, 7, 1), German tax numbers (ISO 7064 mod 11, 10), Spanish DNI and NIE (letter of mod 23) and French social security numbers
(mod 97); and US social security numbers, for which only ranges are known. A span starts with the prior score of its kind, which says how much its checksum proves;
whole words nearby that name the kind raise it, and words that name something else ("order", "version", "example") lower it. A base span stays
whatever its score, another is reported from KEEP on: so a routing number, which one number in ten would pass for, needs a word that says so,
and an IBAN in an example does not count.

Defined results: a null or empty text has no spans; text is scanned whole; other columns of the input are kept as they are, and
an existing column of the output's name is replaced. Rows never interact, so repeated rows get the same spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import each

#: Kinds in the order in which spans are listed; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "vin", "imei", "routing", "steuer_id", "dni", "nir")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

_VIN = re.compile(r"(?<![A-Za-z0-9])[A-HJ-NPR-Z0-9]{17}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{9,15}(?![0-9A-Za-z-]|[.,][0-9])")
_DNI = re.compile(r"(?<![A-Za-z0-9])[XYZ0-9][0-9]{7}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])")
_NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")

#: Score before context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "vin": 0.55, "imei": 0.3, "routing": 0.2, "steuer_id": 0.3, "dni": 0.6, "nir": 0.6}
#: Words that name a kind, and words that name something else, within CONTEXT characters; what each adds or takes.
CONTEXT_WORDS = {
    "email": "mail email contact write kontakt correo courriel",
    "ip": "ip address host server addr",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone call tel telephone mobile fax telefon téléphone teléfono",
    "iban": "iban account bank transfer konto compte cuenta",
    "ssn": "ssn social security",
    "vin": "vin vehicle chassis car fahrzeug",
    "imei": "imei handset device",
    "routing": "routing aba rtn",
    "steuer_id": "steuer steuerid steuernummer steueridentifikationsnummer idnr tin",
    "dni": "dni nie nif identidad",
    "nir": "nir insee sécurité sociale",
}
OTHER_WORDS = "example sample dummy test version release build isbn issn order invoice ticket serial sku part beispiel exemple ejemplo"
CONTEXT, RAISE, LOWER = 40, 0.4, 0.35
#: A span that is not of a base kind is reported from this score on.
KEEP = 0.5
_WORDS = re.compile(r"[^\W\d_]+")
_NAMES = {kind: frozenset(words.split()) for kind, words in CONTEXT_WORDS.items()}
_OTHERS = frozenset(OTHER_WORDS.split())

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def vin(number: str) -> bool:
    """The ninth character is the weighted sum of all, modulo 11 (X for 10)."""
    if number.isdigit() or number.isalpha():
        return False
    letters = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
    weights = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
    rest = sum((int(c) if c.isdigit() else letters[c]) * w for c, w in zip(number, weights, strict=True)) % 11
    return number[8] == "0123456789X"[rest]


def routing(digits: str) -> bool:
    return digits[:2] <= "12" and digits != "0" * 9 and sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0


def steuer_id(digits: str) -> bool:
    """ISO 7064, mod 11, 10; of the first ten digits one occurs two or three times."""
    most = max(digits[:10].count(c) for c in digits[:10])
    if digits[0] == "0" or most not in (2, 3):
        return False
    product = 10
    for c in digits[:10]:
        product = 2 * ((int(c) + product) % 10 or 10) % 11
    return (11 - product) % 10 == int(digits[10])


def dni(number: str) -> bool:
    bare = number.replace("-", "")
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23] == bare[-1]


def nir(digits: str) -> bool:
    return "01" <= digits[3:5] <= "12" and 97 - int(digits[:13]) % 97 == int(digits[13:])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern local@domain matches, found from each @ outwards: linear even on long runs of letters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or 0) <= 255


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their validators, by kind as listed, then start."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()


    for m in _VIN.finditer(text):
        if vin(m[0]):
            yield "vin", *m.span()
    found = list(_DIGITS.finditer(text))
    for kind, size, valid in (("imei", 15, luhn), ("routing", 9, routing), ("steuer_id", 11, steuer_id)):
        for m in found:
            if len(m[0]) == size and valid(m[0]):
                yield kind, *m.span()
    for m in _DNI.finditer(text):
        if dni(m[0]):
            yield "dni", *m.span()
    for m in _NIR.finditer(text):
        if nir(m[0].replace(" ", "")):
            yield "nir", *m.span()


def _score(text: str, kind: str, a: int, b: int) -> float:
    """The prior of a kind, moved by the whole words around a span."""
    lo, hi = max(0, a - CONTEXT), b + CONTEXT
    near = {m[0].lower() for x, y in ((lo, a), (b, hi)) for m in _WORDS.finditer(text, x, y) if (m.start() > lo or lo == 0 or not text[lo - 1].isalpha()) and (m.end() < hi or not text[hi : hi + 1].isalpha())}
    return round(min(1.0, max(0.0, PRIOR[kind] + RAISE * (not near.isdisjoint(_NAMES[kind])) - LOWER * (not near.isdisjoint(_OTHERS)))), 2)


def scan(text: str | None) -> list[Span]:
    """All spans of a text: (kind, start, end, score), in code points, end exclusive. Base kinds stay whatever their score."""
    spans = ((kind, a, b, _score(text, kind, a, b)) for kind, a, b in _proposed(text or ""))
    return [s for s in spans if s[0] in BASE or s[3] >= KEEP]


def redact(text: str | None) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    if text is None or not (spans := scan(text)):
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@F.arrow_udf(_TYPE)
def _scan_column(text: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t)] for t in each(text)], _SPANS)


@F.arrow_udf(T.StringType())
def _redact_column(text: pa.Array) -> pa.Array:
    return pa.array((redact(t) for t in each(text)), pa.string(), size=len(text))


def find_pii(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end, score) of each row's text."""
    return df.withColumn(spans, _scan_column(F.col(text)))


def redact_pii(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``df`` with its personal data replaced, and ``n_chars`` (if there is such a column) counted anew."""
    out = df.withColumn(text, _redact_column(F.col(text)))
    if n_chars in df.columns:
        out = out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """The contract's columns: counts of the base kinds, sha256 of the base spans, all spans; and the spans' scores, in the same order."""
    every = F.col(spans)
    return found.select(
        "doc_id",
        *(F.size(of_kinds(every, (k,))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of_kinds(every, BASE)), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
