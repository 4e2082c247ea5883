"""Normalisation of business names and addresses, as column expressions.

Only Unicode folding leaves the JVM (Spark has no normaliser), in Arrow batches; after ``base_clean`` text is ``[0-9a-z ]`` alone, so all
that follows is the same in any engine. Empty input gives empty output; null counts as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indic import transliterate

# Fixed values, which decide what names and addresses are equal: legal forms and their romanised spellings, words that are no part of a name, street words
# (first the form that stands for all), unit words and particles, states with their codes, native names of Indian states.
LEGAL = (
    "inc incorporated incorporation corp corporation co company cie ltd limited llc llp lp plc pvt private pte gmbh sarl sas sasu sa sci snc eurl selarl scop scp sca ltda pllc pc pa lllp opc "
    "praivet praaivet praivaet limitaed limiteda limitad limitd elelpi eleelpi elaelapii elelpii elaelapi elaelasii kampanii kampani korporeshan praivettt privet praiveta praivetaa praiveet praivaeta praiveti limitedaa"
).split()
HONORIFICS = "mr mrs ms miss dr shri sri shree smt messrs sh km prof the www com net org in http https".split()
DBA = r" (?:dba|d b a|t a|trading as|doing business as|also known as|aka|a k a) "
STREETS = """street str st saint|road rd|avenue ave av avn aven|boulevard blvd bd boul bld|drive dr drv|lane ln|court ct crt|place pl plz plaza|square sq|highway hwy|parkway pkwy pky|circle cir crcl|terrace ter terr|trail trl
way wy|crossing xing|expressway expy|freeway fwy|center centre ctr|mount mt|fort ft|north n|south s|east e|west w|northeast ne|northwest nw|southeast se|southwest sw|rue r|chemin ch|impasse imp|allee all al|route rte
faubourg fbg|quai qu|cours crs|sainte ste|nagar ngr|sector sec sect|phase ph|market mkt|opposite opp|near nr|building bldg|floor flr fl|apartment apt apts|complex cplx|extension extn ext|village vill vil|district dist"""
UNITS = "no number num nos unit suite door dno hno h d plot shop flat house po box pmb na and of the de du des la le les bis".split()
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
    "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri",
    "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "pr": "puerto rico",
}
#: Name -> its codes and older names; the first stands for all.
INDIA_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg ct", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od or orissa", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts tg",
    "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk ut uttaranchal", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "chandigarh": "ch", "puducherry": "py pondicherry",
    "andaman and nicobar islands": "an", "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld",
}
INDIA_NATIVE = {
    "andhra pradesh": "आंध्र प्रदेश|ఆంధ్రప్రదేశ్|ఆంధ్ర ప్రదేశ్", "arunachal pradesh": "अरुणाचल प्रदेश", "assam": "असम|অসম", "bihar": "बिहार", "chhattisgarh": "छत्तीसगढ़", "goa": "गोवा", "gujarat": "गुजरात|ગુજરાત", "haryana": "हरियाणा",
    "himachal pradesh": "हिमाचल प्रदेश", "jharkhand": "झारखंड", "karnataka": "ಕರ್ನಾಟಕ|कर्नाटक", "kerala": "കേരളം|केरल", "madhya pradesh": "मध्य प्रदेश", "maharashtra": "महाराष्ट्र", "manipur": "मणिपुर", "meghalaya": "मेघालय",
    "mizoram": "मिज़ोरम", "nagaland": "नागालैंड", "odisha": "ଓଡ଼ିଶା|ओडिशा", "punjab": "ਪੰਜਾਬ|पंजाब", "rajasthan": "राजस्थान", "sikkim": "सिक्किम", "tamil nadu": "தமிழ்நாடு|तमिलनाडु", "telangana": "తెలంగాణ|तेलंगाना", "tripura": "त्रिपुरा",
    "uttar pradesh": "उत्तर प्रदेश", "uttarakhand": "उत्तराखंड", "west bengal": "পশ্চিমবঙ্গ|पश्चिम बंगाल", "delhi": "दिल्ली", "jammu and kashmir": "जम्मू और कश्मीर", "chandigarh": "चंडीगढ़", "puducherry": "पुडुचेरी",
}


def fold(text: str) -> str:
    """NFKC, lower case, Indic scripts romanised, Latin accents dropped (combining marks U+0300 to U+036F only)."""
    if text.isascii():
        return text.lower()
    text = transliterate(unicodedata.normalize("NFKC", text).lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ")


@F.arrow_udf(T.StringType())
def _fold(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold(t) for t in text.to_pylist()], pa.string())


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has_indic(c: Column | str) -> Column:
    """Whether a character of U+0900 to U+0DFF occurs."""
    return text(c).rlike("[\\u0900-\\u0DFF]")


def strip_accents(c: Column | str) -> Column:
    return _fold(text(c))


def base_clean(c: Column | str) -> Column:
    """Folded; & is "and"; apostrophes vanish; all but letters and digits becomes one space."""
    c = F.replace(_fold(text(c)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['`’‘]", ""), "[^0-9a-z]+", " "))


def words(c: Column) -> Column:
    """Words of cleaned text; none for empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def join_single_letters(tokens: Column) -> Column:
    """Runs of one-letter words become one word: "a b c stores" is "abc stores"."""

    def single(w: Column) -> Column:
        return w.rlike("^[a-z]$")

    glued = F.transform(tokens, lambda w, i: F.when((i > 0) & single(w) & single(F.get(tokens, i - 1)), w).otherwise(F.concat(F.lit(" "), w)))
    return words(F.trim(F.array_join(glued, "")))


#: "(id: 12)", "(Reg. No 7)", and "id 12", "Ref: 7" without parentheses.
ID_TAGS = r"(?i)\(\s*(?:id|ref|reg|no)(?:[\s.:#-]+(?:no[\s.:#-]*)?)?[0-9][^)]*\)|\(\s*(?:id|ref|reg|no)[.:#-][^)]*\)|\b(?:id|ref)\s*[:#]?\s*[0-9]+\b"


def drop_id_tags(c: Column | str) -> Column:
    """Removes identifier tags; a parenthesis that merely begins with such letters, as "(North Wing)", stays."""
    return F.regexp_replace(text(c), ID_TAGS, " ")


_DOMAIN = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|info|biz|io|fr|us|co\.in|in|co)(?:/[^\s]*)?($|[^a-z0-9.])"


def is_domain(c: Column | str) -> Column:
    return text(c).rlike(_DOMAIN)


def domain_stem(c: Column | str) -> Column:
    """Web domains replaced by their stem."""
    return F.regexp_replace(text(c), _DOMAIN, " $1 $2")


def dba_parts(clean: Column) -> Column:
    """Parts around "doing business as" and its like."""
    return F.filter(F.transform(F.split(F.concat(F.lit(" "), clean, F.lit(" ")), DBA), lambda p: F.trim(p)), lambda p: p != "")


def core_tokens(tokens: Column) -> Column:
    """Words without legal forms and honorifics, first occurrences only; never empty if there are words."""
    bare = F.array_distinct(F.filter(tokens, lambda w: ~w.isin(*LEGAL, *HONORIFICS)))
    polite = F.array_distinct(F.filter(tokens, lambda w: ~w.isin(*HONORIFICS)))
    return F.when(F.size(bare) > 0, bare).when(F.size(polite) > 0, polite).otherwise(F.array_distinct(tokens))


def normalize_name(df: DataFrame, column: str, out: str = "name") -> DataFrame:
    """``df`` with ``out``: struct of full, core, dba (the last part, if there are several) and is_domain. The cleaned text is a column of its own first, as Python functions can't stand inside lambdas."""
    step = df.withColumns({"__raw": drop_id_tags(column)}).withColumns({"__clean": base_clean(domain_stem("__raw")), "__domain": is_domain("__raw")})
    parts = dba_parts(F.col("__clean"))
    step = step.withColumns({"__parts": parts}).withColumns({"__whole": join_single_letters(words(F.array_join("__parts", " "))), "__last": join_single_letters(words(F.coalesce(F.try_element_at("__parts", F.lit(-1)), F.lit(""))))})
    last = F.when(F.size("__parts") > 1, F.array_join(core_tokens(F.col("__last")), " ")).otherwise("")
    value = F.struct(F.array_join("__whole", " ").alias("full"), F.array_join(core_tokens(F.col("__whole")), " ").alias("core"), last.alias("dba"), F.col("__domain").alias("is_domain"))
    return step.withColumn(out, value).drop("__raw", "__clean", "__domain", "__parts", "__whole", "__last")


# Consonants after which an h falls, and what stands for letters that sound alike.
ASPIRATED, ALIKE = "bcdfgjkpqrstvxz", ("cqgxjzwbdf", "kkkkksvptp")


def skeleton_token(w: Column) -> Column:
    """What a word sounds like, roughly: h after a consonant falls, letters that sound alike become one, later vowels fall, repeats collapse. Numbers stay as they are."""
    alike = F.translate(F.regexp_replace(w, f"(?<=[{ASPIRATED}])h", ""), *ALIKE)
    bare = F.concat(F.substring(alike, 1, 1), F.regexp_replace(F.substr(alike, F.lit(2)), "[aeiouy]", ""))
    return F.when(w.rlike("^[0-9]+$"), w).otherwise(F.regexp_replace(bare, "(.)\\1+", "$1"))


def skeleton(clean: Column) -> Column:
    return F.array_join(F.transform(words(clean), skeleton_token), " ")


def canonical_words() -> dict[str, str]:
    groups = (g.split() for g in STREETS.replace("\n", "|").split("|"))
    return {form: first for first, *forms in groups for form in forms}


def canonical(w: Column) -> Column:
    """Street words in the form that stands for all."""
    table = F.create_map(*(F.lit(x) for pair in canonical_words().items() for x in pair))
    return F.coalesce(F.try_element_at(table, w), w)


def split_digits(c: Column) -> Column:
    """"12b" is "12 b"."""
    return F.regexp_replace(F.regexp_replace(c, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")


def gazetteer(country: str) -> dict[str, str]:
    """Forms of a state, cleaned -> its code."""
    if country == "US":
        return {k: k for k in US_STATES} | {v: k for k, v in US_STATES.items()}
    if country == "India":
        from re import sub

        code = {name: forms.split()[0] for name, forms in INDIA_STATES.items()}
        native = {sub("[^0-9a-z]+", " ", fold(form)).strip(): code[name] for name, forms in INDIA_NATIVE.items() for form in forms.split("|")}
        return code | {form: code[name] for name, forms in INDIA_STATES.items() for form in forms.split()} | native
    return {}


def full_names(country: str) -> str:
    """A pattern of the names of a country's states that are more than a code, longest first."""
    return r"\b(" + "|".join(sorted((x for x in gazetteer(country) if len(x) > 2), key=lambda x: (-len(x), x))) + r")\b"


def _coded(country: str) -> Callable[[Column], Column]:
    table = F.create_map(*(F.lit(x) for kv in gazetteer(country).items() for x in kv))
    return lambda x: F.try_element_at(table, x)


def _state_of(chunk: Column, country: Column) -> Column:
    """Code of the state that the digit-free words of an address chunk name; null if none."""
    bare = F.array_join(F.filter(words(chunk), lambda w: ~w.rlike("[0-9]")), " ")
    tables = [F.when(country == name, _coded(name)(bare)) for name in ("US", "India")]
    return F.coalesce(*tables)


def normalize_address(df: DataFrame, column: str, country: str = "country", out: str = "address") -> DataFrame:
    """``df`` with ``out``: struct of addr, state, postal, house, city, nums.

    The state is that of the last comma chunk that names one, else that of the last full name of a state inside the chunks, which its code then
    replaces; the city is the digit-free chunk before a state's chunk, else after it. State and city
    words are kept in ``addr``; unit designators ("suite") fall, the numbers after them stay. Postal: the first 6-digit number, else the
    first 5-digit number that is not the first number. House: the first other number.
    """
    cleaned = F.transform(F.split("__folded", ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), "['`’‘]", ""), "[^0-9a-z]+", " ")))
    step = df.withColumn("__folded", _fold(text(column))).withColumn("__chunks", F.filter(cleaned, lambda x: x != ""))
    step = step.withColumn("__states", F.transform("__chunks", lambda x: _state_of(x, F.col(country))))
    step = step.withColumn("__at", F.coalesce(F.array_max(F.transform("__states", lambda s, i: F.when(s.isNotNull(), i))), F.lit(-1)))
    chunks, states, at = F.col("__chunks"), F.col("__states"), F.col("__at")

    def city_at(i: Column) -> Column:
        chunk = F.get(chunks, i)
        return F.when((i >= 0) & chunk.isNotNull() & ~chunk.rlike("[0-9]") & F.get(states, i).isNull(), chunk)

    def state_chunk(x: Column, i: Column) -> Column:
        return F.trim(F.concat_ws(" ", F.get(states, i), F.array_join(F.filter(words(x), lambda w: w.rlike("[0-9]")), " ")))

    def other_chunk(x: Column) -> Column:
        suite = F.regexp_replace(split_digits(x), "(^| )ste ([0-9])", "$1suite $2")
        return F.array_join(F.filter(F.transform(words(suite), canonical), lambda w: ~w.isin(*UNITS)), " ")

    # Where no chunk is a state: the text around full names, and the names, of the countries that have a gazetteer.
    joined, none = F.array_join("__chunks", " "), F.array().cast("array<string>")
    for name in ("US", "India"):
        mine = (F.col(country) == name) & (at < 0)
        found = F.transform(F.regexp_extract_all(joined, F.lit(full_names(name))), _coded(name))
        step = step.withColumns({f"__in_{name}": F.when(mine, found).otherwise(none), f"__around_{name}": F.when(mine, F.split(joined, full_names(name))).otherwise(none)})
    inner = F.when(F.size("__in_US") > 0, F.col("__in_US")).otherwise(F.col("__in_India"))
    around = F.when(F.size("__in_US") > 0, F.col("__around_US")).otherwise(F.col("__around_India"))
    step = step.withColumns({"__inner": inner, "__around": around}).drop("__in_US", "__in_India", "__around_US", "__around_India")
    body = F.array_join(F.transform(chunks, lambda x, i: F.when(i == at, state_chunk(x, i)).otherwise(other_chunk(x))), " ")
    named = F.array_join(F.transform("__around", lambda x, i: F.concat_ws(" ", other_chunk(x), F.get(F.col("__inner"), i))), " ")
    step = step.withColumn("__tokens", words(F.when(F.size("__inner") > 0, named).otherwise(body))).withColumn("__nums", F.filter("__tokens", lambda w: w.rlike("^[0-9]+$")))
    nums = F.col("__nums")
    first, later = F.coalesce(F.get(nums, F.lit(0)), F.lit("")), F.filter(nums, lambda _, i: i > 0)
    postal = F.coalesce(F.get(F.filter(nums, lambda w: F.length(w) == 6), F.lit(0)), F.get(F.filter(later, lambda w: (F.length(w) == 5) & (w != first)), F.lit(0)), F.lit(""))
    step = step.withColumn("__postal", postal)
    value = F.struct(
        F.array_join("__tokens", " ").alias("addr"),
        F.when(at >= 0, F.get(states, at)).otherwise(F.coalesce(F.try_element_at("__inner", F.lit(-1)), F.lit(""))).alias("state"),
        F.col("__postal").alias("postal"),
        F.coalesce(F.get(F.filter(nums, lambda w: w != F.col("__postal")), F.lit(0)), F.lit("")).alias("house"),
        F.when(at >= 0, F.coalesce(city_at(at - 1), city_at(at + 1), F.lit(""))).otherwise(F.lit("")).alias("city"),
        F.array_join(nums, " ").alias("nums"),
    )
    return step.withColumn(out, value).drop("__folded", "__chunks", "__states", "__at", "__tokens", "__nums", "__postal", "__inner", "__around")


def strip_zeros(c: Column) -> Column:
    """House numbers without leading zeros."""
    return F.regexp_replace(c, "^0+(.)", "$1")


def pad_equal(a: Column, b: Column) -> Column:
    """Whether two house numbers are equal only once leading zeros are gone."""
    return (a != b) & (strip_zeros(a) == strip_zeros(b))


#: Regular-expression replacements of the older, simpler cleaner: longest legal form first.
SIMPLE_LEGAL = ["limited liability company", "private limited", "incorporated", "corporation", "company", "limited", "corp", "gmbh", "sarl", "sasu", "llc", "llp", "ltd", "pvt", "plc", "inc", "sas", "co", "sa"]
SIMPLE_ADDRESS = [("street", "st"), ("road", "rd"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("suite", "ste"), ("apartment", "apt"), ("building", "bldg"), ("floor", "fl"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w")]


# Fixed values of the older cleaner: what it writes out in names and in addresses, and which legal forms it then removes, longest first.
NAME_REPLACEMENTS = [("inc", "incorporated"), ("corp", "corporation"), ("ltd", "limited"), ("pvt", "private"), ("llc", "limited liability company"), ("co", "company")]
ADDRESS_REPLACEMENTS = [("st", "street"), ("rd", "road"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("ct", "court"), ("apt", "apartment"), ("ste", "suite"), ("hwy", "highway")]
SUFFIXES = ["limited liability company", "incorporated", "corporation", "limited", "private", "company"]


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def simple_clean(c: Column | str, replacements: list[tuple[str, str]] = ()) -> Column:
    """The older cleaner: lower case, NFKC, & is "and", word replacements, punctuation to spaces; letters of every script stay."""
    c = F.regexp_replace(F.replace(_nfkc(F.lower(text(c))), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " ")
    c = reduce(lambda x, r: F.regexp_replace(x, rf"(^|\s){r[0]}(?=\s|$)", f"$1{r[1]}"), replacements, c)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def remove_legal_suffixes(clean: Column, forms: list[str] = SIMPLE_LEGAL) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(clean, rf"(?:^|\s)(?:{'|'.join(forms)})(?=\s|$)", " "), r"\s+", " "))


def simple_normalised(df: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """``df`` with norm_name, norm_name_no_suffix and norm_address of the older cleaner; null names and addresses become empty."""
    filled = df.na.fill("", [name, address])
    out = filled.withColumn("norm_name", simple_clean(name, NAME_REPLACEMENTS))
    return out.withColumns({"norm_name_no_suffix": remove_legal_suffixes(F.col("norm_name"), SUFFIXES), "norm_address": simple_clean(address, ADDRESS_REPLACEMENTS)})
