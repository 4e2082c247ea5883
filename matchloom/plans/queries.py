"""The registered queries of the entity-resolution operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text, tokens
from ..functions.tokens import WEIGHTS
from ..operators import context, decide, difference, evaluation, features, folds, legacy_blocking, models, retrieval, shift, simulate, validate, weights
from ..sources import io
from ..sources.stage import staged
from . import sqltext as S
from . import views
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, so that both engines agree on the type."""
    return df.select(*(F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))


def result(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(longs(df), digits)


def cast_sql(columns: dict[str, str], source: str) -> str:
    """SELECT with longs (l), rounded doubles (d) and plain columns (p)."""
    form = {"l": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) AS {0}", "p": "{0}"}
    return "SELECT " + ", ".join(form[k].format(c) for c, k in columns.items()) + f" FROM {source}"


# --- text -----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.RECORDS} SELECT id, {S.clean('name_raw')} AS name, {S.clean('addr_raw')} AS addr, strip_accents(lower(name_raw)) AS folded, CAST(0 AS BIGINT) AS indic FROM rec")
def er_clean(spark: SparkSession, sf: str) -> DataFrame:
    rec = views.records(spark, sf)
    return rec.select("id", text.base_clean("name_raw").alias("name"), text.base_clean("addr_raw").alias("addr"), text.strip_accents("name_raw").alias("folded"), text.has_indic("name_raw").cast("long").alias("indic"))


@query(f"WITH {S.NORMALISED} SELECT id, name_full, name_core, name_dba, CAST(is_domain AS BIGINT) AS is_domain, name_skel FROM nrm")
def er_name(spark: SparkSession, sf: str) -> DataFrame:
    return views.normalised(spark, sf).select("id", "name_full", "name_core", "name_dba", F.col("is_domain").cast("long").alias("is_domain"), "name_skel")


@query(rf"SELECT page_id, regexp_matches(url, '{S.DOMAIN}')::BIGINT AS is_domain, {S.clean(f'''regexp_replace(url, '{S.DOMAIN}', ' {chr(92)}1 {chr(92)}2', 'g')''')} AS stem FROM pages")
def er_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.is_domain("url").cast("long").alias("is_domain"), text.base_clean(text.domain_stem("url")).alias("stem"))


def _address_sql() -> str:
    def pick(*values: str) -> str:
        return f"[{S.quoted(values)}][c_custkey % {len(values)} + 1]"

    def states(country: str) -> str:
        g = text.gazetteer(country)
        return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in g.items()) + "}"

    canon = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.canonical_words().items()) + "}"
    us = "c_custkey || " + pick(" N Oak St", " Main Street", "B Elm Ave.", " St. John's Blvd") + " || " + pick(", Suite 4", "", ", Bldg. 7", ", Apt #12") + " || " + pick(", Springfield, CA ", ", Los Ángeles, california ", ", Salem, OR ", ", Reno & Sparks, ") + " || (90000 + c_custkey % 977)"
    india = "'Plot ' || c_custkey || " + pick(", MG Rd", ", Sector 5", ", 2nd Cross") + " || " + pick(", Pune, Maharashtra", ", Mumbai, MH", ", Jaipur, Rajasthan ", ", Kochi") + " || " + pick(" - ", " ") + " || (400000 + c_custkey % 991)"
    other = "c_custkey || " + pick(" rue de l'Église", " Bd Voltaire") + " || ', 75011 Paris'"
    bare = "array_to_string(list_filter(string_split(x, ' '), lambda w: NOT regexp_matches(w, '[0-9]')), ' ')"
    one, two = chr(92) + "1", chr(92) + "2"
    parted = f"regexp_replace(regexp_replace(regexp_replace(x, '([0-9])([a-z])', '{one} {two}', 'g'), '([a-z])([0-9])', '{one} {two}', 'g'), '(^| )ste ([0-9])', '{one}suite {two}', 'g')"
    other_chunk = f"array_to_string(list_filter(list_transform(string_split({parted}, ' '), lambda w: coalesce({canon}[w], w)), lambda w: w NOT IN ({S.quoted(text.UNITS)})), ' ')"
    state_chunk = "trim(st[i] || ' ' || array_to_string(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '[0-9]')), ' '))"
    body = f"""CASE WHEN len(inner_) > 0 THEN array_to_string(list_transform(around, lambda x, i: {other_chunk} || ' ' || coalesce(inner_[i], '')), ' ')
        ELSE array_to_string(list_transform(ch, lambda x, i: CASE WHEN i = pos THEN {state_chunk} ELSE {other_chunk} END), ' ') END"""
    within = " ".join(f"WHEN country = '{c}' THEN list_transform(regexp_extract_all(whole, '{text.full_names(c)}', 1), lambda x: {states(c)}[x])" for c in ("US", "India"))
    return f"""
    WITH a0 AS (SELECT c_custkey AS id, {pick("US", "India", "France")} AS country, {us} AS us, {india} AS india, {other} AS other FROM customer),
    a1 AS (SELECT id, country, list_filter(list_transform(string_split(CASE country WHEN 'US' THEN us WHEN 'India' THEN india ELSE other END, ','), lambda x: {S.clean("x")}), lambda x: x <> '') AS ch FROM a0),
    a2 AS (SELECT *, list_transform(ch, lambda x: CASE country WHEN 'US' THEN {states("US")}[{bare}] WHEN 'India' THEN {states("India")}[{bare}] END) AS st FROM a1),
    a3 AS (SELECT *, coalesce(list_max(list_filter(list_transform(st, lambda s, i: CASE WHEN s IS NOT NULL THEN i END), lambda i: i IS NOT NULL)), 0) AS pos FROM a2),
    a3b AS (SELECT *, CASE WHEN pos > 0 THEN [] {within} ELSE [] END AS inner_, CASE country WHEN 'US' THEN regexp_split_to_array(whole, '{text.full_names("US")}') WHEN 'India' THEN regexp_split_to_array(whole, '{text.full_names("India")}') END AS around FROM (SELECT *, array_to_string(ch, ' ') AS whole FROM a3)),
    a4 AS (SELECT *, CASE WHEN pos > 0 THEN st[pos] ELSE coalesce(inner_[-1], '') END AS state,
        CASE WHEN pos = 0 THEN '' WHEN pos > 1 AND NOT regexp_matches(ch[pos - 1], '[0-9]') AND st[pos - 1] IS NULL THEN ch[pos - 1] WHEN pos < len(ch) AND NOT regexp_matches(ch[pos + 1], '[0-9]') AND st[pos + 1] IS NULL THEN ch[pos + 1] ELSE '' END AS city,
        {S.words(body)} AS tk FROM a3b),
    a5 AS (SELECT *, list_filter(tk, lambda w: regexp_full_match(w, '[0-9]+')) AS nm FROM a4),
    a6 AS (SELECT *, coalesce(list_filter(nm, lambda w: length(w) = 6)[1], list_filter(nm[2:], lambda w: length(w) = 5 AND w <> nm[1])[1], '') AS postal FROM a5)
    SELECT id, country, array_to_string(tk, ' ') AS addr, state, postal, coalesce(list_filter(nm, lambda w: w <> postal)[1], '') AS house, city, array_to_string(nm, ' ') AS nums FROM a6"""


@query(_address_sql())
def er_address(spark: SparkSession, sf: str) -> DataFrame:
    got = text.normalize_address(views.addresses(spark, sf), "address", "country", "a")
    return got.select("id", "country", "a.addr", "a.state", "a.postal", "a.house", "a.city", "a.nums")


@query("""
    WITH s AS (SELECT c_custkey AS s, c_nationkey AS country, regexp_extract(c_name, '#(.*)$', 1) AS h FROM customer), t AS (SELECT s_suppkey AS t, s_nationkey AS country, regexp_extract(s_name, '#(.*)$', 1) AS h FROM supplier)
    SELECT s, t, CAST(s.h = t.h AS BIGINT) AS equal, CAST(s.h <> t.h AND regexp_replace(s.h, '^0+(.)', '\\1') = regexp_replace(t.h, '^0+(.)', '\\1') AS BIGINT) AS pad FROM s JOIN t USING (country) WHERE right(s.h, 2) = right(t.h, 2)
""")
def er_house_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of a nation whose zero-padded numbers end alike."""
    digits = lambda c: F.regexp_extract(c, "#(.*)$", 1)
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("country"), digits("c_name").alias("hs")).withColumn("tail", F.right("hs", F.lit(2)))
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("t"), F.col("s_nationkey").alias("country"), digits("s_name").alias("ht")).withColumn("tail", F.right("ht", F.lit(2)))
    return s.join(t, ["country", "tail"]).select("s", "t", (F.col("hs") == F.col("ht")).cast("long").alias("equal"), text.pad_equal(F.col("hs"), F.col("ht")).cast("long").alias("pad"))


_SIMPLE = r"""trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def _simple_words(x: str, replacements: list[tuple[str, str]]) -> str:
    table_ = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in replacements) + "}"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce({table_}[w], w)), ' ')"


_SUFFIX = "trim(regexp_replace(regexp_replace(' ' || replace({0}, ' ', '  ') || ' ', ' (" + "|".join(x.replace(" ", "  ") for x in text.SUFFIXES) + ") ', ' ', 'g'), ' +', ' ', 'g'))"
_SIMPLE_REC = f"{S.RECORDS}, sc AS (SELECT id, src, 'land ' || country AS country, CAST(id AS VARCHAR) AS entity_id, {_simple_words(_SIMPLE.format('name_raw'), text.NAME_REPLACEMENTS)} AS norm_name, {_simple_words(_SIMPLE.format('addr_raw'), text.ADDRESS_REPLACEMENTS)} AS addr FROM rec), sr AS (SELECT *, {_SUFFIX.format('norm_name')} AS name FROM sc)"


def _simple(spark: SparkSession, sf: str) -> DataFrame:
    rec = text.simple_normalised(views.records(spark, sf), "name_raw", "addr_raw")
    return rec.select("id", "src", F.concat(F.lit("land "), "country").alias("country"), F.col("id").cast("string").alias("entity_id"), "norm_name", F.col("norm_name_no_suffix").alias("name"), F.col("norm_address").alias("addr"))


@query(f"WITH {_SIMPLE_REC} SELECT id, norm_name, name, addr FROM sr")
def er_simple_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _simple(spark, sf).select("id", "norm_name", "name", "addr")


# --- tokens, weights, retrieval -------------------------------------------------------------------------------------------------------


@query(f"WITH {S.TOKENS} SELECT id, channel, token FROM tok")
def er_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.long_tokens(views.normalised(spark, sf), ["id"])


@query(f"WITH {S.POSTINGS} SELECT src, country, channel, token, CAST(df_s AS BIGINT) AS df_s, CAST(df_t AS BIGINT) AS df_t, round(idf, 6) AS idf, CAST(df_t <= greatest(200, floor(0.002 * n_t)) AS BIGINT) AS indexed FROM idf")
def er_idf(spark: SparkSession, sf: str) -> DataFrame:
    rec = views.normalised(spark, sf)
    sizes = rec.where("src > 1").groupBy("src", "country").agg(F.count(F.lit(1)).alias("n_t")).join(rec.where("src = 1").groupBy("country").agg(F.count(F.lit(1)).alias("n_s")), "country")
    toks = tokens.long_tokens(rec, ["id", "src", "country"])
    s = toks.where("src = 1").drop("src").join(sizes.select("src", "country"), "country")
    got = weights.idf(weights.document_frequency(s, toks.where("src > 1")), sizes)
    return rounded(got.select("src", "country", "channel", "token", "df_s", "df_t", "idf", (F.col("df_t") <= weights.cap(F.col("n_t"))).cast("long").alias("indexed")))


@query(f"WITH {S.POSTINGS} SELECT src, id, channel, token, round(w, 6) AS w FROM ws UNION ALL SELECT src, id, channel, token, round(w, 6) FROM wt")
def er_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = views.postings(spark, sf)
    keep = ["src", "id", "channel", "token", "w"]
    return rounded(p.s.select(*keep).unionByName(p.t.select(*keep)))


@query(f"WITH {S.FORWARD} SELECT src, s, t, CAST(hit AS BIGINT) AS hit FROM fwd")
def er_forward(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.forward(retrieval.best(views.postings(spark, sf)))
    each = F.array(*(F.when(F.col("hit").bitwiseAND(retrieval.HIT[search]) > 0, F.lit(retrieval.HIT[search]).cast("long")) for search in retrieval.TOP))
    return hits.select("src", "s", "t", F.explode(F.array_compact(each)).alias("hit"))


@query(f"WITH {S.POSTINGS},{S.REVERSE} SELECT src, s, t, CAST(rrank AS BIGINT) AS rrank FROM rev")
def er_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.reverse(retrieval.best(views.postings(spark, sf))).withColumn("rrank", F.col("rrank").cast("long"))


_CAND = {"src": "l", "s": "p", "t": "p", "hit": "l", "rrank": "l"} | {f"cos_{c}": "d" for c in WEIGHTS} | {"score": "d"}


@query(f"WITH {S.CANDIDATES} {cast_sql(_CAND, 'cs')}")
def er_cosines(spark: SparkSession, sf: str) -> DataFrame:
    return result(retrieval.searched(retrieval.best(views.postings(spark, sf))))


@query(f"WITH {S.CANDIDATES} {cast_sql(_CAND | {'rank': 'l'}, 'cand')}")
def er_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return result(retrieval.candidates(views.postings(spark, sf)))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.staged_candidates(views.postings(spark, sf))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, the true pairs among them, and the number of all true pairs (src, n_true), which are never rows."""
    found, copies = _candidates(spark, sf), views.copies(spark, sf)
    return found, views.true_among(copies, found), views.true_numbers(copies, found)


_ASKED = "asked AS (SELECT DISTINCT src, s FROM cand), fd AS (SELECT truth.src, truth.s, truth.t, hit, rank, score FROM truth SEMI JOIN asked USING (src, s) LEFT JOIN cand USING (src, s, t))"
_METRICS = {"union": "rank IS NOT NULL"} | {f"by_{n}": f"coalesce(hit, 0) & {b} > 0" for n, b in evaluation.BITS.items()} | {f"at_{k}": f"coalesce(rank < {k}, false)" for k in evaluation.AT}


@query(f"WITH {S.CANDIDATES},{S.TRUTH}, {_ASKED} " + " UNION ALL ".join(f"SELECT CAST(src AS BIGINT) AS src, '{n}' AS metric, round(avg(CAST({c} AS INTEGER)), 6) AS value FROM fd GROUP BY src" for n, c in _METRICS.items()))
def er_recall(spark: SparkSession, sf: str) -> DataFrame:
    found, true, numbers = _judged(spark, sf)
    return result(evaluation.recall(true, found, numbers))


@query(f"WITH {S.CANDIDATES},{S.TRUTH} SELECT CAST(src AS BIGINT) AS src, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS q{int(100 * q):02d}" for q in (0.01, 0.05, 0.1, 0.5)) + " FROM truth JOIN cand USING (src, s, t) GROUP BY src")
def er_score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found, true, _ = _judged(spark, sf)
    return result(evaluation.score_quantiles(true, found))


def _sweep_sql() -> str:
    parts = []
    for i, (a, b, c, d) in enumerate(evaluation.SWEEP):
        rule = f"(r1 <= {a} OR r2 <= {b} OR r3 <= {c} OR r4 <= {d})"
        parts += [f"SELECT src, {i} AS rule, {v} AS with_reverse, sum(CASE WHEN {k} THEN y ELSE 0 END) AS hits, sum(CAST({k} AS INTEGER)) AS kept, count(DISTINCT s) AS n_s FROM mk GROUP BY src" for v, k in ((0, rule), (1, f"({rule} OR hit & 8 > 0)"))]
    return f"""WITH {S.CANDIDATES},{S.TRUTH}, {_ASKED},
    mk AS (SELECT c.src, c.s, c.t, c.hit, CASE WHEN truth.t IS NULL THEN 0 ELSE 1 END AS y,
        row_number() OVER (PARTITION BY c.src, c.s ORDER BY score DESC, c.t) AS r1, row_number() OVER (PARTITION BY c.src, c.s ORDER BY round(cos_a + cos_x, 9) DESC, c.t) AS r2,
        row_number() OVER (PARTITION BY c.src, c.s ORDER BY round(cos_n + cos_g + cos_k + cos_p, 9) DESC, c.t) AS r3, row_number() OVER (PARTITION BY c.src, c.s ORDER BY round(cos_m, 9) DESC, c.t) AS r4
        FROM cand c LEFT JOIN truth ON truth.src = c.src AND truth.s = c.s AND truth.t = c.t),
    nt AS (SELECT src, count(*) AS n_true FROM fd GROUP BY src)
    SELECT CAST(x.src AS BIGINT) AS src, CAST(rule AS BIGINT) AS rule, CAST(with_reverse AS BIGINT) AS with_reverse, round(hits / n_true, 6) AS recall, round(kept / n_s, 6) AS pairs_per_s FROM ({" UNION ALL ".join(parts)}) x JOIN nt ON nt.src = x.src"""


@query(_sweep_sql())
def er_prune_sweep(spark: SparkSession, sf: str) -> DataFrame:
    found, true, numbers = _judged(spark, sf)
    return result(evaluation.prune_sweep(true, found, numbers))


_CTX = {c: "d" for c in ("grp_gap", "grp_gap2", "grp_gap_a", "grp_gap_n", "rev_gap", "rev_gap2")} | {c: "l" for c in ("grp_rank", "grp_n", "grp_rank_a", "grp_rank_n", "rev_rank", "rev_n")}


def _margin_sql(v: str, rank: str, w: str, order: str, lone: str = "NULL") -> str:
    return f"CASE WHEN {rank} = 1 THEN {v} - coalesce(nth_value({v}, 2) OVER ({w} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), {lone}) ELSE {v} - max({v}) OVER ({w}) END"


@query(f"""WITH {S.CANDIDATES}, x AS (SELECT *, row_number() OVER (PARTITION BY src, s ORDER BY score DESC, t) AS fr, row_number() OVER (PARTITION BY src, s ORDER BY cos_a DESC, t) AS ar, row_number() OVER (PARTITION BY src, s ORDER BY cos_n DESC, t) AS nr, row_number() OVER (PARTITION BY src, t ORDER BY score DESC, s) AS rr FROM cand),
    y AS (SELECT src, s, t, fr - 1 AS grp_rank, score - max(score) OVER (PARTITION BY src, s) AS grp_gap, count(*) OVER (PARTITION BY src, s) AS grp_n, {_margin_sql("score", "fr", "PARTITION BY src, s", "score DESC, t")} AS grp_gap2,
        ar - 1 AS grp_rank_a, cos_a - max(cos_a) OVER (PARTITION BY src, s) AS grp_gap_a, nr - 1 AS grp_rank_n, cos_n - max(cos_n) OVER (PARTITION BY src, s) AS grp_gap_n,
        rr - 1 AS rev_rank, score - max(score) OVER (PARTITION BY src, t) AS rev_gap, count(*) OVER (PARTITION BY src, t) AS rev_n, {_margin_sql("score", "rr", "PARTITION BY src, t", "score DESC, s")} AS rev_gap2 FROM x)
    {cast_sql({"src": "l", "s": "p", "t": "p"} | _CTX, "y").replace(", 6)", ", 9)")}""")
def er_candidate_context(spark: SparkSession, sf: str) -> DataFrame:
    return result(context.candidate_context(_candidates(spark, sf)).select("src", "s", "t", *_CTX), 9)


@query(f"WITH {S.CANDIDATES} SELECT CAST(src AS BIGINT) AS src, s, t, CAST(hit & 1 > 0 AS BIGINT) AS hit_name, CAST(hit & 2 > 0 AS BIGINT) AS hit_addr, CAST(hit & 4 > 0 AS BIGINT) AS hit_comb, CAST(hit & 8 > 0 AS BIGINT) AS hit_rev, CAST(src = 3 AS BIGINT) AS is_s3 FROM cand")
def er_hit_bits(spark: SparkSession, sf: str) -> DataFrame:
    got = _candidates(spark, sf).withColumns(folds.hit_bits(F.col("hit")) | {"is_s3": (F.col("src") == 3).cast("int")})
    return longs(got.select("src", "s", "t", "hit_name", "hit_addr", "hit_comb", "hit_rev", "is_s3"))


@query(f"WITH {S.CANDIDATES},{S.TRUTH} SELECT CAST(cand.src AS BIGINT) AS src, cand.s, cand.t, CAST(truth.t IS NOT NULL AS BIGINT) AS label FROM cand LEFT JOIN (SELECT DISTINCT * FROM truth) truth ON truth.src = cand.src AND truth.s = cand.s AND truth.t = cand.t")
def er_labels(spark: SparkSession, sf: str) -> DataFrame:
    found, true, _ = _judged(spark, sf)
    return longs(folds.labelled(found, true).select("src", "s", "t", "label"))


# --- older blockers -------------------------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rec = staged(_simple(spark, sf).select("src", "country", "entity_id", "name", "addr"), "simple")  # each blocker reads it again
    return rec.where("src = 1"), rec.where("src > 1")


def _capped(key: str, most: int, where: str = "true", side: str = "sr") -> str:
    return f"""SELECT DISTINCT a.entity_id AS s, b.entity_id AS t FROM (SELECT DISTINCT entity_id, country, {key} AS k FROM {side} WHERE src = 1) a
        JOIN (SELECT *, count(*) OVER (PARTITION BY country, k) AS c FROM (SELECT entity_id, country, {key} AS k FROM {side} WHERE src > 1) WHERE {where}) b USING (country, k) WHERE c <= {most} AND {where}"""


def _prefix_sql() -> str:
    return " UNION ".join(_capped(f"name[1:{n}]", 500, f"length(country) + 1 + length(k) > {3 + n}") for n in (3, 4, 5))


_NAME_TOKEN = _capped("unnest(list_filter(string_split(name, ' '), lambda w: length(w) >= 4))", 200)
_ADDR_TOKEN = _capped(r"unnest(list_filter(string_split(addr, ' '), lambda w: regexp_full_match(w, '\p{N}{3,}|\p{L}{5,}')))", 300)
_UNION = f"({_prefix_sql()}) UNION ({_NAME_TOKEN}) UNION ({_ADDR_TOKEN})"


@query(f"WITH {_SIMPLE_REC} {_prefix_sql()}")
def er_block_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return legacy_blocking.by_name_prefix(*_sides(spark, sf))


@query(f"WITH {_SIMPLE_REC} {_NAME_TOKEN}")
def er_block_name_token(spark: SparkSession, sf: str) -> DataFrame:
    return legacy_blocking.by_name_token(*_sides(spark, sf))


@query(f"WITH {_SIMPLE_REC} {_ADDR_TOKEN}")
def er_block_address_token(spark: SparkSession, sf: str) -> DataFrame:
    return legacy_blocking.by_address_token(*_sides(spark, sf))


def _ngram_sql(column: str, name: str, k: int = 10, distance: float = 0.7) -> str:
    """CTEs that end in ``name`` (s, t): the k nearest targets on character n-grams of a column, by country."""
    grams = " UNION ALL ".join(f"SELECT side, entity_id, country, unnest(CASE WHEN length(w) <= {n} THEN [w] ELSE list_transform(range(1, length(w) - {n - 2}), lambda i: w[i : i + {n - 1}]) END) AS g FROM {name}w" for n in (3, 4, 5))
    return f"""
    {name}w AS (SELECT CASE WHEN src = 1 THEN 0 ELSE 1 END AS side, entity_id, country, ' ' || unnest(list_filter(string_split({column}, ' '), lambda w: w <> '')) || ' ' AS w FROM sr),
    {name}f AS (SELECT side, entity_id, country, g, count(*) AS tf FROM ({grams}) GROUP BY ALL),
    {name}d AS (SELECT country, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {name}f JOIN (SELECT country, count(*) AS n FROM sr GROUP BY country) USING (country) GROUP BY country, g HAVING count(*) >= 2 AND count(*) <= 0.9 * any_value(n)),
    {name}v AS (SELECT side, entity_id, country, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY side, entity_id)) AS v FROM {name}f JOIN {name}d USING (country, g)),
    {name} AS (SELECT s, t FROM (SELECT a.entity_id AS s, b.entity_id AS t, round(sum(a.v * b.v), 9) AS score FROM {name}v a JOIN {name}v b USING (country, g) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)
        WHERE score > 1 - {distance} QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, t) <= {k})"""


_NEAR = f"{_ngram_sql('name', 'nn')}, {_ngram_sql('addr', 'na')}"
_ALL = f"{_UNION} UNION SELECT s, t FROM nn UNION SELECT s, t FROM na"


@query(f"WITH {_SIMPLE_REC},{_NEAR}, u AS ({_ALL}) SELECT sr.entity_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS candidates FROM sr LEFT JOIN u ON u.s = sr.entity_id WHERE sr.src = 1 GROUP BY sr.entity_id")
def er_block_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the five blockers as one list an entity, empty lists included."""
    s, t = _sides(spark, sf)
    return legacy_blocking.candidate_lists(s, legacy_blocking.all_blocks(s, t))


@query(f"WITH {_SIMPLE_REC},{S.TRUTH},{_NEAR}, u AS ({_ALL}) SELECT count(*) AS n_true, count(u.t) AS n_found, round(count(u.t) / count(*), 6) AS recall FROM truth LEFT JOIN u ON u.s = CAST(truth.s AS VARCHAR) AND u.t = CAST(truth.t AS VARCHAR)")
def er_block_recall(spark: SparkSession, sf: str) -> DataFrame:
    s, t = _sides(spark, sf)
    copies = views.copies(spark, sf).withColumn("id", F.col("id").cast("string"))
    return result(evaluation.block_recall(copies, legacy_blocking.all_blocks(s, t)))


@query(f"WITH {_SIMPLE_REC},{_NEAR} SELECT s, t, 'name' AS \"by\" FROM nn UNION ALL SELECT s, t, 'addr' FROM na")
def er_block_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours on character n-grams of name and of address."""
    s, t = _sides(spark, sf)
    return legacy_blocking.tfidf_neighbours(s, t, "name").withColumn("by", F.lit("name")).unionByName(legacy_blocking.tfidf_neighbours(s, t, "addr").withColumn("by", F.lit("addr")))


@query(f"WITH {S.RECORDS} SELECT country FROM rec WHERE src = 1 INTERSECT SELECT country FROM rec WHERE src > 1")
def er_shared_countries(spark: SparkSession, sf: str) -> DataFrame:
    rec = views.records(spark, sf)
    return legacy_blocking.shared_countries(rec.where("src = 1"), rec.where("src > 1"))


# --- profiles -------------------------------------------------------------------------------------------------------------------------

_PROFILED = ("text", "lang", "source")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_null, count(DISTINCT {c}) AS n_distinct, count({c}) - count(DISTINCT {c}) AS n_duplicate, CAST(min(length({c})) AS BIGINT) AS min_len, round(avg(length({c})), 6) AS mean_len, CAST(max(length({c})) AS BIGINT) AS max_len FROM documents" for c in _PROFILED))
def er_profile(spark: SparkSession, sf: str) -> DataFrame:
    return result(evaluation.profile(table(spark, sf, "documents"), list(_PROFILED)))


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def er_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.value_counts(table(spark, sf, "documents"), "lang")


@query(f"WITH {S.TRUTH}, l AS (SELECT id, count(t) AS c FROM trd LEFT JOIN truth ON truth.s = trd.id WHERE trd.src = 1 GROUP BY id) SELECT CAST(c AS BIGINT) AS n_matches, count(*) AS n_entities, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY c")
def er_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return result(evaluation.match_counts(_truth_lists(spark, sf), "matched_entity_ids"))


def _truth_lists(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).alias("src"), F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"))
    pairs = views.truth(spark, sf).select(F.concat(F.lit("S1-"), F.col("s").cast("string")).alias("s"), F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("t").cast("string")).alias("t"))
    return io.match_lists(ids.where("src = 1").select("entity_id"), pairs)


@query(f"WITH {S.TRUTH} SELECT 'S1-' || trd.id AS source1_entity_id, coalesce(string_agg('S' || truth.src || '-' || truth.t, ',' ORDER BY 'S' || truth.src || '-' || truth.t), '') AS matched_entity_ids FROM trd LEFT JOIN truth ON truth.s = trd.id WHERE trd.src = 1 GROUP BY trd.id")
def er_match_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _truth_lists(spark, sf)


@query(f"WITH {S.TRUTH} SELECT CAST(src AS BIGINT) AS src, 'S1-' || s AS s, 'S' || src || '-' || t AS t FROM truth")
def er_truth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lists written, split and exploded again."""
    return longs(evaluation.truth_pairs(_truth_lists(spark, sf)))


@query(f"WITH {S.SCORED} SELECT count(*) AS n_pairs, count(DISTINCT s) AS n_matched, (SELECT count(*) FROM orders) AS n_entities, round(count(*) / count(DISTINCT s), 6) AS per_matched FROM sp WHERE p2 >= 0.5")
def er_output_summary(spark: SparkSession, sf: str) -> DataFrame:
    return result(evaluation.output_summary(views.scored(spark, sf).where("p2 >= 0.5"), views.entities(spark, sf)))


# --- windows --------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.SCORED} SELECT CAST(src AS BIGINT) AS src, s, t, row_number() OVER w - 1 AS rank, round(max(p1) OVER (PARTITION BY src, t), 6) AS max, count(*) OVER (PARTITION BY src, t) AS n, round(nth_value(p1, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS second FROM sp WINDOW w AS (PARTITION BY src, t ORDER BY p1 DESC, s)")
def er_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return result(context.group_stats(views.scored(spark, sf), ["src", "t"], "p1", ["s"]).select("src", "s", "t", "rank", "max", "n", "second"))


_PCTX = {c: "l" for c in ("g_rank", "g_high", "s_rank", "s_high", "t_rank", "t_high", "t_n", "g_n")} | {c: "d" for c in ("g_gap", "g_gap2", "g_sum", "s_gap", "s_sum", "t_gap", "t_gap2", "t_sum")}


def _pctx_sql() -> str:
    g, s, t = "PARTITION BY s, src", "PARTITION BY s", "PARTITION BY src, t"
    high = "sum(CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END) OVER ({0})"
    return f"""x AS (SELECT *, row_number() OVER ({g} ORDER BY p1 DESC, t) AS gr, row_number() OVER ({s} ORDER BY p1 DESC, src, t) AS sr, row_number() OVER ({t} ORDER BY p1 DESC, s) AS tr FROM sp),
    pc AS (SELECT src, s, t, p1, gr - 1 AS g_rank, p1 - max(p1) OVER ({g}) AS g_gap, {_margin_sql("p1", "gr", g, "p1 DESC, t", "0")} AS g_gap2, sum(p1) OVER ({g}) AS g_sum, {high.format(g)} AS g_high,
        sr - 1 AS s_rank, p1 - max(p1) OVER ({s}) AS s_gap, sum(p1) OVER ({s}) AS s_sum, {high.format(s)} AS s_high,
        tr - 1 AS t_rank, {_margin_sql("p1", "tr", t, "p1 DESC, s", "0")} AS t_gap, p1 - max(p1) OVER ({t}) AS t_gap2, sum(p1) OVER ({t}) AS t_sum, {high.format(t)} AS t_high, count(*) OVER ({t}) AS t_n, count(*) OVER ({g}) AS g_n FROM x)"""


@query(f"WITH {S.SCORED}, {_pctx_sql()} {cast_sql({'src': 'l', 's': 'p', 't': 'p'} | _PCTX, 'pc')}")
def er_probability_context(spark: SparkSession, sf: str) -> DataFrame:
    return result(context.probability_context(views.scored(spark, sf)).select("src", "s", "t", *_PCTX))


@query(f"WITH {S.SCORED}, {_pctx_sql()} {cast_sql({'src': 'l', 's': 'p', 't': 'p'} | _PCTX, 'pc')} WHERE p1 >= 0.5")
def er_admitted_context(spark: SparkSession, sf: str) -> DataFrame:
    return result(context.admitted_context(views.scored(spark, sf), 0.5).select("src", "s", "t", *_PCTX))


# --- decisions ------------------------------------------------------------------------------------------------------------------------

_KEYS = "CAST(src AS BIGINT) AS src, s, t"


@query(f"WITH {S.SCORED} SELECT {_KEYS} FROM sp WHERE p2 >= 0.8")
def er_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return longs(decide.threshold(views.scored(spark, sf), 0.8, "p2").select("src", "s", "t"))


@query(f"WITH {S.SCORED} SELECT {_KEYS} FROM sp QUALIFY row_number() OVER (PARTITION BY src, t ORDER BY p2 DESC, s) = 1")
def er_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return longs(decide.exclusive(views.scored(spark, sf), "p2").select("src", "s", "t"))


@query(f"WITH {S.SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY src, t ORDER BY p1 DESC, s) - 1 AS r FROM sp) SELECT {_KEYS} FROM x WHERE p2 >= 0.5 AND r = 0")
def er_threshold_top(spark: SparkSession, sf: str) -> DataFrame:
    ranked = context.group_stats(views.scored(spark, sf), ["src", "t"], "p1", ["s"], "p1_t_")
    return longs(decide.apply_rule(ranked, {"kind": "threshold_top", "prob": "p2", "threshold": 0.5}).select("src", "s", "t"))


@query(f"WITH {S.SCORED}, e AS ({S.expected_f('sp', '0.02', '1.5', '0.4', 'p2')}) SELECT {_KEYS} FROM e")
def er_expected_f(spark: SparkSession, sf: str) -> DataFrame:
    return longs(decide.expected_f(views.scored(spark, sf), 0.02, 1.5, 0.4, "p2").select("src", "s", "t"))


@query(f"WITH {S.SCORED}, e AS ({S.expected_f('sp', '0.02', '1.5', '0.4', 'p2')}) SELECT {_KEYS} FROM e QUALIFY row_number() OVER (PARTITION BY src, t ORDER BY p2 DESC, s) = 1")
def er_final_rule(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"kind": "expected_f", "prob": "p2", "miss": 0.02, "alpha": 1.5, "min_p": 0.4, "exclusive": True}
    return longs(decide.apply_rule(views.scored(spark, sf), rule).select("src", "s", "t"))


@query(f"WITH {S.SCORED},{S.TRUE_COUNTS}, e AS ({S.expected_f('sp', '0.02', '1.5', '0.4', 'p2')}), x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, t ORDER BY p2 DESC, s) = 1) SELECT round(({S.macro('x')}), 6) AS macro_f05")
def er_macro_f05(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"kind": "expected_f", "prob": "p2", "miss": 0.02, "alpha": 1.5, "min_p": 0.4, "exclusive": True}
    return rounded(decide.macro_f05(views.true_counts(spark, sf), decide.apply_rule(views.scored(spark, sf), rule)))


@query(f"WITH {S.SCORED},{S.TRUE_COUNTS} SELECT s, CAST(n_true AS BIGINT) AS n_true FROM tc")
def er_true_counts(spark: SparkSession, sf: str) -> DataFrame:
    return longs(decide.true_counts(views.entities(spark, sf), views.scored(spark, sf).where("label = 1")))


@query(f"WITH {S.SCORED} SELECT CAST(sum(label) AS BIGINT) AS tp, count(*) AS n_pred, (SELECT count(*) FROM sp WHERE label = 1) AS n_true, round(sum(label) / count(*), 6) AS precision, round(sum(label) / (SELECT count(*) FROM sp WHERE label = 1), 6) AS recall FROM sp WHERE p2 >= 0.8")
def er_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    sp = views.scored(spark, sf)
    return result(decide.pair_precision_recall(sp.where("p2 >= 0.8"), sp.where("label = 1")))


def _grid_sql(where: str = "true", name: str = "g") -> str:
    """Macro F of all rules, over the entities for which ``where`` holds."""
    n = f"(SELECT count(*) FROM tc WHERE {where})"
    empty = f"(SELECT sum(CASE WHEN n_true = 0 THEN 1.0 ELSE 0.0 END) FROM tc WHERE {where})"
    score = f"round((sum({S.F05}) - sum(CASE WHEN n_true = 0 THEN 1.0 ELSE 0.0 END) + any_value({empty})) / any_value({n}), 6)"
    out = [f"{name}_top AS (SELECT *, row_number() OVER (PARTITION BY src, t ORDER BY p1 DESC, s) = 1 AS top FROM sp WHERE {where})", f"{name}_th AS (SELECT unnest([{', '.join(map(str, decide.THRESHOLDS))}])::DOUBLE AS threshold)", f"{name}_g AS (SELECT m.m::DOUBLE AS miss, a.a::DOUBLE AS alpha, x.x::DOUBLE AS min_p FROM (SELECT unnest({list(decide.MISS)}) AS m) m, (SELECT unnest({list(decide.ALPHA)}) AS a) a, (SELECT unnest({list(decide.MIN_P)}) AS x) x)", f"{name}_rows AS (SELECT src, s, t, label, p2, miss, alpha, min_p FROM sp, {name}_g WHERE {where})", f"{name}_e AS ({S.expected_f(f'{name}_rows', 'miss', 'alpha', 'min_p', 'p2', 'miss, alpha, min_p, ')})"]
    parts = []
    for p in ("p1", "p2"):
        for kind, top in (("threshold", "true"), ("threshold_top", "top")):
            parts.append(f"SELECT '{kind}' AS kind, '{p}' AS prob, threshold, NULL::DOUBLE AS miss, NULL::DOUBLE AS alpha, NULL::DOUBLE AS min_p, {score} AS macro_f05 FROM (SELECT threshold, s, sum(label) AS tp, count(*) AS n_pred FROM {name}_top, {name}_th WHERE {p} >= threshold AND {top} GROUP BY threshold, s) JOIN tc USING (s) GROUP BY threshold")
    parts.append(f"SELECT 'expected_f', 'p2', NULL::DOUBLE, miss, alpha, min_p, {score} FROM (SELECT miss, alpha, min_p, s, sum(label) AS tp, count(*) AS n_pred FROM {name}_e GROUP BY ALL) JOIN tc USING (s) GROUP BY miss, alpha, min_p")
    return ", ".join(out) + f", {name} AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {S.SCORED},{S.TRUE_COUNTS}, {_grid_sql()} SELECT * FROM g")
def er_rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decide.rule_grid(views.scored(spark, sf), views.true_counts(spark, sf)))


_HALF = "CAST('0x' || substr(md5(CAST(s AS VARCHAR)), 1, 8) AS BIGINT) % 2 = {0}"


@query(f"WITH {S.SCORED},{S.TRUE_COUNTS}, {_grid_sql(_HALF.format(0), 'a')}, {_grid_sql(_HALF.format(1), 'b')}, best AS (SELECT * FROM a ORDER BY macro_f05 DESC, kind, prob, threshold NULLS FIRST, miss NULLS FIRST, alpha NULLS FIRST, min_p NULLS FIRST LIMIT 1) SELECT best.* EXCLUDE (macro_f05), best.macro_f05 AS tuned, b.macro_f05 AS honest FROM best JOIN b ON b.kind = best.kind AND b.prob = best.prob AND b.threshold IS NOT DISTINCT FROM best.threshold AND b.miss IS NOT DISTINCT FROM best.miss AND b.alpha IS NOT DISTINCT FROM best.alpha AND b.min_p IS NOT DISTINCT FROM best.min_p")
def er_half_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decide.honest_half_split(views.scored(spark, sf), views.true_counts(spark, sf)))


# --- priors, folds, look-ups ----------------------------------------------------------------------------------------------------------


def _by_nation(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("s"), F.col("c_nationkey").alias("nation"))
    return views.scored(spark, sf).join(nation, "s")


_NATION = f"WITH {S.SCORED}, sn AS (SELECT sp.*, c_nationkey AS nation FROM sp JOIN orders ON o_orderkey = s JOIN customer ON c_custkey = o_custkey)"


@query(f"{_NATION} SELECT CAST(nation AS BIGINT) AS nation, round(avg(label), 6) AS prior FROM sn GROUP BY nation")
def er_prior(spark: SparkSession, sf: str) -> DataFrame:
    return result(shift.priors(_by_nation(spark, sf), ["nation"]))


_EM = f"""{_NATION.replace("WITH ", "WITH RECURSIVE ", 1)},
    h AS (SELECT nation, least(floor(p1 * 10000), 9999) AS bin, CAST(count(*) AS DOUBLE) AS n, avg(p1) AS m FROM sn GROUP BY ALL), pr AS (SELECT nation, avg(label) AS prior FROM sn GROUP BY nation), hp AS (SELECT h.*, prior FROM h JOIN pr USING (nation)),
    em AS (
        SELECT nation, 0 AS step, prior AS v, false AS done FROM pr
        UNION ALL SELECT nation, any_value(step) + 1, sum(n * (v / prior * m) / (v / prior * m + (1 - v) / (1 - prior) * (1 - m))) / sum(n),
            abs(sum(n * (v / prior * m) / (v / prior * m + (1 - v) / (1 - prior) * (1 - m))) / sum(n) - any_value(v)) < 1e-8
        FROM em JOIN hp USING (nation) WHERE NOT done AND step < 500 GROUP BY nation
    ),
    settled AS (SELECT nation, arg_max(v, step) AS v FROM em GROUP BY nation)"""


@query(f"{_EM} SELECT CAST(nation AS BIGINT) AS nation, round(prior, 6) AS prior, round(v, 6) AS target FROM settled JOIN pr USING (nation)")
def er_em_prior(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_nation(spark, sf)
    return result(shift.em_prior(rows, shift.priors(rows, ["nation"]), ["nation"], "p1"))


@query(f"{_EM} SELECT {_KEYS}, round((v / prior * p1) / (v / prior * p1 + (1 - v) / (1 - prior) * (1 - p1)), 6) AS p_adj FROM sn JOIN settled USING (nation) JOIN pr USING (nation)")
def er_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_nation(spark, sf)
    return result(shift.corrected(rows, rows, ["nation"], "p1").select("src", "s", "t", "p_adj"))


@query("SELECT o_orderkey AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'noaddr' WHEN o_custkey % 3 = 0 THEN 'house_na' WHEN o_custkey % 3 = 1 THEN 'house_eq' ELSE 'house_ne' END AS segment FROM orders")
def er_segments(spark: SparkSession, sf: str) -> DataFrame:
    house = F.when(F.col("o_custkey") % 3 == 1, 1).when(F.col("o_custkey") % 3 == 2, 0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("s"), shift.segment((F.col("o_orderkey") % 7 == 0).cast("int"), house).alias("segment"))


_BUCKET = "CAST('0x' || substr(md5('{1}' || CAST({0} AS VARCHAR)), 1, 8) AS BIGINT)"


def _fold_sql(key: str) -> str:
    upto, out = 0.0, []
    for name, part in folds.SHARES.items():
        upto += part
        out.append(f"WHEN {_BUCKET.format(key, '')} / 4294967296.0::DOUBLE < {round(upto, 9)} THEN '{name}'")
    return "CASE " + " ".join(out) + " END"


@query(f"SELECT o_orderkey AS s, {_fold_sql('o_orderkey')} AS fold FROM orders")
def er_folds(spark: SparkSession, sf: str) -> DataFrame:
    return views.entities(spark, sf).select("s", folds.fold(F.col("s")).alias("fold"))


@query(f"SELECT o_orderkey AS s FROM orders ORDER BY {_BUCKET.format('o_orderkey', 'sample')}, o_orderkey LIMIT 500")
def er_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: 500 entities by the order of their hashes."""
    return folds.sample(views.entities(spark, sf), "s", 500)


_DROP = f"dr AS (SELECT o_orderkey AS s FROM orders WHERE {_fold_sql('o_orderkey')} IS NULL ORDER BY {_BUCKET.format('o_orderkey', 'drop')}, o_orderkey LIMIT (SELECT CAST(floor(0.05 * count(*)) AS BIGINT) FROM orders))"


@query(f"WITH {_DROP} SELECT s FROM dr")
def er_drop_sample(spark: SparkSession, sf: str) -> DataFrame:
    return folds.drop_sample(views.entities(spark, sf), "s", 0.05)


@query(f"WITH {S.SCORED} SELECT {_KEYS}, round(CASE f WHEN 'A' THEN p2 WHEN 'B' THEN p1 ELSE (p1 + p2) / 2 END, 6) AS p FROM (SELECT *, coalesce({_fold_sql('s')}, 'none') AS f FROM sp)")
def er_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    fold = F.coalesce(folds.fold(F.col("s")), F.lit("none"))
    return result(views.scored(spark, sf).select("src", "s", "t", folds.out_of_fold(fold, F.col("p1"), F.col("p2")).alias("p")))


@query(f"WITH {S.SCORED}, own AS (SELECT DISTINCT src, t FROM sp WHERE s IN (SELECT o_orderkey FROM orders WHERE {_fold_sql('o_orderkey')} = 'ES')) SELECT {_KEYS} FROM sp SEMI JOIN own USING (src, t)")
def er_closure(spark: SparkSession, sf: str) -> DataFrame:
    es = views.entities(spark, sf).where(folds.fold(F.col("s")) == "ES")
    return longs(folds.competitor_closure(views.scored(spark, sf), es).select("src", "s", "t"))


@query(f"WITH {S.SCORED}, {_DROP}, x AS (SELECT *, row_number() OVER (PARTITION BY src, t ORDER BY p1 DESC, s) AS rr FROM sp ANTI JOIN dr USING (s)), y AS (SELECT src, s, t, rr - 1 AS rev_rank, p1 - max(p1) OVER (PARTITION BY src, t) AS rev_gap, count(*) OVER (PARTITION BY src, t) AS rev_n, {_margin_sql('p1', 'rr', 'PARTITION BY src, t', 'p1 DESC, s')} AS rev_gap2 FROM x) {cast_sql({'src': 'l', 's': 'p', 't': 'p', 'rev_rank': 'l', 'rev_gap': 'd', 'rev_n': 'l', 'rev_gap2': 'd'}, 'y')}")
def er_simulated_reverse(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.scored(spark, sf).withColumnRenamed("p1", "score")
    return result(simulate.reverse_context(pairs, folds.drop_sample(views.entities(spark, sf), "s", 0.05)))


@query(f"""WITH {S.SCORED}, {_DROP}, sp0 AS (SELECT * FROM sp ANTI JOIN dr USING (s)), sp1 AS (SELECT src, s, t, CASE WHEN {_fold_sql('s')} = 'ES' THEN p2 ELSE p1 END AS p1 FROM sp0), {_pctx_sql().replace('FROM sp)', 'FROM sp1)')} {cast_sql({'src': 'l', 's': 'p', 't': 'p', 'p1': 'd'} | _PCTX, 'pc')} WHERE p1 >= 0.3""")
def er_simulated_table(spark: SparkSession, sf: str) -> DataFrame:
    """The simulation with a stand-in for the model: entities of fold ES are predicted as p2."""
    pairs = views.scored(spark, sf).withColumn("score", F.col("p1"))
    es = views.entities(spark, sf).where(folds.fold(F.col("s")) == "ES")
    got = simulate.simulated(pairs, folds.drop_sample(views.entities(spark, sf), "s", 0.05), lambda d: d.select("src", "s", "t", F.col("p2").alias("p1")), es, 0.3)
    return result(got.select("src", "s", "t", "p1", *_PCTX))


@query(f"WITH {S.SCORED} SELECT {_KEYS}, round(CASE WHEN label = 1 THEN p2 ELSE p1 END, 6) AS p1 FROM sp")
def er_replaced(spark: SparkSession, sf: str) -> DataFrame:
    sp = views.scored(spark, sf)
    new = sp.where("label = 1").select("src", "s", "t", F.col("p2").alias("p1"))
    return result(folds.replaced(sp, new, ["src", "s", "t"], "p1").select("src", "s", "t", "p1"))


@query(f"WITH {S.SCORED} SELECT {_KEYS}, p_name AS name FROM sp JOIN part ON p_partkey = t")
def er_complete_join(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("t"), F.col("p_name").alias("name"))
    return longs(folds.complete_join(views.scored(spark, sf), names, ["t"], "name").select("src", "s", "t", "name"))


@query(f"WITH {S.SCORED} SELECT {_KEYS}, 'S' || src || '-' || t AS target_entity_id FROM sp WHERE p2 >= 0.9")
def er_target_ids(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("src")).withColumn("entity_id", F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("id").cast("string")))
    return longs(io.target_ids(views.scored(spark, sf).where("p2 >= 0.9"), part).select("src", "s", "t", "target_entity_id"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def er_row_id(spark: SparkSession, sf: str) -> DataFrame:
    return io.with_row_id(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id").select("id", "row_id")


# --- features -------------------------------------------------------------------------------------------------------------------------


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    rec = staged(views.normalised(spark, sf), "normalised")  # blocking and features read it
    nums = F.filter(text.words(F.col("addr")), lambda w: w.rlike("^[0-9]+$"))
    full = rec.withColumns({"nums": F.array_join(nums, " "), "house": F.coalesce(F.get(nums, F.lit(0)), F.lit("")), "postal": F.coalesce(F.get(nums, F.lit(1)), F.lit("")), "state": F.substring("name_skel", 1, 2), "city": F.coalesce(F.get(text.words(F.col("addr")), F.lit(0)), F.lit("")), "name_indic": F.lit(False)})
    return features.sides(retrieval.staged_candidates(views.postings_of(rec)), full.where("src = 1"), full.where("src > 1"))


_JOINED = f"""{S.CANDIDATES}, fl AS (SELECT *, list_filter({S.words('addr')}, lambda w: regexp_full_match(w, '[0-9]+')) AS nm, name_skel[1:2] AS state, coalesce(({S.words('addr')})[1], '') AS city FROM nrm),
fl2 AS (SELECT *, array_to_string(nm, ' ') AS nums, coalesce(nm[1], '') AS house, coalesce(nm[2], '') AS postal FROM fl),
jn AS (SELECT c.src, c.s, c.t, a.name_full AS a_full, b.name_full AS b_full, a.name_core AS a_core, b.name_core AS b_core, a.core AS a_w, b.core AS b_w, a.addr AS a_addr, b.addr AS b_addr, a.nums AS a_nums, b.nums AS b_nums, a.nm AS a_nm, b.nm AS b_nm, a.house AS a_house, b.house AS b_house, a.postal AS a_postal, b.postal AS b_postal, a.state AS a_state, b.state AS b_state, a.city AS a_city, b.city AS b_city, b.is_domain AS b_dom
    FROM cand c JOIN fl2 a ON a.id = c.s JOIN fl2 b ON b.id = c.t)"""


def _eq(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN NULL ELSE CAST({a} = {b} AS BIGINT) END"


_PLAIN = ["first_tok_eq", "house_eq", "postal_eq", "state_eq", "nums_eq", "house_lev", "name_ntok_a", "name_ntok_b", "name_len_a", "name_len_diff", "addr_ntok_a", "addr_ntok_b", "is_domain_b", "indic_b", "addr_empty_b"]


@query(f"""WITH {_JOINED} SELECT CAST(src AS BIGINT) AS src, s, t, {_eq("coalesce(a_w[1], '')", "coalesce(b_w[1], '')")} AS first_tok_eq, {_eq("a_house", "b_house")} AS house_eq, {_eq("a_postal", "b_postal")} AS postal_eq, {_eq("a_state", "b_state")} AS state_eq, {_eq("a_nums", "b_nums")} AS nums_eq,
    CASE WHEN a_house = '' OR b_house = '' THEN NULL ELSE round(1 - levenshtein(a_house, b_house) / greatest(length(a_house), length(b_house)), 6) END AS house_lev, len(a_w) AS name_ntok_a, len(b_w) AS name_ntok_b, length(a_core) AS name_len_a, abs(length(a_core) - length(b_core)) AS name_len_diff,
    len({S.words("a_addr")}) AS addr_ntok_a, len({S.words("b_addr")}) AS addr_ntok_b, CAST(b_dom AS BIGINT) AS is_domain_b, CAST(0 AS BIGINT) AS indic_b, CAST(b_addr = '' AS BIGINT) AS addr_empty_b FROM jn""")
def er_plain_features(spark: SparkSession, sf: str) -> DataFrame:
    joined = _joined(spark, sf)
    return result(joined.withColumns(features.plain_features(joined)).select("src", "s", "t", *_PLAIN))


def _jw(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE round(jaro_winkler_similarity({a}, {b}), 6) END"


@query(f"""WITH {_JOINED} SELECT CAST(src AS BIGINT) AS src, s, t, {_jw("a_core", "b_core")}::DOUBLE AS name_jw, {_jw("coalesce(a_w[1], '')", "coalesce(b_w[1], '')")}::DOUBLE AS first_tok_jw, (CASE WHEN a_city = '' OR b_city = '' THEN NULL ELSE {_jw("a_city", "b_city")} END)::DOUBLE AS city_jw FROM jn""")
def er_jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    joined = _joined(spark, sf)
    wanted = {k: v for k, v in features.string_features(joined).items() if v[0] == "jw"}
    got = similarity.with_similarities(joined, wanted, "j")
    return result(got.select("src", "s", "t", "j.name_jw", "j.first_tok_jw", "j.city_jw"))


@query()
def er_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """All 36 string features of the candidates."""
    return result(features.pair_features(_joined(spark, sf)).select("src", "s", "t", *features.STRING_FEATURES))


def _match_sql(x: str, y: str) -> str:
    return f"({x} = {y} OR {S.skeleton_token(x)} = {S.skeleton_token(y)} OR (length({x}) >= 3 AND length({y}) >= 3 AND (starts_with({x}, {y}) OR starts_with({y}, {x}))) OR (length({x}) >= 4 AND length({y}) >= 4 AND jaro_winkler_similarity({x}, {y}) >= 0.88))"


def _diff_sql() -> str:
    miss = f"list_filter(a_w, lambda x: len(list_filter(b_w, lambda y: {_match_sql('x', 'y')})) = 0)"
    extra = f"list_filter(b_w, lambda x: len(list_filter(a_w, lambda y: {_match_sql('x', 'y')})) = 0)"
    legal = lambda c: f"list_distinct(list_filter({S.words(c)}, lambda w: w IN ({S.quoted(text.LEGAL)})))"
    near = "(x = y OR (length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x))))"
    digits = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"""df AS (SELECT *, {miss} AS miss, {extra} AS extra, {legal("a_full")} AS la, {legal("b_full")} AS lb, {digits("a_house")} AS ha, {digits("b_house")} AS hb FROM jn),
    dd AS (SELECT src, s, t, miss, extra, len(miss) AS n_miss, len(extra) AS n_extra, len(miss) / nullif(len(a_w), 0) AS miss_frac, len(extra) / nullif(len(b_w), 0) AS extra_frac, len(la) AS legal_n_a, len(lb) AS legal_n_b,
        CASE WHEN len(la) > 0 AND len(lb) > 0 THEN len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))) END AS legal_jacc,
        CASE WHEN ha <> '' AND hb <> '' THEN CAST(ha = hb AS INTEGER) END AS h_digits_eq, CASE WHEN ha <> '' AND hb <> '' THEN CAST(contains(ha, hb) OR contains(hb, ha) AS INTEGER) END AS h_substr,
        CASE WHEN ha <> '' AND hb <> '' AND length(ha) = length(hb) THEN len(list_filter(range(1, length(ha) + 1), lambda i: ha[i] <> hb[i])) END AS h_ndiff,
        CASE WHEN ha <> '' AND hb <> '' THEN log10(1 + abs(CAST(ha[1:15] AS BIGINT) - CAST(hb[1:15] AS BIGINT))) END AS h_logdist,
        len(list_filter(a_nm, lambda x: len(list_filter(b_nm, lambda y: {near})) = 0)) AS nums_miss, len(list_filter(b_nm, lambda x: len(list_filter(a_nm, lambda y: {near})) = 0)) AS nums_extra FROM df)"""


_DIFF = {c: "l" for c in ("n_miss", "n_extra", "legal_n_a", "legal_n_b", "h_digits_eq", "h_substr", "h_ndiff", "nums_miss", "nums_extra")} | {c: "d" for c in ("miss_frac", "extra_frac", "legal_jacc", "h_logdist")}


@query(f"WITH {_JOINED}, {_diff_sql()} {cast_sql({'src': 'l', 's': 'p', 't': 'p'} | _DIFF, 'dd')}")
def er_difference(spark: SparkSession, sf: str) -> DataFrame:
    return result(difference.difference_features(_joined(spark, sf)).select("src", "s", "t", *_DIFF))


_WORDS = f"WITH {S.SCORED}, wd AS (SELECT sp.*, string_split(lower(p_name), ' ') AS tk, coalesce({_fold_sql('s')}, 'none') AS fold FROM sp JOIN part ON p_partkey = t)"


def _lo_sql(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT word, (ln((a + 0.5) / (b + 0.5)) - ln(nt / nf)) * (a + b) / (a + b + 10) AS lo FROM (SELECT word, sum(label) AS a, sum(1 - label) AS b FROM (SELECT label, unnest(list_distinct(tk)) AS word FROM wd WHERE {where}) GROUP BY word HAVING count(*) >= 3), (SELECT sum(label) AS nt, sum(1 - label) AS nf FROM wd WHERE {where}))"


def _worded(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("t"), F.split(F.lower("p_name"), " ").alias("tk"))
    return views.scored(spark, sf).join(part, "t").withColumn("fold", F.coalesce(folds.fold(F.col("s")), F.lit("none")))


@query(f"{_WORDS}, {_lo_sql('lo')} SELECT word, round(lo, 6) AS lo FROM lo")
def er_log_odds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(difference.fit_log_odds(_worded(spark, sf), "tk"))


@query(f"{_WORDS}, {_lo_sql('lo')}, x AS (SELECT src, s, t, unnest(tk) AS word FROM wd) SELECT {_KEYS}, round(min(coalesce(lo, 0)), 6) AS w_lo_min, round(sum(coalesce(lo, 0)), 6) AS w_lo_sum FROM x LEFT JOIN lo USING (word) GROUP BY src, s, t")
def er_log_odds_applied(spark: SparkSession, sf: str) -> DataFrame:
    rows = _worded(spark, sf)
    got = difference.apply_log_odds(rows, difference.fit_log_odds(rows, "tk"), "tk", ["src", "s", "t"], "w")
    return result(got.select("src", "s", "t", "w_lo_min", "w_lo_sum"))


@query(f"""{_WORDS}, {_lo_sql('la', "fold = 'B'")}, {_lo_sql('lb', "fold = 'A'")}, {_lo_sql('lc', "fold IN ('A', 'B')")}, al AS (SELECT 'A' AS apply_fold, * FROM la UNION ALL SELECT 'B', * FROM lb UNION ALL SELECT 'other', * FROM lc), x AS (SELECT src, s, t, CASE WHEN fold IN ('A', 'B') THEN fold ELSE 'other' END AS apply_fold, unnest(tk) AS word FROM wd) SELECT {_KEYS}, round(min(coalesce(lo, 0)), 6) AS w_lo_min, round(sum(coalesce(lo, 0)), 6) AS w_lo_sum FROM x LEFT JOIN al USING (apply_fold, word) GROUP BY src, s, t""")
def er_cross_fitted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _worded(spark, sf).withColumn("apply_fold", difference.apply_fold())
    got = difference.apply_log_odds(rows, difference.cross_fitted(rows, "tk"), "tk", ["src", "s", "t"], "w", ["apply_fold"])
    return result(got.select("src", "s", "t", "w_lo_min", "w_lo_sum"))


# --- models ---------------------------------------------------------------------------------------------------------------------------


@query()
def er_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two trees of two folds over the probability context, and their out-of-fold probability."""
    rows = context.probability_context(views.scored(spark, sf)).withColumn("fold", F.coalesce(folds.fold(F.col("s")), F.lit("none")))
    names = ["p1", "p2", *_PCTX]
    got = models.score_two(rows, models.fit_two(rows, names))
    return got.select("src", "s", "t", F.round(folds.out_of_fold(F.col("fold"), F.col("p_a"), F.col("p_b")), 6).alias("p"))


@query()
def er_importances(spark: SparkSession, sf: str) -> DataFrame:
    rows = context.probability_context(views.scored(spark, sf))
    model = models.fit(rows, ["p1", "p2", *_PCTX])
    return spark.createDataFrame(model.importances(), "feature string, gain double")


# --- validation -----------------------------------------------------------------------------------------------------------------------


def _result_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lists with planted mistakes: (key, ids) of matches and of candidates, and the required keys."""
    line = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("key")).agg(F.array_sort(F.collect_list(F.concat(F.when(F.col("l_partkey") % 97 == 0, "S1-").when(F.col("l_partkey") % 89 == 0, "X-").when(F.col("l_linenumber") % 2 == 0, "S2-").otherwise("S3-"), (F.col("l_partkey") % 500).cast("string")))).alias("ids"))
    again = line.where(F.length("key") == 5).where(F.substring("key", 5, 1) == "7")
    required = table(spark, sf, "orders").where("o_orderkey % 11 <> 0").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("key"))
    return line.unionByName(again), line.select("key", F.slice("ids", 1, 3).alias("ids")), required


_RESULTS = """l AS (SELECT 'S1-' || l_orderkey AS key, list_sort(list(CASE WHEN l_partkey % 97 = 0 THEN 'S1-' WHEN l_partkey % 89 = 0 THEN 'X-' WHEN l_linenumber % 2 = 0 THEN 'S2-' ELSE 'S3-' END || (l_partkey % 500))) AS ids FROM lineitem GROUP BY 1),
r AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE length(key) = 5 AND key[5] = '7'), q AS (SELECT 'S1-' || o_orderkey AS key FROM orders WHERE o_orderkey % 11 <> 0), e AS (SELECT key, unnest(ids) AS id FROM r)"""


def _finding_sql(rule: str, rows: str, severity: str = "error") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS n, array_to_string(list_sort(list(DISTINCT x))[1:5], ',') AS examples FROM ({rows}) HAVING count(*) > 0"


@query(f"WITH {_RESULTS} " + " UNION ALL ".join([
    _finding_sql("duplicate_row", "SELECT key AS x FROM r GROUP BY key HAVING count(*) > 1"),
    _finding_sql("repeated_id", "SELECT key AS x FROM r WHERE len(ids) > len(list_distinct(ids))"),
    _finding_sql("source1_id_in_list", "SELECT id AS x FROM e WHERE starts_with(id, 'S1-')"),
    _finding_sql("bad_prefix", "SELECT id AS x FROM e WHERE NOT regexp_matches(id, '^S[123]-')"),
    _finding_sql("missing_row", "SELECT key AS x FROM q ANTI JOIN r USING (key)"),
    _finding_sql("unexpected_row", "SELECT DISTINCT key AS x FROM r ANTI JOIN q USING (key)"),
    _finding_sql("unknown_id", "SELECT DISTINCT id AS x FROM e WHERE regexp_matches(id, '^S[23]-') AND CAST(id[4:] AS BIGINT) >= 490"),
    _finding_sql("not_a_candidate", "SELECT key AS x FROM r JOIN (SELECT key, ids[1:3] AS c FROM l) USING (key) WHERE len(list_filter(ids, lambda i: NOT list_contains(c, i))) > 0", "warning"),
]))
def er_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows, cand, required = _result_rows(spark, sf)
    known = spark.range(490).select(F.explode(F.array(F.concat(F.lit("S2-"), F.col("id").cast("string")), F.concat(F.lit("S3-"), F.col("id").cast("string")))).alias("id"))
    found = validate.check_lists(rows, required, known) + [validate.check_subset(rows, cand)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("examples", F.array_join("examples", ","))
