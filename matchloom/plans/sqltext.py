"""DuckDB SQL that says what the queries compute: pieces that several queries share."""

from __future__ import annotations

from ..functions import text
from ..functions.tokens import ADDRESS, NAME, WEIGHTS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), '&', ' and '), '[''`’‘]', '', 'g'), '[^0-9a-z]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def distinct(x: str) -> str:
    """Distinct entries in order of their first occurrence."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def joined_letters(tokens: str) -> str:
    glued = f"list_transform({tokens}, lambda w, i: CASE WHEN i > 1 AND regexp_full_match(w, '[a-z]') AND regexp_full_match(({tokens})[i - 1], '[a-z]') THEN w ELSE ' ' || w END)"
    return words(f"trim(array_to_string({glued}, ''))")


def skeleton_token(w: str) -> str:
    a = f"translate(regexp_replace({w}, '([{text.ASPIRATED}])h', '\\1', 'g'), '{text.ALIKE[0]}', '{text.ALIKE[1]}')"
    b = f"({a}[1] || regexp_replace({a}[2:], '[aeiouy]', '', 'g'))"
    return f"CASE WHEN regexp_full_match({w}, '[0-9]+') THEN {w} ELSE array_to_string(list_filter(string_split({b}, ''), lambda c, i: i = 1 OR c <> {b}[i - 1]), '') END"


DOMAIN = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|info|biz|io|fr|us|co\.in|in|co)(?:/[^\s]*)?($|[^a-z0-9.])"
TAGS = text.ID_TAGS

RECORDS = r"""
rec AS (
    SELECT doc_id AS id, CAST(1 + doc_id % 3 AS INTEGER) AS src, lang AS country, array_to_string(w[1:6], ' ') AS name_raw, array_to_string(w[7:16], ' ') AS addr_raw, md5(text) AS text_md5
    FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
)"""

NORMALISED = f"""{RECORDS},
nm1 AS (SELECT *, regexp_replace(name_raw, '{TAGS}', ' ', 'g') AS tagless FROM rec),
nm2 AS (SELECT *, regexp_matches(tagless, '{DOMAIN}') AS is_domain, {clean(f"regexp_replace(tagless, '{DOMAIN}', ' {chr(92)}1 {chr(92)}2', 'g')")} AS cl FROM nm1),
nm3 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(' ' || cl || ' ', '{text.DBA}'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM nm2),
nm4 AS (SELECT *, {words("array_to_string(parts, ' ')")} AS w0, {words("coalesce(parts[-1], '')")} AS l0 FROM nm3),
nm5 AS (SELECT *, {joined_letters("w0")} AS whole, {joined_letters("l0")} AS lastw FROM nm4),
nm6 AS (SELECT *,
    list_filter(whole, lambda w: w NOT IN ({quoted(text.LEGAL + text.HONORIFICS)})) AS bare, list_filter(whole, lambda w: w NOT IN ({quoted(text.HONORIFICS)})) AS polite,
    list_filter(lastw, lambda w: w NOT IN ({quoted(text.LEGAL + text.HONORIFICS)})) AS lbare, list_filter(lastw, lambda w: w NOT IN ({quoted(text.HONORIFICS)})) AS lpolite FROM nm5),
nm7 AS (SELECT *, CASE WHEN len(bare) > 0 THEN bare WHEN len(polite) > 0 THEN polite ELSE whole END AS c0, CASE WHEN len(lbare) > 0 THEN lbare WHEN len(lpolite) > 0 THEN lpolite ELSE lastw END AS d0 FROM nm6),
nrm AS (SELECT id, src, country, text_md5, array_to_string(whole, ' ') AS name_full, {distinct("c0")} AS core, array_to_string({distinct("c0")}, ' ') AS name_core,
    CASE WHEN len(parts) > 1 THEN array_to_string({distinct("d0")}, ' ') ELSE '' END AS name_dba, is_domain,
    array_to_string(list_transform({distinct("c0")}, lambda w: {skeleton_token("w")}), ' ') AS name_skel, {clean("addr_raw")} AS addr FROM nm7)"""

TOKENS = f"""{NORMALISED},
tk1 AS (SELECT id, src, country, list_filter(core, lambda w: length(w) >= 2 OR regexp_full_match(w, '[0-9]+')) AS n, {words("name_skel")} AS k, replace(name_core, ' ', '') AS p, {words("addr")} AS a FROM nrm),
tk2 AS (SELECT *, list_sort(list_distinct(n[1:6])) AS six, ({distinct("list_filter(a, lambda w: regexp_full_match(w, '[0-9]+'))")})[1:3] AS nums, list_distinct(list_filter(a, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS alpha FROM tk1),
tok AS (
    SELECT DISTINCT id, src, country, channel, token FROM (
        SELECT id, src, country, 'n' AS channel, unnest(n) AS token FROM tk2
        UNION ALL SELECT id, src, country, 'k', unnest(list_filter(k, lambda w: length(w) >= 2)) FROM tk2
        UNION ALL SELECT id, src, country, 'g', unnest(list_transform(range(1, length(p) - 2), lambda i: p[i : i + 3])) FROM tk2
        UNION ALL SELECT id, src, country, 'p', unnest(flatten(list_transform(six, lambda x: list_transform(list_filter(six, lambda y: x < y), lambda y: x || '|' || y)))) FROM tk2
        UNION ALL SELECT id, src, country, 'a', unnest(a) FROM tk2
        UNION ALL SELECT id, src, country, 'x', unnest(flatten(list_transform(nums, lambda x: list_transform(alpha, lambda y: x || '|' || y)))) FROM tk2
        UNION ALL SELECT id, src, country, 'm', unnest(flatten(list_transform(list_filter(n[1:2], lambda x: length(x) >= 3), lambda x: list_transform(list_filter(alpha, lambda y: length(y) >= 4), lambda y: x || '|' || y)))) FROM tk2
    )
)"""

_WEIGHT = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items()) + " END"

POSTINGS = f"""{TOKENS},
ns AS (SELECT country, count(*) AS n_s FROM nrm WHERE src = 1 GROUP BY country),
sz AS (SELECT src, country, n_s, count(*) AS n_t FROM nrm JOIN ns USING (country) WHERE src > 1 GROUP BY ALL),
st AS (SELECT sz.src, country, id, channel, token FROM tok JOIN sz USING (country) WHERE tok.src = 1),
tt AS (SELECT src, country, id, channel, token FROM tok WHERE src > 1),
dfs AS (SELECT src, country, channel, token, sum(a) AS df_s, sum(b) AS df_t FROM (SELECT *, 1 AS a, 0 AS b FROM st UNION ALL SELECT *, 0, 1 FROM tt) GROUP BY ALL),
idf AS (SELECT dfs.*, n_s, n_t, ln((n_s + n_t + 1) / (df_s + df_t + 1)) + 1 AS idf FROM dfs JOIN sz USING (src, country)),
ws0 AS (SELECT * FROM st JOIN idf USING (src, country, channel, token)),
wt0 AS (SELECT * FROM tt JOIN idf USING (src, country, channel, token)),
ws AS (SELECT *, {_WEIGHT} * idf / sqrt(sum(idf * idf) OVER (PARTITION BY src, country, id, channel)) AS w FROM ws0),
wt AS (SELECT *, {_WEIGHT} * idf / sqrt(sum(idf * idf) OVER (PARTITION BY src, country, id, channel)) AS w FROM wt0)"""

FORWARD = f"""{POSTINGS},
fs AS (
    SELECT src, a.id AS s, b.id AS t, round(sum(a.w * b.w) FILTER (WHERE channel IN ({quoted(NAME)})), 9) AS name, round(sum(a.w * b.w) FILTER (WHERE channel IN ({quoted(ADDRESS)})), 9) AS addr, round(sum(a.w * b.w), 9) AS comb
    FROM ws a JOIN wt b USING (src, country, channel, token) WHERE b.df_t <= greatest(200, floor(0.002 * b.n_t)) GROUP BY ALL
),
fwd AS (
    SELECT src, s, t, 1 AS hit FROM fs WHERE name > 0.02 QUALIFY row_number() OVER (PARTITION BY src, s ORDER BY name DESC, t) <= 10
    UNION ALL SELECT src, s, t, 2 FROM fs WHERE addr > 0.02 QUALIFY row_number() OVER (PARTITION BY src, s ORDER BY addr DESC, t) <= 12
    UNION ALL SELECT src, s, t, 4 FROM fs WHERE comb > 0.02 QUALIFY row_number() OVER (PARTITION BY src, s ORDER BY comb DESC, t) <= 20
)"""

REVERSE = """
rs AS (
    SELECT src, a.id AS s, b.id AS t, round(sum(a.w * b.w), 9) AS score
    FROM ws a JOIN wt b USING (src, country, channel, token) WHERE a.df_s <= greatest(200, floor(0.002 * a.n_s)) GROUP BY ALL
),
rev AS (SELECT src, s, t, row_number() OVER (PARTITION BY src, t ORDER BY score DESC, s) - 1 AS rrank FROM rs WHERE score > 0.05 QUALIFY rrank < 3)"""

_CHANNELS = ", ".join(f"coalesce(round(sum(a.w * b.w) FILTER (WHERE a.channel = '{c}') / {w}, 9), 0) AS cos_{c}" for c, w in WEIGHTS.items())
CANDIDATES = f"""{FORWARD},{REVERSE},
uni AS (
    SELECT src, s, t, CAST(bit_or(hit) AS INTEGER) AS hit, CAST(min(rrank) AS INTEGER) AS rrank
    FROM (SELECT src, s, t, hit, 99 AS rrank FROM fwd UNION ALL SELECT src, s, t, 8, rrank FROM rev) GROUP BY src, s, t
),
cs AS (
    SELECT u.src, u.s, u.t, u.hit, u.rrank, {_CHANNELS}, round(sum(a.w * b.w), 9) AS score
    FROM uni u JOIN ws a ON a.src = u.src AND a.id = u.s JOIN wt b ON b.src = u.src AND b.id = u.t AND b.channel = a.channel AND b.token = a.token GROUP BY ALL
),
pr AS (
    SELECT *, row_number() OVER (PARTITION BY src, s ORDER BY score DESC, t) AS r1, row_number() OVER (PARTITION BY src, s ORDER BY round(cos_a + cos_x, 9) DESC, t) AS r2,
        row_number() OVER (PARTITION BY src, s ORDER BY round(cos_n + cos_g + cos_k + cos_p, 9) DESC, t) AS r3, row_number() OVER (PARTITION BY src, s ORDER BY cos_m DESC, t) AS r4 FROM cs
),
cand AS (
    SELECT src, s, t, hit, rrank, {", ".join(f"cos_{c}" for c in WEIGHTS)}, score, CAST(row_number() OVER (PARTITION BY src, s ORDER BY score DESC, t) - 1 AS INTEGER) AS rank
    FROM pr WHERE r1 <= 15 OR r2 <= 5 OR r3 <= 5 OR r4 <= 3 OR rrank < 3
)"""

TRUTH = """
trd AS (SELECT doc_id AS id, CAST(1 + doc_id % 3 AS INTEGER) AS src, lang AS country, md5(text) AS m FROM documents),
truth AS (SELECT t.src, s.id AS s, t.id AS t FROM trd s JOIN trd t USING (country, m) WHERE s.src = 1 AND t.src > 1)"""

SCORED = """
sp AS (
    SELECT CAST(2 + l_linenumber % 2 AS INTEGER) AS src, l_orderkey AS s, l_partkey AS t, max(l_extendedprice) / 106000 AS p1, max(l_quantity) / 51 AS p2, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label
    FROM lineitem GROUP BY 1, 2, 3
)"""
TRUE_COUNTS = """
tc AS (SELECT o_orderkey AS s, coalesce(n, 0) AS n_true FROM orders LEFT JOIN (SELECT s, count(*) AS n FROM sp WHERE label = 1 GROUP BY s) x ON x.s = o_orderkey)"""


def expected_f(rows: str, miss: str, alpha: str, min_p: str, p: str = "p", by: str = "") -> str:
    """A query for the expected-F subset of ``rows`` (src, s, t, p, ...)."""
    part = f"PARTITION BY {by}s"
    return f"""
    SELECT * EXCLUDE (j, cum, n_exp, none, ef, best, stop) FROM (
        SELECT *, min(j) FILTER (WHERE ef >= best - 1e-12) OVER ({part}) AS stop FROM (
            SELECT *, max(ef) OVER ({part}) AS best FROM (
                SELECT *, 1.25 * cum / (0.25 * n_exp + j) AS ef FROM (
                    SELECT *, row_number() OVER ({part} ORDER BY {p} DESC, src, t) AS j,
                        sum({p}) OVER ({part} ORDER BY {p} DESC, src, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                        sum({p}) OVER ({part}) / (1 - {miss}) AS n_exp,
                        {alpha} * exp(sum(ln(1 - least({p}, 1 - 1e-9))) OVER ({part})) * (1 - {miss}) AS none
                    FROM {rows} WHERE {p} > {min_p}
                )
            )
        )
    ) WHERE j <= stop AND best > none"""


F05 = "CASE WHEN n_true = 0 AND coalesce(n_pred, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / (0.25 * n_true + coalesce(n_pred, 0)) END"


def macro(selected: str) -> str:
    return f"SELECT avg({F05}) FROM tc LEFT JOIN (SELECT s, sum(label) AS tp, count(*) AS n_pred FROM {selected} GROUP BY s) USING (s)"
