"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, maintext, neardup, pieces, quality, substring, surrogates, tokenshards, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_html_main_text": maintext.op3_html_main_text,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_minhash_neardup": neardup.op5_minhash_neardup,
    "op6_pii_surrogates": surrogates.op6_pii_surrogates,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_url_filter": urls.op8_url_filter,
    "op9_quality_fertility": quality.op9_quality_fertility,
    "op10_training_order": tokenshards.op10_training_order,
}

_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM_WORDS}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, list_slice(w, p, p + least(len(w), 8) - 1) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id),
spot AS (SELECT DISTINCT doc_id, p FROM m),
dx AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM spot)),
bx AS (SELECT k, item, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM b),
run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, k, p - q ORDER BY p) AS island FROM dx JOIN bx USING (word)),
longest AS (SELECT doc_id, item, p, max(p) OVER (PARTITION BY doc_id, k, p - q, island) - p + 1 AS n FROM run),
best AS (SELECT * FROM longest SEMI JOIN spot USING (doc_id, p) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated,
    coalesce(n, 0)::BIGINT AS longest_match, best.item AS longest_item, best.p - 1 AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN best USING (doc_id)"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""


def _op8_sql() -> str:
    """Rules by suffix and prefix, terms by patterns with boundaries."""
    term = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    strict = " OR ".join(map(term, urls.STRICT_TERMS))
    soft = " + ".join(f"{w} * {term(t)}::INT" for t, w in urls.SOFT_TERMS.items())
    distinct = " + ".join(f"{term(t)}::INT" for t in urls.SOFT_TERMS)
    cases = lambda k: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{(f'{h}/{p}', v)[k]}'" for h, p, v in sorted(((*r.split("/", 1), v) for r, v in urls.RULES), key=lambda x: -len(x[0] + x[1]))
    )
    return f"""
WITH a AS (SELECT page_id, {_LOWER.format("url")} AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {cases(0)} END AS rule, CASE {cases(1)} WHEN {strict} OR ({soft} >= {urls.SOFT_LIMIT} AND {distinct} >= {urls.SOFT_DISTINCT}) THEN 'block' ELSE 'allow' END AS verdict FROM b"""


#: The other operators have no SQL: hashes, automata, models and components; tests hold them against brute force.
ORACLES: dict[str, str] = {"op4_decontamination": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op8_url_filter": _op8_sql()}
