"""The library's queries by name, and DuckDB SQL with the same rows.

Documents, benchmark items, conversations and pages stand in for functions: `from_table`
makes units of any table. Every query reads its whole table. The edit-distance join compares
all pairs that lengths allow, so most of its queries take the short table of benchmark items;
near_document_pairs, document_summary_all and health_by_source_all take the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions import health, text, winnow
from echoframe.functions.normalize import KEYWORDS, TOKEN, normalize_code, prepare, rename_identifiers, tokens
from echoframe.operators.exact import exact_groups, exact_members, exact_pairs, unmatched
from echoframe.operators.fingerprints import similar_pairs
from echoframe.operators.near import near_pairs
from echoframe.operators.semantic import cosine, cosine_pairs, nearest, outliers, pair_stats
from echoframe.operators.summary import summary, summary_of, tally
from echoframe.plans.scan import detect, file_counts, in_order, with_suggestion
from echoframe.plans.storage import written
from echoframe.sources.tables import from_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "lang", "text", "source")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "benchmark"), "item_id", F.concat(F.lit("item"), F.col("item_id").cast("string")), "text", F.concat(F.lit("file"), (F.col("item_id") % 7).cast("string")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


# -- pieces of SQL --------------------------------------------------------------------------------
def _norm(c: str) -> str:
    step = f"regexp_replace(coalesce({c}, ''), '(?s)/\\*.*?\\*/', '', 'g')"
    step = f"regexp_replace({step}, '(?s)/\\*.*(.)\\z', '\\1')"
    step = f"regexp_replace({step}, '/\\*\\z', '')"
    return f"trim(regexp_replace(regexp_replace({step}, '//[^\\n]*', '', 'g'), '[ \\n\\t\\r]+', ' ', 'g'), ' ')"


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"


def _renamed(source: str, key: str) -> str:
    """SQL: (key, prep) with identifiers renamed; source has key and s."""
    return f"""
    SELECT {key}, array_to_string(list_transform(range(1, len(toks) + 1), lambda i: gaps[i] || CASE WHEN list_contains(ids, toks[i]) THEN 'VAR_' || (list_position(ids, toks[i]) - 1) ELSE toks[i] END), '') AS prep
    FROM (SELECT {key}, toks, gaps, list_filter(names, lambda x, i: list_position(names, x) = i) AS ids
          FROM (SELECT {key}, toks, gaps, list_filter(toks, lambda x: regexp_matches(x, '^[a-zA-Z]') AND NOT list_contains({_KEYWORDS}, x)) AS names
                FROM (SELECT {key}, regexp_extract_all(s, '(?s)(.*?)({TOKEN})', 2) AS toks, regexp_extract_all(s, '(?s)(.*?)({TOKEN})', 1) AS gaps FROM ({source}))))"""


NEAR_THRESHOLD = 70.0
_DOCS = f"SELECT doc_id AS idx, coalesce(lang, '') AS name, coalesce(source, '') AS filename, {_norm('text')} AS norm FROM documents"
_EXACT = f"""WITH u AS ({_DOCS}), pairs AS (
  SELECT a.idx AS idx1, a.name AS name1, a.filename AS file1, b.idx AS idx2, b.name AS name2, b.filename AS file2, 100.0::DOUBLE AS similarity
  FROM u a JOIN u b ON a.norm = b.norm AND a.idx < b.idx AND NOT (a.filename = b.filename AND a.name = b.name))"""
#: The longest prefix of whole characters within 500 bytes; a cut character would be dropped by renaming anyway.
_CAPPED = "substr(text, 1, list_max(list_filter(range(0, 501), lambda n: strlen(substr(text, 1, n)) <= 500)))"
_ITEMS = f"""WITH u AS (SELECT item_id AS idx, 'item' || item_id AS name, 'file' || (item_id % 7) AS filename, {_norm('text')} AS norm, {_norm(_CAPPED)} AS s FROM benchmark),
  e AS (SELECT a.idx AS idx1, b.idx AS idx2, 100.0::DOUBLE AS similarity FROM u a JOIN u b ON a.norm = b.norm AND a.idx < b.idx AND NOT (a.filename = b.filename AND a.name = b.name)),
  p AS (SELECT * FROM ({_renamed('SELECT idx, s FROM u', 'idx')}) WHERE strlen(prep) >= 80 AND idx NOT IN (SELECT idx1 FROM e UNION SELECT idx2 FROM e)),
  n AS (SELECT a.idx AS idx1, b.idx AS idx2, (1 - levenshtein(a.prep, b.prep) / greatest(strlen(a.prep), strlen(b.prep))::DOUBLE) * 100 AS similarity FROM p a JOIN p b ON a.idx < b.idx),
  pairs AS (SELECT x.idx1, a.name AS name1, a.filename AS file1, x.idx2, b.name AS name2, b.filename AS file2, x.similarity FROM (SELECT * FROM e UNION ALL SELECT * FROM n WHERE similarity >= {NEAR_THRESHOLD}) x JOIN u a ON a.idx = x.idx1 JOIN u b ON b.idx = x.idx2)"""
_RANKED = _ITEMS + " SELECT row_number() OVER (ORDER BY similarity DESC, idx1, idx2) AS rank, idx1, name1, file1, idx2, name2, file2, round(similarity, 6) AS similarity FROM pairs"
_COS = "(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 * 100"
_SIMS = f"s AS MATERIALIZED (SELECT a.vec_id AS idx1, b.vec_id AS idx2, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
_GRADE_PLUS = "CASE WHEN {s} >= 95 THEN 'A+' WHEN {s} >= 90 THEN 'A' WHEN {s} >= 82 THEN 'B+' WHEN {s} >= 75 THEN 'B' WHEN {s} >= 65 THEN 'C+' WHEN {s} >= 60 THEN 'C' WHEN {s} >= 45 THEN 'D+' WHEN {s} >= 40 THEN 'D' ELSE 'F' END"


# -- normalisation --------------------------------------------------------------------------------
@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_code(F.coalesce("text", F.lit(""))).alias("norm"))


@query(f"SELECT page_id, {_norm('html')} AS norm FROM pages")
def normalize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_code(F.coalesce("html", F.lit(""))).alias("norm"))


@query(f"WITH u AS (SELECT conv_id, turn, {_norm('text')} AS s FROM conversations) " + _renamed("SELECT conv_id, turn, s FROM u", "conv_id, turn"))
def rename_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rename_identifiers(normalize_code(F.coalesce("text", F.lit("")))).alias("prep"))


@query(_renamed(f"SELECT item_id, {_norm(_CAPPED)} AS s FROM benchmark", "item_id"))
def prepare_items(spark, sf_dir):
    prep = prepare(F.coalesce("text", F.lit("")))  # one code point for each byte; shown as text again
    return table(spark, sf_dir, "benchmark").select("item_id", F.decode(F.encode(prep, "ISO-8859-1"), "UTF-8").alias("prep"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM documents)")
def token_lists(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


# -- exact pass -----------------------------------------------------------------------------------
@query(f"WITH u AS ({_DOCS}) SELECT md5(norm) AS norm_md5, min(idx) AS first_idx, count(*) AS n_units FROM u GROUP BY norm HAVING count(*) > 1")
def exact_document_groups(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir)).select(F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "first_idx", "n_units")


@query(f"WITH u AS ({_DOCS}), g AS (SELECT norm, min(idx) AS first_idx FROM u GROUP BY norm HAVING count(*) > 1) SELECT idx, name, filename, first_idx FROM u JOIN g USING (norm)")
def exact_document_members(spark, sf_dir):
    return exact_members(documents(spark, sf_dir))


@query(_EXACT + " SELECT * FROM pairs")
def exact_document_pairs(spark, sf_dir):
    return exact_pairs(documents(spark, sf_dir)).drop("zscore", "kind")


@query(_EXACT + " SELECT idx, name, filename FROM u WHERE idx NOT IN (SELECT idx1 FROM pairs UNION SELECT idx2 FROM pairs)")
def unmatched_documents(spark, sf_dir):
    units = documents(spark, sf_dir)
    return unmatched(units, exact_pairs(units)).select("idx", "name", "filename")


# -- near pass and ranking ------------------------------------------------------------------------
@query(_ITEMS + " SELECT idx1, idx2, round(similarity, 6) AS similarity FROM n WHERE similarity >= 70")
def near_item_pairs(spark, sf_dir):
    units = items(spark, sf_dir)
    return near_pairs(unmatched(units, exact_pairs(units)), NEAR_THRESHOLD).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query(_RANKED)
def all_item_pairs_ranked(spark, sf_dir):
    return in_order(detect(items(spark, sf_dir), NEAR_THRESHOLD)).select("rank", "idx1", "name1", "file1", "idx2", "name2", "file2", F.round("similarity", 6).alias("similarity"))


@query(_RANKED + " ORDER BY rank LIMIT 5")
def top_item_pairs(spark, sf_dir):
    return in_order(detect(items(spark, sf_dir), NEAR_THRESHOLD)).orderBy("rank").limit(5).select("rank", "idx1", "name1", "file1", "idx2", "name2", "file2", F.round("similarity", 6).alias("similarity"))


@query()
def near_document_pairs(spark, sf_dir):
    units = documents(spark, sf_dir)
    return near_pairs(unmatched(units, exact_pairs(units)), NEAR_THRESHOLD).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


# -- health, suggestions and report columns -------------------------------------------------------
@query(
    _EXACT
    + f""", c AS (SELECT (SELECT count(*) FROM u) AS n_units, (SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(*) FROM pairs WHERE similarity >= 99.9) AS n_exact, (SELECT count(*) FROM pairs WHERE similarity < 99.9) AS n_near,
    (SELECT count(*) FROM (SELECT file1 AS f, name1 AS n FROM pairs UNION SELECT file2, name2 FROM pairs)) AS n_members, 0::BIGINT AS n_semantic),
  r AS (SELECT *, CASE WHEN n_units > 0 THEN n_pairs * 2 / n_units::DOUBLE * 100 ELSE 0 END AS rate_pairs, CASE WHEN n_units > 0 THEN n_members / n_units::DOUBLE * 100 ELSE 0 END AS rate_members FROM c),
  h AS (SELECT *, greatest(0.0, least(100.0, 100.0 - rate_pairs)) AS score, greatest(0.0, least(100.0, 100.0 - rate_members)) AS score_members FROM r)
  SELECT n_units, n_pairs, n_exact, n_near, n_members, n_semantic, round(rate_pairs, 6) AS rate_pairs, round(rate_members, 6) AS rate_members, round(score, 6) AS score, round(score_members, 6) AS score_members, {_GRADE} AS grade, {_GRADE_PLUS.format(s="score_members")} AS grade_plus FROM h"""
)
def document_summary(spark, sf_dir):
    units = documents(spark, sf_dir)
    return _rounded(summary(units, written(exact_pairs(units), "exact")))


@query()
def document_summary_all(spark, sf_dir):
    """document_summary over the pairs of both passes, which are counted as they are found and not kept."""
    units = documents(spark, sf_dir)
    return _rounded(summary_of(units, written(tally(detect(units, NEAR_THRESHOLD)), "tally")))


def _rounded(s: DataFrame) -> DataFrame:
    return s.withColumns({c: F.round(c, 6) for c in ("rate_pairs", "rate_members", "score", "score_members")})


@query(
    _EXACT
    + f""", c AS (SELECT filename, count(*) AS n_units FROM u GROUP BY filename), p AS (SELECT file1 AS filename, count(*) AS n_pairs FROM pairs WHERE file1 = file2 GROUP BY file1),
  h AS (SELECT filename, n_units, coalesce(n_pairs, 0) AS n_pairs, greatest(0.0, least(100.0, 100.0 - coalesce(n_pairs, 0) * 2 / n_units::DOUBLE * 100)) AS score FROM c LEFT JOIN p USING (filename))
  SELECT filename, n_units, n_pairs, round(score, 6) AS score, {_GRADE} AS grade, {_GRADE_PLUS.format(s="score")} AS grade_plus, CASE WHEN score >= 75 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS color FROM h"""
)
def health_by_source(spark, sf_dir):
    units = documents(spark, sf_dir)
    return _by_source(units, exact_pairs(units).where("file1 = file2").groupBy(F.col("file1").alias("filename")).agg(F.count("*").alias("n")))


@query()
def health_by_source_all(spark, sf_dir):
    """health_by_source over the pairs of both passes, which are counted within each source."""
    units = documents(spark, sf_dir)
    return _by_source(units, file_counts(units, NEAR_THRESHOLD))


def _by_source(units: DataFrame, counts: DataFrame) -> DataFrame:
    h = units.groupBy("filename").agg(F.count("*").alias("n_units")).join(counts, "filename", "left").withColumn("n_pairs", F.coalesce("n", F.lit(0).cast("long")))
    h = h.withColumn("score", health.health_score(health.pair_rate(F.col("n_pairs"), F.col("n_units")), F.lit(0), False))
    return h.select("filename", "n_units", "n_pairs", F.round("score", 6).alias("score"), health.grade(F.col("score")).alias("grade"), health.grade_plus(F.col("score")).alias("grade_plus"), health.grade_color(F.col("score")).alias("color"))


@query(
    _EXACT
    + """ SELECT idx1, idx2, 'The tokens of `' || name1 || '` and `' || name2 || '` agree, so one was probably copy-pasted: keep a single helper; ' ||
  CASE WHEN file1 = file2 THEN 'a same-file refactor in ' || file1 || ' will do.' ELSE 'a common header can hold it for ' || file1 || ' and ' || file2 || '.' END AS suggestion FROM pairs"""
)
def suggestions(spark, sf_dir):
    return with_suggestion(exact_pairs(documents(spark, sf_dir))).select("idx1", "idx2", "suggestion")


@query("""SELECT page_id, regexp_extract(url, '[^/\\\\]*$') AS base, replace(replace(url, 'https:' || chr(92), ''), 'https:/', '') AS short, contains(url, 'example.net') OR contains(url, '/de/') AS ignored FROM pages WHERE url IS NOT NULL""")
def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return p.select("page_id", text.basename(F.col("url")).alias("base"), text.shorten(F.col("url"), "https:").alias("short"), (F.contains("url", F.lit("example.net")) | F.contains("url", F.lit("/de/"))).alias("ignored"))


@query("""SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 25) AS lines, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS as_html,
  replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS as_json FROM documents""")
def report_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_lines(F.col("text")).alias("lines"), text.escape_html(F.col("text")).alias("as_html"), text.escape_json(F.col("text")).alias("as_json"))


# -- winnowing ------------------------------------------------------------------------------------
def _grams(source: str, key: str) -> str:
    return f"SELECT {key}, CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: t[i] || t[i+1] || t[i+2] || t[i+3]) ELSE [] END AS g FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM {source})"


def _prints(source: str, key: str) -> str:
    hashed = f"SELECT {key}, list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT) AS h FROM ({_grams(source, key)})"
    return f"SELECT {key}, CASE WHEN len(h) = 0 THEN [] WHEN len(h) < 4 THEN [list_min(h)] ELSE list_sort(list_distinct(list_transform(range(1, len(h) - 2), lambda i: least(h[i], h[i+1], h[i+2], h[i+3])))) END AS f FROM ({hashed})"


@query(f"SELECT doc_id, f AS fingerprints FROM ({_prints('documents', 'doc_id')})")
def winnow_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", winnow.fingerprints(tokens(F.coalesce("text", F.lit(""))), hash_of=winnow.md5_hash).alias("fingerprints"))


@query(f"WITH f AS ({_prints('(SELECT conv_id * 1000 + turn AS item_id, text FROM conversations)', 'item_id')}), r AS (SELECT item_id, unnest(f) AS x FROM f), s AS (SELECT a.item_id AS idx1, b.item_id AS idx2, count(*) AS n FROM r a JOIN r b ON a.x = b.x AND a.item_id < b.item_id GROUP BY 1, 2) SELECT idx1, idx2, round(n / (len(a.f) + len(b.f) - n)::DOUBLE * 100, 6) AS similarity FROM s JOIN f a ON a.item_id = idx1 JOIN f b ON b.item_id = idx2")
def winnow_conversation_pairs(spark, sf_dir):
    turns = from_table(table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), "role", "text", "conv_id")
    return similar_pairs(turns, hash_of=winnow.md5_hash).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT doc_id, len(g)::BIGINT AS n_grams, len(list_distinct(g))::BIGINT AS n_distinct FROM ({_grams('documents', 'doc_id')})")
def kgram_counts(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", winnow.kgrams(tokens(F.coalesce("text", F.lit("")))).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


# -- semantic pass --------------------------------------------------------------------------------
@query(f"WITH {_SIMS} SELECT count(*) AS n_pairs, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS stddev FROM s")
def semantic_stats(spark, sf_dir):
    return pair_stats(vectors(spark, sf_dir)).select("n_pairs", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query(f"WITH {_SIMS} SELECT idx1, idx2, round(similarity, 4) AS similarity FROM s WHERE similarity >= 60")
def cosine_vector_pairs(spark, sf_dir):
    return cosine_pairs(vectors(spark, sf_dir), least=60.0).select("idx1", "idx2", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {_SIMS}, m AS (SELECT avg(similarity) AS mean, stddev_pop(similarity) AS std FROM s) SELECT idx1, idx2, round(similarity, 4) AS similarity, round((similarity - mean) / std, 4) AS zscore FROM s, m WHERE (similarity - mean) / std >= 2.5")
def semantic_outliers(spark, sf_dir):
    return outliers(vectors(spark, sf_dir)).select("idx1", "idx2", F.round("similarity", 4).alias("similarity"), F.round("zscore", 4).alias("zscore"))


@query(f"SELECT query, idx, round(similarity, 4) AS similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id AS idx, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10")
def knn_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest(v.where("idx % 50 = 0"), v, 10).select("query", "idx", F.round("similarity", 4).alias("similarity"), "rank")


@query(f"SELECT a.vec_id AS idx, round({_COS}, 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pair = v.join(v.select((F.col("idx") - 1).alias("idx"), F.col("vector").alias("next")), "idx")
    return pair.select("idx", F.round(cosine("vector", "next"), 4).alias("similarity"))
