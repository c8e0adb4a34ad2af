"""Queries over the front door: source trees, git, settings, the tokenizer, and reports read back.

Trees and settings are written from rows of the test tables to the shared folder, read by the
library's sources, and compared with SQL that knows the rows. Importing this module registers them.
"""

from __future__ import annotations

import html
import io
import json
import os
import re
import subprocess
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.cli import parser, settings
from echoframe.functions import health, text
from echoframe.functions.bpe import END_ID, MAX_LENGTH, START_ID, UNKNOWN_ID, Tokenizer, byte_symbols, encode_column, pre_tokenize, to_symbols
from echoframe.operators.semantic import cosine_pairs, outliers
from echoframe.plans.scan import detect, run_scan
from echoframe.plans.storage import ranked, shared_dir
from echoframe.queries import _ITEMS, _RANKED, _SIMS, NEAR_THRESHOLD, items, query, table, vectors
from echoframe.reports.writers import write_html, write_json, write_text
from echoframe.sources import git
from echoframe.sources.files import read_tree
from echoframe.sources.functions_in import units_of

#: A tokenizer.json.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"


# -- source trees ---------------------------------------------------------------------------------
def _folder(spark: SparkSession) -> str:
    at = f"{shared_dir(spark).removeprefix('file://')}/echoframe-tree-{uuid.uuid4().hex}"
    os.makedirs(at)
    return at


def _grown(spark: SparkSession, rows: DataFrame, path: Column, content: Column) -> str:
    """A new folder with a file for each row."""
    root = _folder(spark)
    for p, c in rows.select(path, content).toLocalIterator():
        at = os.path.join(root, p)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8", newline="") as f:
            f.write(c)
    return root


def _below(root: str) -> Column:
    return F.substring(F.col("path"), F.lit(len(root) + 2), F.lit(1 << 30)).alias("path")


_KINDS = (".cpp", ".h", ".txt")
_PATH = "'d' || (item_id % 7) || '/_f' || item_id || ['.cpp', '.h', '.txt'][item_id % 3 + 1]"


def _items_tree(spark: SparkSession, sf_dir: str) -> str:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("item_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("d"), (F.col("item_id") % 7).cast("string"), F.lit("/_f"), F.col("item_id").cast("string"), kind)
    return _grown(spark, table(spark, sf_dir, "benchmark"), path, F.concat(F.coalesce("text", F.lit("")), F.lit("\r\nend\r\n")))


_KEPT = f"SELECT {_PATH} AS path, coalesce(text, '') AS text FROM benchmark WHERE item_id % 3 < 2 AND item_id % 7 != 3"


@query(f"SELECT path, text || chr(13) || chr(10) || 'end' || chr(13) || chr(10) AS content FROM ({_KEPT})")
def tree_contents(spark, sf_dir):
    """Files with the extensions, but those with an ignored text in the path; carriage returns stay."""
    root = _items_tree(spark, sf_dir)
    return read_tree(spark, root, ["/d3/", "no such text"]).select(_below(root), "content")


@query(f"SELECT path, replace(text, chr(13), '') || chr(10) || 'end' || chr(10) AS content FROM ({_KEPT})")
def tree_plain_contents(spark, sf_dir):
    """As tree_contents, without carriage returns."""
    root = _items_tree(spark, sf_dir)
    return read_tree(spark, root, ["/d3/"], keep_returns=False).select(_below(root), "content")


@query(f"SELECT {_PATH} AS path FROM benchmark WHERE item_id % 3 < 2 AND item_id % 2 = 0")
def tree_tracked(spark, sf_dir):
    """Files of the tree that git tracks: those with an even number."""
    root = _items_tree(spark, sf_dir)
    even = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if int(re.search(r"\d+", n)[0]) % 2 == 0]
    for args in (["init", "-q"], ["-c", "core.autocrlf=false", "add", "--", *even]):
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True)
    return git.only_tracked(read_tree(spark, root), root).select(_below(root))


_CODE = (
    "#include <x.h>\n\nint f{i}(int a) {{\n  if (a > {k}) {{ return a; }}\n  return {k};\n}}\n\nvoid ns::g{i} ()\n{{\n\tcall({m}); // {i}\n}}\nint lone;\n  {{ }}\n"
)
_BODY_F = "'{' || chr(10) || '  if (a > ' || k || ') { return a; }' || chr(10) || '  return ' || k || ';' || chr(10) || '}'"
_BODY_G = "'{' || chr(10) || chr(9) || 'call(' || m || '); // ' || item_id || chr(10) || '}'"
_FUNCTIONS = f"""WITH s AS (SELECT item_id, item_id % 9 AS k, item_id % 11 AS m, 'd' || (item_id % 7) || '/f' || item_id || '.cpp' AS file FROM benchmark),
  f AS (SELECT 'f' || item_id AS name, {_BODY_F} AS body, file, 1 AS n, 'f' || k AS norm FROM s UNION ALL SELECT 'g' || item_id, {_BODY_G}, file, 2, 'g' || m FROM s),
  u AS (SELECT row_number() OVER (ORDER BY file, n) AS idx, * FROM f)"""


def _code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    number = lambda by: (F.col("item_id") % by).cast("string")
    i = F.col("item_id").cast("string")
    code = F.lit(_CODE.format(i="<i>", k="<k>", m="<m>"))
    for mark, value in (("<i>", i), ("<k>", number(9)), ("<m>", number(11))):
        code = F.replace(code, F.lit(mark), value)
    root = _grown(spark, rows, F.concat(F.lit("d"), number(7), F.lit("/f"), i, F.lit(".cpp")), code)
    units = units_of(read_tree(spark, root))
    return units.withColumn("filename", F.substring("filename", F.lit(len(root) + 2), F.lit(1 << 30)))


@query(_FUNCTIONS + " SELECT idx, name, body, file AS filename FROM u")
def tree_functions(spark, sf_dir):
    """Functions found by matching braces, with the brace on the head's line or on the next one."""
    return _code_units(spark, sf_dir)


@query(_FUNCTIONS + " SELECT a.idx AS idx1, a.name AS name1, a.file AS file1, b.idx AS idx2, b.name AS name2, b.file AS file2, 100.0::DOUBLE AS similarity FROM u a JOIN u b ON a.norm = b.norm AND a.idx < b.idx")
def tree_pairs(spark, sf_dir):
    """Source tree to pairs: comments do not count, and bodies this short have no near pass."""
    return detect(_code_units(spark, sf_dir), NEAR_THRESHOLD).drop("zscore", "kind")


# -- settings -------------------------------------------------------------------------------------
@query("""SELECT 'ignore' AS key, n_nationkey AS place, n_name AS value FROM nation UNION ALL SELECT 'ignore', 25 + r_regionkey, r_name FROM region
  UNION ALL SELECT * FROM (VALUES ('path', 0, 'src'), ('threshold', 0, '91.5'), ('output', 0, 'out.txt'), ('html', 0, 'a.html'), ('json', 0, 'b.json'), ('git_only', 0, 'True'), ('zscore', 0, '3.0'))""")
def scan_settings(spark, sf_dir):
    """A settings file with comments, blanks and lines that cannot be used, and flags that go over it; ignored texts add up."""
    at = f"{_folder(spark)}/settings.txt"
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    lines = ["# settings", "", "path = lib", " threshold=70 ", "threshold=high", "html=a.html", "git-only=1", "no sign", "unknown=1", *(f"ignore = {n} \t" for n in names)]
    with open(at, "w", encoding="utf-8") as f:
        f.write("\r\n".join(lines))
    more = [x for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect() for x in ("--ignore", r.r_name)]
    c = settings(parser().parse_args(["--config", at, "--path", "src", "--threshold", "91.5", "--output", "out.txt", "--json", "b.json", "--semantic-zscore", "3", *more]))
    rows = [("ignore", k, v) for k, v in enumerate(c.ignore)] + [(n, 0, str(getattr(c, n))) for n in ("path", "threshold", "output", "html", "json", "git_only", "zscore")]
    return spark.createDataFrame(rows, "key string, place int, value string")


# -- tokenizer ------------------------------------------------------------------------------------
_SPACES = r"[ \t\n\v\f\r]"
_OTHERS = r"[^ \t\n\v\f\rA-Za-z0-9]"
#: A run of white space before a word gives up its last character to it; RE2 cannot look ahead, so it is cut afterwards.
_ROUGH = rf"'(?:s|t|re|ve|m|ll|d)|{_SPACES}*[A-Za-z]+|{_SPACES}*[0-9]+|{_SPACES}*{_OTHERS}+|{_SPACES}+"
_PIECES = f"""SELECT item_id, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{_ROUGH.replace("'", "''")}'), lambda t: CASE WHEN regexp_matches(t, '^{_SPACES}{_SPACES}+[^ \\t\\n\\v\\f\\r]')
  THEN [regexp_extract(t, '^({_SPACES}+){_SPACES}', 1), regexp_extract(t, '^{_SPACES}+({_SPACES}[^ \\t\\n\\v\\f\\r].*)', 1)] ELSE [t] END)) AS pieces FROM benchmark"""
_BYTES = "[" + ", ".join("'" + byte_symbols()[b].replace("'", "''") + "'" for b in range(256)) + "]"


def _symbols_sql(c: str) -> str:
    return f"list_transform(range(0, octet_length(encode({c}))), lambda i: s.c[('0x' || substr(hex(encode({c})), 2 * i + 1, 2))::INTEGER + 1])"


@query(f"WITH s AS (SELECT {_BYTES} AS c) SELECT item_id, {_symbols_sql('coalesce(text, chr(32))')} AS symbols FROM benchmark, s")
def byte_symbols_of_items(spark, sf_dir):
    """The visible character of each byte."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf.item_id, "symbols": [to_symbols(t or " ") for t in pdf.text]})

    return table(spark, sf_dir, "benchmark").mapInPandas(run, "item_id long, symbols array<string>")


@query(_PIECES)
def pretokenized_items(spark, sf_dir):
    """Pieces of each benchmark item before byte-pair merging."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf.item_id, "pieces": [pre_tokenize(t or "") for t in pdf.text]})

    return table(spark, sf_dir, "benchmark").mapInPandas(run, "item_id long, pieces array<string>")


_VOCABULARY = f"""j AS (SELECT json_extract(content, '$.model') AS m FROM read_text('{TOKENIZER_FILE}')),
  v AS (SELECT e.key AS symbol, e.value AS id FROM (SELECT unnest(map_entries(json_transform(json_extract(m, '$.vocab'), '"MAP(VARCHAR,BIGINT)"'))) AS e FROM j))"""


@query(f"WITH {_VOCABULARY}, w AS (SELECT DISTINCT 'Ġ' || unnest(regexp_extract_all(text, '[A-Za-z]+')) AS symbol FROM benchmark) SELECT symbol, id FROM w JOIN v USING (symbol)")
def vocabulary_ids(spark, sf_dir):
    """Words of the items that the vocabulary of the tokenizer file has whole."""
    vocab = spark.createDataFrame(pd.DataFrame(Tokenizer.load(TOKENIZER_FILE).vocab.items(), columns=["symbol", "id"]))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.concat(F.lit("Ġ"), "w").alias("symbol")).distinct()
    return words.join(vocab, "symbol").select("symbol", F.col("id").cast("long").alias("id"))


#: Symbols stand between two blanks each, so that replacing a pair merges all its places from the left on.
@query(
    f"""WITH RECURSIVE {_VOCABULARY}, s AS (SELECT {_BYTES} AS c),
  g AS (SELECT unnest(json_transform(json_extract(m, '$.merges'), '["JSON"]')) AS g, unnest(range(0, json_array_length(json_extract(m, '$.merges'))::BIGINT)) AS rank FROM j),
  merges AS (SELECT CASE WHEN json_type(g) = 'ARRAY' THEN g->>0 ELSE split_part(g->>'$', ' ', 1) END AS l, CASE WHEN json_type(g) = 'ARRAY' THEN g->>1 ELSE split_part(g->>'$', ' ', 2) END AS r, rank FROM g),
  p AS ({_PIECES}), w AS (SELECT DISTINCT unnest(pieces) AS piece FROM p),
  steps AS (SELECT piece, ' ' || array_to_string({_symbols_sql('piece')}, '  ') || ' ' AS t, 0 AS n FROM w, s
    UNION ALL
    SELECT piece, replace(t, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' '), n + 1 FROM (
      SELECT piece, n, any_value(t) AS t, arg_min(l, rank) AS l, arg_min(r, rank) AS r FROM (
        SELECT piece, t, n, unnest(list_slice(x, 1, len(x) - 1)) AS l, unnest(list_slice(x, 2, len(x))) AS r FROM (SELECT piece, t, n, string_split(trim(t), '  ') AS x FROM steps) WHERE len(x) > 1) JOIN merges USING (l, r) GROUP BY piece, n)),
  done AS (SELECT piece, arg_max(t, n) AS t FROM steps GROUP BY piece),
  parts AS (SELECT piece, list(coalesce(id, {UNKNOWN_ID}) ORDER BY k) AS ids FROM (SELECT piece, unnest(string_split(trim(t), '  ')) AS symbol, unnest(range(0, len(string_split(trim(t), '  ')))) AS k FROM done) LEFT JOIN v USING (symbol) GROUP BY piece),
  each AS (SELECT item_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS k FROM p),
  body AS (SELECT item_id, flatten(list(ids ORDER BY k)) AS ids FROM each JOIN parts USING (piece) GROUP BY item_id)
  SELECT b.item_id, list_concat(list_concat([{START_ID}], list_slice(coalesce(ids, []), 1, {MAX_LENGTH - 2})), [{END_ID}]) AS ids FROM benchmark b LEFT JOIN body USING (item_id)"""
)
def encoded_items(spark, sf_dir):
    """Ids of each item: pieces, byte symbols, merges by rank, vocabulary, and the ids around a text."""
    return encode_column(table(spark, sf_dir, "benchmark").select("item_id", "text"), Tokenizer.load(TOKENIZER_FILE), "text").select("item_id", "ids")


# -- reports, read back ---------------------------------------------------------------------------
_REPORTED = _RANKED.replace("round(similarity, 6) AS similarity", "round(similarity, 1) AS similarity").replace(" SELECT row_number()", " SELECT row_number()")


def _reported(spark: SparkSession, sf_dir: str, write) -> str:
    out = io.StringIO()
    write(run_scan(items(spark, sf_dir), NEAR_THRESHOLD), "benchmark", out)
    return out.getvalue()


@query(f"SELECT rank, name1, file1, name2, file2, similarity FROM ({_REPORTED})")
def json_report_pairs(spark, sf_dir):
    doc = json.loads(_reported(spark, sf_dir, write_json))
    rows = [(n, p["function1"], p["file1"], p["function2"], p["file2"], float(p["similarity"])) for n, p in enumerate(doc["duplicates"], 1)]
    return spark.createDataFrame(rows, "rank long, name1 string, file1 string, name2 string, file2 string, similarity double")


@query(_ITEMS + " SELECT (SELECT count(*) FROM u) AS functions, count(*) AS pairs, round(count(*) * 2 / (SELECT count(*) FROM u)::DOUBLE * 100, 1) AS rate, round(greatest(0.0, least(100.0, 100.0 - count(*) * 2 / (SELECT count(*) FROM u)::DOUBLE * 100)), 1) AS score FROM pairs")
def json_report_totals(spark, sf_dir):
    doc = json.loads(_reported(spark, sf_dir, write_json))
    return spark.createDataFrame([(doc["totalFunctions"], doc["duplicatesFound"], float(doc["duplicationRate"]), float(doc["healthScore"]))], "functions long, pairs long, rate double, score double")


@query(f"SELECT rank, name1, file1, name2, file2, similarity FROM ({_REPORTED})")
def text_report_pairs(spark, sf_dir):
    found = re.findall(r"  #(\d+)  ([\d.]+) %\n    (\S+)  (\S+)\n    (\S+)  (\S+)\n", _reported(spark, sf_dir, write_text))
    return spark.createDataFrame([(int(n), a, f, b, g, float(s)) for n, s, a, f, b, g in found], "rank long, name1 string, file1 string, name2 string, file2 string, similarity double")


@query(f"SELECT rank, name1, file1, name2, file2, similarity, CASE WHEN whole >= 95 THEN 'red' WHEN whole >= 85 THEN 'yellow' ELSE 'green' END AS color, (rank - 1) // 25 + 1 AS page FROM ({_REPORTED.replace('round(similarity, 1) AS similarity', 'similarity AS whole, round(similarity, 1) AS similarity')})")
def html_report_pairs(spark, sf_dir):
    found = re.findall(r'<tr class="p" data-n="[^"]*"><td>(\d+)<td class="(\w+)">([\d.]+) %<td>(\S+) <small>(.*?)</small><br>(\S+) <small>(.*?)</small>', _reported(spark, sf_dir, write_html))
    rows = [(int(n), *map(html.unescape, (a, f, b, g)), float(s), c, (int(n) - 1) // 25 + 1) for n, c, s, a, f, b, g in found]
    return spark.createDataFrame(rows, "rank long, name1 string, file1 string, name2 string, file2 string, similarity double, color string, page long")


# -- semantic half --------------------------------------------------------------------------------
_OUTLIERS = f"WITH {_SIMS}, m AS (SELECT avg(similarity) AS mean, stddev_pop(similarity) AS std FROM s), o AS (SELECT idx1, idx2, similarity, (similarity - mean) / std AS zscore FROM s, m WHERE (similarity - mean) / std >= 2.5)"


@query(_OUTLIERS + " SELECT row_number() OVER (ORDER BY round(zscore, 6) DESC, idx1, idx2) AS rank, idx1, idx2 FROM o")
def semantic_ranking(spark, sf_dir):
    """Outliers by falling z-score."""
    return ranked(outliers(vectors(spark, sf_dir)), F.round("zscore", 6).desc(), F.col("idx1"), F.col("idx2")).select("rank", "idx1", "idx2")


@query(
    _OUTLIERS
    + """ SELECT idx1, idx2, 'The CodeBERT vectors of `v' || idx1 || '` and `v' || idx2 || '` lie unusually close: one function may serve for both; ' ||
  CASE WHEN idx1 % 5 = idx2 % 5 THEN 'a same-file refactor in f' || (idx1 % 5) || ' will do.' ELSE 'a common header can hold it for f' || (idx1 % 5) || ' and f' || (idx2 % 5) || '.' END AS suggestion FROM o"""
)
def semantic_suggestions(spark, sf_dir):
    named = lambda p, i: F.concat(F.lit(p), i.cast("string"))
    a, b = F.col("idx1"), F.col("idx2")
    return outliers(vectors(spark, sf_dir)).select("idx1", "idx2", text.suggestion(named("v", a), named("f", a % 5), named("v", b), named("f", b % 5), True).alias("suggestion"))


@query(f"WITH {_SIMS} SELECT idx1, idx2, CASE WHEN similarity >= 95 THEN 'red' WHEN similarity >= 85 THEN 'yellow' ELSE 'green' END AS color FROM s WHERE similarity >= 62")
def similarity_colors(spark, sf_dir):
    return cosine_pairs(vectors(spark, sf_dir), least=62.0).select("idx1", "idx2", text.similarity_color(F.col("similarity")).alias("color"))


@query("SELECT p_partkey, round(greatest(0.0, least(100.0, 100.0 - p_size - (p_partkey % 23) * 5)), 6) AS score_on, round(greatest(0.0, least(100.0, 100.0 - p_size::DOUBLE)), 6) AS score_off FROM part")
def semantic_scores(spark, sf_dir):
    """The health score with the semantic pass on and off."""
    rate, found = F.col("p_size").cast("double"), F.col("p_partkey") % 23
    return table(spark, sf_dir, "part").select("p_partkey", F.round(health.health_score(rate, found, True), 6).alias("score_on"), F.round(health.health_score(rate, found, False), 6).alias("score_off"))
