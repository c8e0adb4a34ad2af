import math
import random
import threading

import duckdb
import pytest

import __spark_entry__
from echoframe import queries as core
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n in core.ORACLES])
def test_against_sql(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.ORACLES[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "suggestion" in df.columns


def test_registries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_health_counts_near_pairs_of_documents(spark, tmp_path):
    body = " ".join(f"word{i} + {i};" for i in range(40))
    rows = [(1, body, "a", "s", 1), (2, body.replace("+ 7;", "- 7;"), "b", "s", 1), (3, "int x;", "c", "s", 1), (4, "int x;", "d", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    near = core.QUERIES["near_document_pairs"](spark, str(tmp_path)).collect()
    assert [(r.idx1, r.idx2) for r in near] == [(1, 2)] and 70 <= near[0].similarity < 100
    s = core.QUERIES["document_summary_all"](spark, str(tmp_path)).first()
    assert (s.n_pairs, s.n_exact, s.n_near, s.n_members) == (2, 1, 1, 4)
    assert {r.filename: r.n_pairs for r in core.QUERIES["health_by_source_all"](spark, str(tmp_path)).collect()} == {"s": 1, "t": 0}


@pytest.mark.parametrize("name", ["text_report_pairs", "html_report_pairs", "json_report_pairs"])
def test_reports_round_halves_up(spark, tmp_path, name):
    bodies = ["1" * 80, "2" * 15 + "1" * 65]  # 81.25 %
    spark.createDataFrame(list(enumerate(bodies)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    got, want = core.QUERIES[name](spark, str(tmp_path)), con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert [tuple(r[n] for n in names) for r in got.collect()] == want.fetchall() and got.first().similarity == 81.3


def test_summary_of_both_passes_keeps_no_pairs(spark, tmp_path, monkeypatch):
    body = " ".join(f"word{i} + {i};" for i in range(40))
    rows = [(n, body.replace(f"+ {n};", f"- {n};"), "ab"[n % 2], "s", 1) for n in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept, written = [], core.written

    def seen(df, what):
        out = written(df, what)
        kept.append(out.count())
        return out

    monkeypatch.setattr(core, "written", seen)
    s = core.QUERIES["document_summary_all"](spark, str(tmp_path)).first()
    # 36 pairs of an a and a b
    assert (s.n_pairs, s.n_exact, s.n_near, s.n_members) == (36, 0, 36, 2) and all(n <= 2 for n in kept)


def test_documents_of_different_sources_are_not_compared(spark, tmp_path):
    """The 8 million pairs of different sources did not end in this time."""
    r = random.Random(1)
    rows = []
    for n in range(2000):
        body = "".join(r.choice("0123456789") for _ in range(490))
        rows += [(2 * n, body, "a", f"s{n}", 1), (2 * n + 1, body[:300] + "+" + body[300:], "b", f"s{n}", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert [tuple(x) for x in core.QUERIES["health_by_source_all"](spark, str(tmp_path)).groupBy("n_units", "n_pairs").count().collect()] == [(2, 1, 2000)]
    finally:
        late.cancel()
