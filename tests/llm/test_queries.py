import hashlib
import re

import pytest

import corpus_pipeline
from echoframe.llm import decontam, linededup, neardup, pieces, quality, queries, tokenshards
from tests.conftest import SF
from tests.llm.fixtures import corpus, frame
from tests.llm.test_dedup import plain_components, plain_pair_dedup
from tests.llm.test_text import plain_decontam, plain_kept, plain_quality
from tests.test_queries import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op5_minhash_neardup"](spark, SF).collect()), key=repr)
    assert got == plain_components(rows, 2, 80)


def test_whole_tables_are_read(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name in ("op1_line_dedup", "op2_sentencepiece", "op6_pii_surrogates", "op9_quality_fertility"):
        assert queries.QUERIES[name](spark, SF).count() == docs
    assert queries.QUERIES["op3_html_main_text"](spark, SF).count() == pages


def test_personal_data_is_gone_and_the_rest_is_not_touched(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pattern = re.compile(r"[\w.]+@mail\d\.example\.com|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\(\d{3}\) 555-\d{4}|\"[0-9a-f]{40}\"")
    for r in queries.QUERIES["op6_pii_surrogates"](spark, SF).collect():
        planted = pattern.findall(docs[r.doc_id])
        assert not any(p in r.text for p in planted)
        if not planted:
            assert r.text == docs[r.doc_id] or r.changed


ENCODERS = quality.Encoders(pieces.Encoder(pieces.PieceTable.load(f"{pieces.TOKENIZER_DIR}/{pieces.MODEL}")), tokenshards.BpeEncoder(tokenshards.ByteBpe.load(f"{pieces.TOKENIZER_DIR}/{quality.BYTE_VOCABULARY}")))


def plain_pipeline(spark, rows, langs, items):
    """The five stages by brute force, one text at a time."""
    import pyarrow as pa

    kept = []
    for (i, t), lang in zip(rows, langs, strict=True):
        n, _, _, _, repeat = plain_quality(t)
        # beyond 500 words the brute force does not count repeated words
        failed = n < 50 or bool(100 * repeat > 50 * n if repeat is not None else next(quality.judge(pa.array([t]), None, ENCODERS, quality.Rules()))[2][0])
        if t and plain_kept(t, lang, failed):
            kept.append((i, t))
    removed = {(r[0], r[4]) for r in plain_pair_dedup(kept)}
    texts = []
    df = linededup.apply(spark.createDataFrame(kept, "doc_id long, text string"), pairs=True)
    for r in df.collect():
        assert (r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) in removed
        texts.append((r.doc_id, r.text))
    keep = {r[0] for r in plain_components(texts, 5, 80) if r[3]}
    texts = [x for x in texts if x[0] in keep]
    clean = {w[0] for w in plain_decontam(texts, items) if not w[5]}
    return sorted((i, t) for i, t in texts if i in clean)


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = [d for d in docs if d[1] and len(d[1].split()) > 150]
    lines = "\n".join(long[3][1].replace("\n", " ").split(". ")[:4])
    docs += [(100_000, docs[5][1], docs[5][2]), (100_001, "Licensed text. " + " ".join(d[1] for d in long[:4])[:2000], long[0][2]), (100_002, None, "en"), (100_003, "", None)]
    docs += [(100_010 + k, f"{long[5 + k][1]}\n{lines}\n{long[15 + k][1]}", long[5 + k][2]) for k in range(4)]
    docs += [(200_000 + i, t, None) for i, t in corpus(11)[:20] if i is not None]
    rows, langs = [d[:2] for d in docs], [d[2] for d in docs]
    items = [(1, " ".join(long[1][1].split()[:12])), (2, " ".join(long[1][1].split()[12:30])), (3, "nothing of this is there at all in them")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == plain_pipeline(spark, rows, langs, items) and 50 < len(got) < len(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    assert out.where("n_chars != char_length(text)").count() == 0
    back = pieces.decode(out.select("token_ids", "text"), out="again")
    assert back.where("NOT (text <=> again)").count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table gives an empty one; rows with a null doc_id, without text and repeated rows pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text, lang = next((r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1").orderBy("doc_id").collect())
    rows = [(None, text + " one more", lang, None, None), (5, text, lang, "s", 1), (5, text, lang, "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0)]
    for name, data in (("none", []), ("odd", rows)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(repr(r.doc_id) for r in out) == ["5", "5", "None"] and all(r.token_ids for r in out)


def test_pipeline_rejects_a_passage_of_a_single_item(spark, tmp_path):
    item = "the first of all the test items has rather more than eight words in it"
    rows = [(1, f"before it {item} and after it"), (2, "before it the first of all the test and after it"), (3, None)]
    spark.createDataFrame([(1, item), (2, "another item that no document has a window of at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontam.reject(frame(spark, rows), bench, test_bytes=1, any_window=True)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_operators_take_frames_with_clashing_names(spark):
    df = frame(spark, corpus(12))
    assert neardup.dedup(df).columns == df.columns and linededup.apply(df).columns == df.columns and quality.reject(df).columns == df.columns
    assert decontam.reject(df, spark.createDataFrame([(1, "x y")], "item_id long, text string")).columns == df.columns
