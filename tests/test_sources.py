import json
import subprocess

import pytest

from echoframe import cli
from echoframe.config import ScanConfig, load_config
from echoframe.functions import bpe
from echoframe.plans.scan import source_units
from echoframe.sources import files, git
from echoframe.sources.functions_in import FunctionsIn, functions_in, head_name, is_head, units_of

A = "int add(int a, int b)\n{\n  int result = a + b; // sum of both\n  if (result > 1000) { result = 1000; } else { result = result + 0; }\n  return result + a * b - 12345;\n}\n"


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.cpp": A, "b/_b.cpp": A.replace("add", "add"), ".hid/e.h": "void e() { call(1); }\n", "rebuild/x.cpp": A, "c.hpp": A, "d.CPP": A, "r.cpp": "int r() {\r\n return 1;\r\n}\r\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return tmp_path


def test_scan_lists_hidden_files_and_ignores_by_substring(tree):
    names = [p.removeprefix(f"{tree}/") for p in files.scan(str(tree))]
    assert names == [".hid/e.h", "a.cpp", "b/_b.cpp", "r.cpp", "rebuild/x.cpp"]
    assert [p for p in files.scan(str(tree), ["build"]) if "rebuild" in p] == []
    assert files.scan(str(tree / "none")) == [] and files.scan(str(tree / "a.cpp")) == [] and files.scan(str(tree), [""]) == []


def test_tree_source_reads_whole_files(spark, tree):
    got = {r.path.removeprefix(f"{tree}/"): r.content for r in files.read_tree(spark, str(tree), ["rebuild"]).collect()}
    assert set(got) == {".hid/e.h", "a.cpp", "b/_b.cpp", "r.cpp"} and "\r" in got["r.cpp"] and got["a.cpp"] == A
    assert all("\r" not in r.content for r in files.read_tree(spark, str(tree), keep_returns=False).collect())


def test_git_filter(spark, tree):
    listed = files.read_tree(spark, str(tree))
    assert not git.is_repo(str(tree)) and git.only_tracked(listed, str(tree)).count() == 5
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    subprocess.run(["git", "-C", str(tree), "add", "a.cpp"], check=True)
    assert git.is_repo(str(tree)) and git.tracked(str(tree)) == ["a.cpp"]
    assert [r.path for r in git.only_tracked(listed, str(tree)).collect()] == [f"{tree}/a.cpp"]


def test_heads():
    assert is_head("int f(int a) ") and not is_head("if (a) ") and not is_head("format_t f()") and not is_head("(x)") and not is_head("f(")
    assert head_name("int  add (int a)") == "add" and head_name("operator+(a)") == ""


def test_functions_by_braces():
    assert [(n, b) for n, b, _ in functions_in("int f() { if (x) { y(); } }\nint g()\n{ return 1; }\n")] == [("f", "{ if (x) { y(); } }"), ("g", "{ return 1; }")]
    assert list(functions_in("int g()\n  { return 1; }")) == []  # an indented brace alone
    assert list(functions_in("int f() { never closed")) == []
    assert next(functions_in("int g()\n{ 1; }", whole=True))[1] == "int g()\n{ 1; }"


def test_units_are_numbered_by_file_and_place(spark, tree):
    u = units_of(files.read_tree(spark, str(tree))).orderBy("idx").collect()
    assert [r.idx for r in u] == list(range(1, len(u) + 1)) and [r.filename for r in u] == sorted(r.filename for r in u)
    spark.udtf.register("functions_in", FunctionsIn)
    spark.createDataFrame([(A,)], "content string").createOrReplaceTempView("files_")
    assert [r.name for r in spark.sql("SELECT f.name FROM files_, LATERAL functions_in(content) f").collect()] == ["add"]


def test_config(tmp_path, capsys):
    p = tmp_path / "c.txt"
    p.write_text("# comment\n path = src \nthreshold=x\nthreshold = 90\nignore=a\nignore=b=c\ngit-only=1\nwhat=1\nnothing\n")
    c = load_config(str(p))
    assert (c.path, c.threshold, c.ignore, c.git_only) == ("src", 90.0, ["a", "b=c"], True)
    assert capsys.readouterr().err.count("warning") == 3
    assert load_config(str(tmp_path / "none")) == ScanConfig()
    args = cli.parser().parse_args(["--config", str(p), "--threshold", "70", "--ignore", "d"])
    s = cli.settings(args)
    assert (s.threshold, s.ignore, s.git_only) == (70.0, ["a", "b=c", "d"], True)


def test_command_line_writes_reports(spark, tree, tmp_path, capsys):
    out = {k: str(tmp_path / f"r.{k}") for k in ("txt", "html", "json")}
    assert cli.main(["--path", str(tree), "--output", out["txt"], "--html", out["html"], "--json", out["json"], "--pairs", str(tmp_path / "pairs")]) == 0
    r = json.load(open(out["json"]))
    assert r["totalFunctions"] == 5 and r["duplicatesFound"] == 3 and r["healthGrade"] == "F" and all(d["similarity"] == 100.0 for d in r["duplicates"])
    text, page = open(out["txt"]).read(), open(out["html"]).read()
    assert "DUPLICATE PAIRS" in text and "\033" not in text and "add" in page and "Closest pair" in page
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 3
    capsys.readouterr()
    assert cli.main(["--path", str(tmp_path / "none")]) == 1 and cli.main(["--path", str(tree), "--threshold", "101"]) == 1 and cli.main([]) == 1
    assert cli.main(["--winnow", str(tree / "a.cpp"), str(tree / "a.cpp")]) == 0 and "100.00" in capsys.readouterr().out
    assert cli.main(["--functions", str(tree / "a.cpp")]) == 0
    assert source_units(spark, ScanConfig(path=str(tmp_path / "none"))) is None


def test_pretokenizer():
    assert bpe.pre_tokenize("I'll  go 42x\n") == ["I", "'ll", " ", " go", " 42", "x", "\n"]
    assert bpe.pre_tokenize("a\n\tb  ") == ["a", "\n", "\tb", "  "]


def test_bpe(spark, tmp_path):
    p = tmp_path / "t.json"
    vocab = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "a": 4, "b": 5, "ab": 6, "Ġ": 7, "Ġab": 8}
    p.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b", ["Ġ", "ab"]]}}) + " trailing")
    t = bpe.Tokenizer.load(str(p))
    assert t.encode("ab ab!") == [0, 6, 8, 3, 2] and t.encode("ab" * 10, 5) == [0, 6, 6, 6, 2]
    df = spark.createDataFrame([(1, "ab ab")], "idx long, body string")
    assert bpe.encode_column(df, t).first().ids == [0, 6, 8, 2]
    p.write_text("{}")
    with pytest.raises(ValueError):
        bpe.Tokenizer.load(str(p))


def test_lax_json_and_symbols():
    assert bpe.parse_json(r'{"a": "x\qy", "b": [1, null]} rest') == {"a": "xqy", "b": [1, None]}
    s = bpe.byte_symbols()
    assert len(set(s.values())) == 256 and s[32] == "Ġ" and s[65] == "A"
