import random
import re

from pyspark.sql import functions as F

from echoframe.functions import normalize as N


def apply(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("o"))
    return [r.o for r in sorted(df.collect())]


def plain_blocks(s):
    out, i = "", 0
    while i < len(s):
        if s.startswith("/*", i):
            end = s.find("*/", i + 2)
            if end < 0:
                return out + (s[-1] if len(s) > i + 2 else "")
            i = end + 2
        else:
            out += s[i]
            i += 1
    return out


def plain_normalize(s):
    s = re.sub(r"//[^\n]*", "", plain_blocks(s))
    return re.sub(r"[ \n\t\r]+", " ", s).strip(" ")


def plain_rename(s):
    names, out, at = {}, "", 0
    for m in re.finditer(N.TOKEN, s):
        out += s[at : m.start()]
        at = m.end()
        t = m[0]
        out += names.setdefault(t, f"VAR_{len(names)}") if re.match("[a-zA-Z]", t) and t not in N.KEYWORDS else t
    return out


def fuzz(n, alphabet):
    r = random.Random(4)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_normalize_examples(spark):
    a, b = apply(spark, N.normalize_code, ["  int add(int a, int b) {\n  // adds two numbers\n  return a + b;\n  }\n", "int x; /* this is\nmulti-line */ int y;"])
    assert "//" not in a and "  " not in a and a == a.strip()
    assert "/*" not in b
    assert apply(spark, N.normalize_code, ["ab/* xyz"]) == ["abz"]


def test_a_line_comment_can_open_a_block(spark):
    assert apply(spark, N.normalize_code, ["a // b /* c\nd */ e"]) == ["a"]


def test_normalize_fuzz(spark):
    texts = fuzz(2000, "a/* \n\t\r")
    assert apply(spark, N.normalize_code, texts) == [plain_normalize(t) for t in texts]


def test_rename_examples(spark):
    one, two = apply(spark, N.rename_identifiers, ["int add(int a, int b) { return a + b; }", "int n = 5; return n + n;"])
    assert "VAR_" in one and "int" in one and "return" in one
    assert two.count("VAR_0") == 3
    assert apply(spark, N.rename_identifiers, ["_x y", "0x1F", 'a = "b"', ""]) == ["_x VAR_0", "0VAR_0", 'VAR_0 = "VAR_1', ""]


def test_rename_fuzz(spark):
    texts = fuzz(1500, "ab_1 \n+(;\"é")
    assert apply(spark, N.rename_identifiers, texts) == [plain_rename(t) for t in texts]


def test_lengths_are_bytes(spark):
    df = spark.createDataFrame([("éé", "ee")], "a string, b string")
    r = df.select(F.length(N.byte_view(F.col("a"))).alias("n"), F.levenshtein(N.byte_view(F.col("a")), F.col("b")).alias("d")).first()
    assert (r.n, r.d) == (4, 4)


def test_prepare_caps_bytes(spark):
    body = "x" * 499 + "é" + "y" * 100
    assert apply(spark, N.prepare, [body]) == ["VAR_0"]
