"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("r", "s", "nt", "d") for c in ("a", "en", "i", "ou", "é")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, label string, band int, hash long"


def prose(r, n):
    out = [r.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("\n" if i % 11 == 10 else "") for i, w in enumerate(out))


def edited(r, text, share):
    return " ".join(w if r.random() > share else r.choice(WORDS) for w in text.split(" "))


def corpus(seed=1):
    """[(doc_id, text)]: unique texts, exact and near copies, shared passages, repeated lines, empty and null rows."""
    r = random.Random(seed)
    texts = [prose(r, r.choice([3, 12, 14, 40, 90, 150])) for _ in range(40)]
    base, passage, lines = prose(r, 120), prose(r, 30), "\n".join(prose(r, 8).replace("\n", "") for _ in range(9))
    texts += [base] * 6 + [edited(r, base, 0.01 * k) for k in range(12)]
    texts += [f"{prose(r, 20)} {passage} {prose(r, 15)}" for _ in range(6)] + [f"{prose(r, 9)}\n{lines}\n{prose(r, 9)}" for _ in range(4)]
    texts += ["ba " * 60, "ba " * 45, "", " \n ", "one", "ONE", prose(r, 6000), "é€😀 " * 20]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [rows[3], rows[3], (None, base), (None, None), (900, None), (901, texts[0].upper())]
    return rows


def frame(spark, rows, slices=3):
    """Documents with extra columns whose names clash with the operators' own."""
    data = [(i, t, r.choice(["en", "fr", None, "xx"]), "src", len(t or ""), "k", "l", 1, 2) for r in [random.Random(5)] for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(slices)


def words(text, lower=False, pattern=r"[^\x20\x09-\x0D]+"):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(pattern, text)
