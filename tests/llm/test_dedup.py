import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from echoframe.llm import linededup, neardup, substring
from echoframe.llm.components import connect
from tests.llm.fixtures import SCHEMA, corpus, frame, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- near-dedup -------------------------------------------------------------------------------------
def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    out = []
    for i, t in rows:
        w = words(t, lower=True)
        n = len({tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) if len(w) >= k else int(bool(w))
        c = find(i) if i is not None else None
        out.append((i, n, c, i is None or c == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = corpus()
    assert rows_of(neardup.components(frame(spark, rows), k, percent)) == plain_components(rows, k, percent)


def test_second_meeting_finds_links_outside_the_first(spark):
    # 0 leads its bucket; 1 and 2 are unlike 0 but alike
    w = [f"w{i}" for i in range(200)]
    a = w[:]
    b, c = w[:], w[:]
    for i in range(0, 200, 9):
        b[i] = c[i] = f"x{i}"
    c[100] = "y"
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(c))]
    got = rows_of(neardup.components(frame(spark, rows), 2, 80, bands=300, rows=2))
    assert got == plain_components(rows, 2, 80) and [r[2] for r in got] == [0, 1, 1]


def test_near_dedup_keeps_columns_and_one_of_each_group(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = neardup.dedup(df, k=5)
    assert out.schema == df.schema
    kept = {r[0] for r in plain_components(rows, 5, 80) if r[3]}
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows if i in kept)


def test_long_sets_that_share_nothing_meet_nowhere():
    import numpy as np

    r = np.random.RandomState(3)
    n = 1_000_000
    s = np.concatenate([np.sort(r.randint(0, 2**62, n).astype(np.uint64)) for _ in range(2)])
    keys = neardup.band_keys(s, np.array([0, n, 2 * n]), neardup.BANDS, neardup.ROWS)
    assert (keys[:, 0] != keys[:, 1]).all()


def test_near_dedup_of_nothing(spark):
    assert neardup.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_stars_connect(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201)]
    got = {r.node: r.component for r in connect(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}


def test_sketch_admits_similar_sets():
    import numpy as np

    r = np.random.RandomState(1)
    limit, far = neardup.sketch_limit(80), 0
    for _ in range(60):
        common, a, b, c = (r.randint(0, 2**62, n).astype(np.uint64) for n in (400, 50, 50, 260))
        x, y, z = (np.sort(np.concatenate(p)) for p in ((common, a), (common, b), (common, c)))
        s = neardup.sketches(np.concatenate([x, y, z]), np.cumsum([0, len(x), len(y), len(z)]))
        bits = np.unpackbits(s.view(np.uint8), axis=1)
        assert (bits[0] != bits[1]).sum() <= limit
        far += (bits[0] != bits[2]).sum() > limit
    assert far >= 55  # a similarity of 0.56 is ruled out


# -- substring dedup ----------------------------------------------------------------------------------
def plain_removed(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 12) if i is not None else ():
            first[tuple(w[j : j + 13])] = min(i, first.get(tuple(w[j : j + 13]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"bitmap_bytes": 0, "copies_bytes": 0}, {"shard_windows": 50, "shard_docs": 2}])
def test_substring_dedup_matches_brute_force(spark, bounds):
    rows = corpus(2)
    want = plain_removed(rows)
    assert rows_of(substring.dedup(frame(spark, rows), **bounds)) == want and sum(r[2] for r in want) > 500


def test_substring_texts(spark):
    rows = corpus(2)
    got = {(r.doc_id, r.n_removed, sha(r.text)) for r in substring.dedup(frame(spark, rows), with_text=True).collect()}
    assert got == {(r[0], r[2], r[3]) for r in plain_removed(rows) if r[2]}


@pytest.mark.parametrize("at_once", [substring.AT_ONCE, 7])
def test_shard_matches_brute_force(monkeypatch, at_once):
    """Spans of one automaton: several first documents, repeated words, blanks beyond ASCII inside words, few items at a time."""
    monkeypatch.setattr(substring, "AT_ONCE", at_once)
    r = random.Random(4)
    pool = ["a", "b", "a\u00a0b", "\u2003", "\u0436\u0437", "c" * 40]
    base = [[r.choice(pool) for _ in range(r.randint(13, 60))] for _ in range(12)] + [["a"] * 50]
    shard = substring.Shard()
    for k, p in enumerate(base):
        shard.add(k // 3, " ".join(p).encode())
    shard.compile()
    for _ in range(40):
        text = []
        for _ in range(4):
            p = r.choice(base)
            a = r.randint(0, len(p) - 5)
            text += p[a : a + r.randint(5, 40)] + [r.choice([*pool, "other"])]
        firsts = r.sample(range(7), 3)
        windows = {tuple(p[j : j + 13]) for k, p in enumerate(base) if k // 3 in firsts for j in range(len(p) - 12)}
        want = {q for j in range(len(text) - 12) if tuple(text[j : j + 13]) in windows for q in range(j, j + 13)}
        lo, hi = shard.spans(" \n".join(text).encode(), np.array(firsts))
        assert [q for s, e in zip(lo, hi, strict=True) for q in range(s, e)] == sorted(want)


def test_shard_memory():
    """Passages of 150,000 windows, and 4,000 texts: 65 MB with an automaton over characters and a batch of texts as strings, now 16."""
    code = """
import random, resource
import numpy as np, pyarrow as pa
from echoframe.llm import substring

class Rows:
    def mapInArrow(self, run, schema):
        return run

r = random.Random(1)
pool = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 10))) for _ in range(30000)]
text = lambda: " ".join(r.choices(pool, k=300))
passages, docs = [text() for _ in range(520)], [text() for _ in range(4000)]
n, m = len(passages), len(docs)
kind = [0] * n + [1] * m
batch = pa.RecordBatch.from_arrays([pa.array([0] * (n + m)), pa.array([0] * (n + m), pa.int32()), pa.array(kind, pa.int32()), pa.array([*range(n), *range(n, n + m)]), pa.array([0] * (n + m)), pa.array(passages + docs), pa.array([None] * n + [[0, 1]] * m, pa.list_(pa.int64()))], names=list("abcdefg"))
del passages, docs
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for b in substring.locate(Rows())(iter([batch])):
    pass
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(got.stdout) < 40


def test_substring_dedup_of_nothing(spark):
    assert substring.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


# -- line dedup ---------------------------------------------------------------------------------------
def plain_chunks(text):
    import numpy as np

    from echoframe.llm import textkernel as K

    lines = text.split("\n")
    raw = [np.frombuffer(x.encode(), np.uint8) for x in lines]
    h = [int(K.byte_hash(x, np.array([0]), np.array([len(x)]))[0]) for x in raw]
    chunks, own = [], []
    for k, line in enumerate(lines):
        own.append(line)
        before = h[k - 1] if k else 0
        roll = int(K.mix(np.array([(before * 0x9E3779B97F4A7C15 + h[k]) % 2**64], np.uint64))[0])
        if roll % linededup.SPREAD == 0 or k == len(lines) - 1:
            chunks.append(own)
            own = []
    return chunks


def plain_line_dedup(rows):
    seen = {}
    last = 1 << 63
    for i, t in rows:
        for n, c in enumerate(plain_chunks(t or "")):
            seen.setdefault("\n".join(c), []).append((last if i is None else i, t, n))
    out = []
    for i, t in rows:
        kept, gone, chunks = [], 0, plain_chunks(t or "")
        for n, c in enumerate(chunks):
            text = "\n".join(c)
            places = seen[text]
            if len(c) > 1 and re.search(r"[^\x20\x09-\x0D]", text) and min(p[0::2] for p in places) != (last if i is None else i, n):
                gone += len(c)
            else:
                kept.append(text)
        out.append((i, (t or "").count("\n") + 1, len(chunks), gone, sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bitmap", [1 << 20, 0])
def test_line_dedup_matches_brute_force(spark, bitmap):
    rows = corpus(3)
    want = plain_line_dedup(rows)
    assert rows_of(linededup.digest(frame(spark, rows), bitmap_bytes=bitmap)) == want and sum(r[3] for r in want) > 20


def test_line_dedup_keeps_columns_and_nulls(spark):
    rows = corpus(3)
    df = frame(spark, rows)
    out = linededup.apply(df)
    assert out.schema == df.schema
    assert sorted(repr((r.doc_id, sha(r.text or ""))) for r in out.collect()) == sorted(repr((r[0], r[4])) for r in plain_line_dedup(rows))
    assert out.where("text IS NULL").count() == 2


def plain_pair_dedup(rows):
    """plain_line_dedup, and every two lines in succession that occur before; white lines between them go with them."""
    seen, last = {}, 1 << 63
    chunk_places, units = {}, []
    for i, t in rows:
        lines, at = (t or "").split("\n"), 0
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        mine = [(n, a, b + 1, "\n".join(lines[a : b + 1])) for n, (a, b) in enumerate(zip(full, full[1:], strict=False))]
        for n, _, _, x in mine:
            seen.setdefault(x, []).append((last if i is None else i, t, n))
        chunks = []
        for n, c in enumerate(plain_chunks(t or "")):
            chunks.append((n, at, at + len(c), "\n".join(c)))
            chunk_places.setdefault("\n".join(c), []).append((last if i is None else i, n))
            at += len(c)
        units.append((i, t, lines, chunks, mine))
    out = []
    for i, t, lines, chunks, mine in units:
        own, gone = last if i is None else i, set()
        for n, a, b, x in chunks:
            if b - a > 1 and re.search(r"[^\x20\x09-\x0D]", x) and min(chunk_places[x]) != (own, n):
                gone |= set(range(a, b))
        for n, a, b, x in mine:
            d, u, m = min(seen[x], key=lambda p: (p[0], p[2]))
            if (d, m) != (own, n) and (d, u, m) != (own, t, n - 1):
                gone |= set(range(a, b))
        out.append((i, len(lines), len(chunks), len(gone), sha("\n".join(x for k, x in enumerate(lines) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bitmap", [1 << 20, 0])
def test_line_dedup_takes_runs_that_hold_no_whole_chunk(spark, bitmap):
    run = ["the first of two lines", "and the second one"]
    rows = corpus(3) + [(1000 + i, "\n".join([f"own {i}", *run, f"other {i}"])) for i in range(9)] + [(1100, "x x\nx x\nx x\nx x\nx x"), (1101, f"y\n{run[0]}\n \n\n{run[1]}\nz"), (1102, f"{run[0]}\n \n\n{run[1]}")]
    want = plain_pair_dedup(rows)
    got = rows_of(linededup.digest(frame(spark, rows), bitmap_bytes=bitmap, pairs=True))
    assert got == want
    removed = {r[0]: r[3] for r in got}
    assert [removed[1000 + i] for i in range(9)] == [0] + [2] * 8
    assert (removed[1100], removed[1101], removed[1102]) == (3, 0, 4)
    assert {r.doc_id: r.text for r in linededup.apply(frame(spark, rows), pairs=True).collect()}[1003] == "own 3\nother 3"


def test_chunks_survive_a_shift():
    import random

    r = random.Random(1)
    lines = [f"line {r.random()}" for _ in range(200)]
    a, b = plain_chunks("\n".join(lines)), plain_chunks("\n".join(["new", *lines]))
    assert len({tuple(x) for x in a} & {tuple(x) for x in b}) >= len(a) - 2


def test_line_dedup_takes_columns_of_its_own_names(spark):
    rows = corpus(3)
    df = frame(spark, rows).selectExpr("*", "1 AS _gone", "2 AS _gone_hash", "3 AS _gone_id", "'x' AS _gone_key", "4 AS removed")
    out = linededup.apply(df)
    assert out.schema == df.schema and {(r._gone, r._gone_hash, r._gone_id, r._gone_key, r.removed) for r in out.collect()} == {(1, 2, 3, "x", 4)}
    assert sorted(repr((r.doc_id, sha(r.text or ""))) for r in out.collect()) == sorted(repr((r[0], r[4])) for r in plain_line_dedup(rows))


def test_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert linededup.digest(df).count() == 0 and linededup.apply(df).count() == 0
