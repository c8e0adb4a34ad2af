"""Writers. All of them stream every pair in order, a partition at a time; the bulk form is a table (`write_pairs`).

With `most`, the reports list the first pairs only, and say how many they leave out.
"""

from __future__ import annotations

import datetime
import html
import json
import math
from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.functions.health import grade_color
from echoframe.functions.text import basename, first_lines, similarity_color
from echoframe.plans.scan import ScanResult, in_order, with_suggestion

ANSI = {"red": "\033[31m", "yellow": "\033[33m", "green": "\033[32m", "": "\033[0m"}


def now() -> str:
    return datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def tenths(x: float) -> float:
    """To one place, halves away from zero as SQL's round does it; format() and round() take halves to even."""
    y = abs(x) * 10
    whole = math.floor(y)
    return math.copysign((whole + (y - whole >= 0.5)) / 10, x)


def write_pairs(r: ScanResult, to: str, fmt: str = "parquet") -> None:
    """All pairs with rank and suggestion, in order, as a table; semantic ones in another, whose name ends in -semantic."""
    with_suggestion(in_order(r.pairs)).write.format(fmt).mode("overwrite").save(to)
    if r.semantic is not None:
        with_suggestion(r.semantic, True).orderBy("idx1", "idx2").write.format(fmt).mode("overwrite").save(f"{to.rstrip('/')}-semantic")


def _rows(pairs: DataFrame, semantic: bool, most: int | None) -> Iterator:
    order = ["idx1", "idx2"] if semantic else [F.desc("similarity"), "idx1", "idx2"]
    rows = with_suggestion(pairs, semantic).withColumn("color", similarity_color(F.col("similarity"))).orderBy(*order)
    return rows.toLocalIterator() if most is None else iter(rows.limit(most).collect())


def _left_out(n: int, most: int | None) -> int:
    return 0 if most is None else max(0, n - most)


def write_text(r: ScanResult, root: str, out: IO[str], color: bool = False, most: int | None = None) -> None:
    s = r.summary.first()
    paint = lambda text, c: f"{ANSI[c]}{text}{ANSI['']}" if color else text
    tone = "green" if s.grade in "AB" else "yellow" if s.grade == "C" else "red"
    out.write(f"Duplicates in {root}\n{now()}\n\nSUMMARY\n  functions         {s.n_units}\n  duplicate pairs   {s.n_pairs}\n  duplication rate  {tenths(s.rate_pairs):.1f} %\n")
    if r.semantic is not None:
        out.write(f"  semantic pairs    {s.n_semantic}\n")
    out.write("  health            " + paint(f"{tenths(s.score):.1f} ({s.grade})", tone) + "\n\nDUPLICATE PAIRS\n")
    for n, p in enumerate(_rows(r.pairs, False, most), 1):
        out.write(f"  #{n}  " + paint(f"{tenths(p.similarity):.1f} %", p.color) + f"\n    {p.name1}  {p.file1}\n    {p.name2}  {p.file2}\n    {p.suggestion}\n")
    if left := _left_out(s.n_pairs, most):
        out.write(f"  {left} more pairs are not listed\n")
    if r.semantic is not None:
        out.write("\nSEMANTIC\n")
        for n, p in enumerate(_rows(r.semantic, True, most), 1):
            out.write(f"  #{n}  {tenths(p.similarity):.1f} %  z {tenths(p.zscore):.1f}\n    {p.name1}  {p.file1}\n    {p.name2}  {p.file2}\n    {p.suggestion}\n")


def write_json(r: ScanResult, root: str, out: IO[str], most: int | None = None) -> None:
    s = r.summary.first()

    def entry(p, semantic: bool) -> dict:
        return {"similarity": tenths(p.similarity)} | ({"zscore": round(p.zscore, 2)} if semantic else {}) | {"function1": p.name1, "file1": p.file1, "function2": p.name2, "file2": p.file2, "suggestion": p.suggestion}

    doc = {"scannedPath": root, "generated": now(), "totalFunctions": s.n_units, "duplicatesFound": s.n_pairs, "duplicationRate": tenths(s.rate_pairs), "healthScore": tenths(s.score), "healthGrade": s.grade}
    if r.semantic is not None:
        doc |= {"semanticEnabled": True, "semanticDuplicatesFound": s.n_semantic}
    if _left_out(max(s.n_pairs, s.n_semantic), most):
        doc |= {"truncated": True, "listed": most}
    out.write(json.dumps(doc, indent=2, ensure_ascii=False)[:-2])
    for key, pairs, semantic in (("duplicates", r.pairs, False), ("semanticDuplicates", r.semantic, True)):
        if pairs is not None:
            out.write(f',\n  "{key}": [')
            for n, p in enumerate(_rows(pairs, semantic, most)):
                out.write((",\n    " if n else "\n    ") + json.dumps(entry(p, semantic), ensure_ascii=False))
            out.write("\n  ]")
    out.write("\n}\n")


_PAGE = """<!doctype html>
<meta charset="utf-8"><title>Duplicates</title>
<style>body{{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}}td,th{{padding:.2em .6em;text-align:left;vertical-align:top}}
pre{{background:#f4f4f4;padding:.6em;overflow:auto}}.pair{{display:grid;grid-template-columns:1fr 1fr;gap:1em}}
.green{{color:#176b2c}}.yellow{{color:#8a6100}}.red{{color:#a3171b}}</style>
<h1>Duplicates in {root}</h1><p>{when}</p>
<p>Health <b class="{tone}">{score:.1f} ({grade})</b>; {units} functions; {exact} exact and {near} near pairs{semantic}; {rate:.1f} % of functions are in a pair.</p>
{top}{closest}
<h2>Pairs</h2>{note}<p><input id="q" placeholder="function name"> <button id="prev">&lt;</button> <span id="at"></span> <button id="next">&gt;</button></p>
<table id="pairs"><tr><th>#<th>similarity<th>functions<th>suggestion</tr>{rows}</table>
<script>
const all=[...document.querySelectorAll('#pairs tr.p')],size=25;let page=0;
function show(){{const q=document.getElementById('q').value.toLowerCase(),hit=all.filter(r=>r.dataset.n.includes(q)),last=Math.max(0,Math.ceil(hit.length/size)-1);
page=Math.min(Math.max(page,0),last);all.forEach(r=>r.hidden=true);hit.slice(page*size,page*size+size).forEach(r=>r.hidden=false);
document.getElementById('at').textContent=(page+1)+' / '+(last+1)}}
document.getElementById('q').oninput=()=>{{page=0;show()}};document.getElementById('prev').onclick=()=>{{page--;show()}};document.getElementById('next').onclick=()=>{{page++;show()}};show();
</script>
"""


def closest_bodies(r: ScanResult) -> DataFrame:
    """The first lines of both bodies of the most similar pair."""
    top = r.pairs.orderBy(F.desc("similarity"), "idx1", "idx2").limit(1)
    body = lambda n: r.units.select(F.col("idx").alias(f"idx{n}"), first_lines(F.col("body")).alias(f"lines{n}"))
    return top.join(body(1), "idx1").join(body(2), "idx2")


def write_html(r: ScanResult, root: str, out: IO[str], most: int | None = None) -> None:
    s = r.summary.withColumn("tone", grade_color(F.col("score_members"))).first()
    esc = html.escape
    top, closest = "", ""

    def row(n: int, p) -> str:
        return f'<tr class="p" data-n="{esc((p.name1 + " " + p.name2).lower())}"><td>{n}<td class="{p.color}">{tenths(p.similarity):.1f} %<td>{esc(p.name1)} <small>{esc(p.file1)}</small><br>{esc(p.name2)} <small>{esc(p.file2)}</small><td>{esc(p.suggestion)}</tr>\n'

    if r.semantic is not None:
        first = r.semantic.withColumns({"base1": basename(F.col("file1")), "base2": basename(F.col("file2"))}).orderBy(F.desc("zscore"), "idx1", "idx2").limit(5).collect()
        if first:
            top = "<h2>Most unusual pairs</h2><ol>" + "".join(f"<li>z {tenths(p.zscore):.1f}: {esc(p.name1)} <small>{esc(p.base1)}</small>, {esc(p.name2)} <small>{esc(p.base2)}</small></li>" for p in first) + "</ol>"
    for p in closest_bodies(r).collect():
        closest = f'<h2>Closest pair</h2><div class="pair"><pre>{esc(chr(10).join(p.lines1))}</pre><pre>{esc(chr(10).join(p.lines2))}</pre></div>'
    left = _left_out(s.n_pairs, most)
    note = f"<p>{left} more pairs are not listed.</p>" if left else ""
    head, tail = _PAGE.split("{rows}")
    out.write(head.format(root=esc(root), when=now(), tone=s.tone, score=tenths(s.score_members), grade=s.grade_plus, units=s.n_units, exact=s.n_exact, near=s.n_near, semantic=f" and {s.n_semantic} semantic pairs" if r.semantic is not None else "", rate=tenths(s.rate_members), top=top, closest=closest, note=note))
    for n, p in enumerate(_rows(r.pairs, False, most), 1):
        out.write(row(n, p))
    out.write(tail.format())
