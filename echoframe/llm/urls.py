"""URL filters: weighted vocabulary over Aho-Corasick, beneath a table of host and path rules.

Strict and soft terms are compiled into one automaton per worker and streamed over
each lower-cased url. A hit counts only between boundaries: no ASCII letter or digit
beside it. One strict term blocks the url, and so do two or more distinct soft terms whose
weights together reach the limit (a term counts once, however often it stands there; one soft
term alone never blocks). Rules for hosts and paths go first; the longest rule wins.

Defined results
---------------
* A null url, or one without `://`, has an empty host and path, fits no rule, and is judged by its terms alone (null: allow).
* Rules of equal length cannot both fit unless they are equal; then the first in the table wins.
* A term that is both strict and soft is strict. An empty vocabulary, and empty terms, hit nothing.
* Urls of any length are judged whole, in time linear in their length. Repeated rows are judged alike. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import schema_of

#: One hit blocks.
STRICT_TERMS = ("porn", "xxx", "casino", "viagra", "cheap-pills", "spam-farm", "escort", "hentai", "camgirl", "malware", "phishing", "warez")
#: Weights of soft terms: 3 is rarely innocent, 2 often not, 1 only beside others.
SOFT_TERMS = {
    **dict.fromkeys(("adult", "nude", "sex", "free-money", "hookup", "jackpot"), 3),
    **dict.fromkeys(("betting", "crack", "dating", "keygen", "pills", "poker", "slots", "spam", "torrent"), 2),
    **dict.fromkeys(("bet", "bonus", "cheap", "farm", "free", "hack", "hot", "loan", "loans", "win"), 1),
}
#: Several distinct soft terms, at least SOFT_DISTINCT, block when their weights reach the limit.
SOFT_LIMIT = 4
SOFT_DISTINCT = 2
#: (rule, verdict), as the contract of the query gives them.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OUT = schema_of("page_id long, host string, path string, rule string, verdict string, strict_hits string[], soft_hits string[]")


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[tuple[str, int], ...] = tuple(SOFT_TERMS.items())
    limit: int = SOFT_LIMIT
    distinct: int = SOFT_DISTINCT

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in [*self.soft, *((t, None) for t in self.strict)]:
            if t:
                a.add_word(t.translate(_LOWER), (t, w))
        a.make_automaton()
        return a

    def blocks(self, strict: list[str], soft: dict[str, int]) -> bool:
        return bool(strict) or (len(soft) >= self.distinct and sum(soft.values()) >= self.limit)


def split(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = min((i for c in "?#" if (i := rest.find(c, host)) >= 0), default=len(rest))
    return rest[:host].translate(_LOWER), rest[host:path]


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict. rules: by host, (path, rule, verdict)."""
    best = None
    while host:
        for prefix, rule, verdict in rules.get(host, ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        _, _, host = host.partition(".")
    return best


def hits(url: str, automaton) -> tuple[list[str], dict[str, int]]:
    """Distinct strict terms, and distinct soft terms with weights, that stand between boundaries."""
    low = url.translate(_LOWER)
    strict, soft = {}, {}
    if not len(automaton):
        return [], {}
    for end, (term, weight) in automaton.iter(low):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
            (strict if weight is None else soft)[term] = weight
    return sorted(strict), soft


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per row of df: host, path, rule, verdict, and the terms found."""
    vocabulary = vocabulary or Vocabulary()
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary.automaton()
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split(u)
                found = rule_of(host, path, by_host)
                strict, soft = hits(u or "", automaton)
                verdict = found[1] if found else "block" if vocabulary.blocks(strict, soft) else "allow"
                rows.append((host, path, found[0] if found else None, verdict, strict, sorted(soft)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.field("element", pa.string(), False))) for c in cols[4:])], names=OUT.names)

    return df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(run, OUT)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
