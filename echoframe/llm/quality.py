"""Quality rules: tokeniser fertility per language, over plain base rules.

Two public vocabularies measure each text. The pieces give characters per token and the share of
tokens that are fallback bytes; a byte-level vocabulary of many languages gives characters
per token, too, and the entropy of the token distribution in bits. Entropy grows with
length, so its band lies about a curve in log2 of the number of tokens. Each language, or
else each script, has rejection bands; a text is kept if every measure lies inside its
band. Bands are parameters, fitted once by `fit_bands` on labelled rows, so a text's verdict
never depends on other rows of the table, and one pass without a shuffle suffices.

Defined results
---------------
* Words are runs of bytes other than space and \\x09-\\x0D; a null text has none and fails the base rules.
* Texts that fail the base rules are rejected; the others are kept if inside the bands.
* A null or unlisted language takes the bands of the text's script.
* Repeated rows are judged alike; other columns pass through `reject()` unchanged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, tokenshards
from . import textkernel as K
from .frames import schema_of

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SYMBOLS = K.table(*(ord(c) for c in "#*$%&|<>"))


@dataclass
class Fertility:
    """Of each row; NaN without tokens."""

    tokens: np.ndarray
    chars_per_token: np.ndarray
    byte_share: np.ndarray
    byte_tokens: np.ndarray
    chars_per_byte_token: np.ndarray
    entropy: np.ndarray


@dataclass(frozen=True)
class Band:
    """Inclusive bounds. curve: entropy that is usual for x = log2(byte-level tokens), as a + b x + c x^2 with x held inside span; entropy: bounds of the difference from it."""

    chars_per_token: tuple[float, float]
    byte_share: float
    chars_per_byte_token: tuple[float, float] = (0.0, 100.0)
    curve: tuple[float, float, float] | None = None
    entropy: tuple[float, float] = (-0.4, 1.5)
    span: tuple[float, float] = (0.0, 40.0)

    def difference(self, m: Fertility) -> np.ndarray:
        x = np.clip(np.log2(np.maximum(m.byte_tokens, 1)), *self.span)
        return m.entropy - (self.curve[0] + self.curve[1] * x + self.curve[2] * x * x)

    def holds(self, m: Fertility) -> np.ndarray:
        inside = lambda x, b: (x >= b[0]) & (x <= b[1])
        ok = inside(m.chars_per_token, self.chars_per_token) & inside(m.chars_per_byte_token, self.chars_per_byte_token) & (m.byte_share <= self.byte_share)
        return ok if self.curve is None else ok & inside(self.difference(m), self.entropy)


#: Fitted by fit_bands on the rows labelled quality 1, with an even doc_id, of the test tables (sf0.1), and widened: lower bounds by 5 % and 0.15 bits, upper ones far more, as junk lies below.
#: By language code, or by script for languages that are not listed; nothing was labelled in other scripts, so their band is only wide.
DEFAULT_BANDS: dict[str, Band] = {
    "en": Band((2.07, 6.0), 0.05, (2.25, 6.0), (1.188, 0.9448, -0.03789), (-0.49, 2.0), (6.7, 13.4)),
    "de": Band((2.21, 6.0), 0.05, (2.39, 6.0), (1.962, 0.7885, -0.03145), (-0.36, 2.0), (6.9, 13.5)),
    "es": Band((2.05, 6.0), 0.05, (2.18, 6.0), (1.315, 0.9138, -0.03796), (-0.43, 2.0), (7.0, 12.8)),
    "fr": Band((1.90, 6.0), 0.05, (2.01, 6.0), (2.263, 0.7274, -0.02909), (-0.38, 2.0), (6.9, 13.6)),
    "latin": Band((1.90, 6.0), 0.05, (2.01, 6.0), (1.494, 0.8832, -0.03553), (-0.53, 2.0), (6.7, 13.6)),
    "other": Band((0.3, 8.0), 0.8),
}


@dataclass(frozen=True)
class Rules:
    """Production parameters. max_repeat: hundredths of words."""

    min_words: int = 50
    max_repeat: int = 50
    bands: dict[str, Band] = field(default_factory=lambda: dict(DEFAULT_BANDS))


@dataclass
class Measures:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def base_measures(block: K.Block) -> Measures:
    buf, bounds = block.buf, block.bounds
    starts, ends, words = block.segments(K.NOT_SPACE)
    inside = K.NOT_SPACE[buf]
    codes = K._BYTE_CODE[buf]
    rows = K.rows_of(words)
    # three-word windows found twice or more in their row
    at, h = K.windows(K.span_hash(codes, starts, ends), words, 3)
    repeated = np.zeros(len(starts), bool)
    if len(at):
        key = K.mix(h ^ K.mix(rows[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = K.cover(len(starts), at[twice], at[twice] + 3)
    # lines with a word that an earlier line of the row equals
    ls, le, lb = block.lines()
    has_word = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=has_word[1:])
    full = np.flatnonzero(has_word[le] > has_word[ls])
    line_row = K.rows_of(lb)[full]
    key = K.mix(K.span_hash(codes, ls[full], le[full]) ^ K.mix(line_row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(full), bool)
    again[first] = False
    return Measures(np.diff(words), block.count(inside & K.LEADS[buf]), block.count(SYMBOLS[buf]), np.bincount(line_row[again], minlength=block.n), K.per_row(repeated, words))


def token_measures(block: K.Block, enc: Encoders) -> Fertility:
    chars = block.count(K.LEADS[block.buf])
    ids, bounds = enc.pieces.encode(block)
    n = np.diff(bounds)
    is_byte = np.zeros(len(enc.pieces.t.scores), bool)
    is_byte[enc.pieces.t.byte_ids] = True
    is_byte[enc.pieces.t.byte_ids[10]] = False  # a line end is no fallback
    in_bytes = K.per_row(is_byte[ids], bounds)
    ids, bounds = enc.bytes.encode(block)
    m = np.diff(bounds)
    key = np.sort((K.rows_of(bounds).astype(np.int64) << 32) | ids)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    sums = np.bincount(key[head] >> 32, weights=count * np.log2(count), minlength=block.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return Fertility(n, chars / n, in_bytes / n, m, chars / m, np.log2(m) - sums / m)


@dataclass(frozen=True)
class Encoders:
    pieces: pieces.Encoder
    bytes: tokenshards.BpeEncoder


def shared_vocabularies(spark: SparkSession, model: str | None, ranks: str | None):
    """Broadcasts of both vocabularies; encoders_of() makes this worker's encoders of them."""
    return pieces.shared_table(spark, model), tokenshards.shared_ranks(spark, ranks or os.path.join(pieces.TOKENIZER_DIR, BYTE_VOCABULARY))


def encoders_of(shared) -> Encoders:
    return Encoders(pieces.encoder_of(shared[0]), tokenshards.encoder_of(shared[1]))


def scripts(block: K.Block) -> np.ndarray:
    """True where most code points are of one or two bytes below U+0250: the Latin script."""
    lead = K.LEADS[block.buf]
    return 2 * block.count(lead & (block.buf < 0xC9)) >= block.count(lead)


OUT = schema_of("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, n_byte_tokens long, chars_per_byte_token double, token_entropy double")


def band_names(block: K.Block, lang: pa.Array | None, rules: Rules) -> np.ndarray:
    """The band that each row takes: its language's, or else its script's."""
    names = lang.slice(block.first, block.n).to_pylist() if lang is not None else [None] * block.n
    return np.array([x if x in rules.bands else "latin" if a else "other" for x, a in zip(names, scripts(block).tolist(), strict=True)], object)


def judge(text: pa.Array, lang: pa.Array | None, enc: Encoders, rules: Rules) -> Iterator[tuple[K.Block, Measures, np.ndarray, np.ndarray, Fertility]]:
    """For each block of rows: measures, base failures, verdicts, token measures."""
    for block in K.blocks(text, pieces.TEXT_BYTES):
        # tokens are counted over larger blocks than words are hashed in
        m = Measures(*map(np.concatenate, zip(*((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in map(base_measures, K.blocks(text.slice(block.first, block.n)))), strict=True)))
        failed = (m.n_words < rules.min_words) | (100 * m.n_repeat_words > rules.max_repeat * m.n_words)
        t = token_measures(block, enc)
        which = band_names(block, lang, rules)
        inside = np.zeros(block.n, bool)
        for name, b in rules.bands.items():
            inside |= (which == name) & b.holds(t)
        yield block, m, failed, inside & ~failed, t


def measure(df: DataFrame, rules: Rules | None = None, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", model: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per row of df: all measures and the verdict."""
    shared, rules = shared_vocabularies(df.sparkSession, model, ranks), rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders_of(shared)
        for b in batches:
            for block, m, failed, kept, t in judge(b.column(1), b.column(2), enc, rules):
                nan = lambda x: pa.array(x, from_pandas=True)
                whole = lambda x: pa.array(x.astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(block.first, block.n), *(whole(x) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)), pa.array(failed), pa.array(kept),
                    whole(t.tokens), nan(t.chars_per_token), nan(t.byte_share), whole(t.byte_tokens), nan(t.chars_per_byte_token), nan(t.entropy),
                ], names=OUT.names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang")).mapInArrow(run, OUT)


def reject(df: DataFrame, rules: Rules | None = None, text: str = "text", lang: str | None = "lang", model: str | None = None, ranks: str | None = None) -> DataFrame:
    """The rows of df that are kept, with all their columns."""
    shared, rules = shared_vocabularies(df.sparkSession, model, ranks), rules or Rules()
    lang = lang if lang in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders_of(shared)
        for b in batches:
            at = b.schema.get_field_index
            for block, _, _, kept, _ in judge(b.column(at(text)), b.column(at(lang)) if lang else None, enc, rules):
                yield b.slice(block.first, block.n).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


#: Labelled rows that fit_bands reads at most: those of the least doc_ids.
FIT_ROWS = 20_000


def fit_bands(df: DataFrame, good: str, lang: str = "lang", slack: float = 0.02, bits: float = 0.1, rows: int = FIT_ROWS) -> dict[str, Band]:
    """Bands around the rows where column `good` is 1 and the base rules hold: extremes of the measures, widened by the share `slack` and, for entropy, by `bits`.

    One band for each language, and "latin" for all rows of that script together. A bounded
    number of labelled rows is read, as for any fitted model.
    """
    some = df.where(F.col(good) == 1).select("doc_id", "text", lang).orderBy("doc_id").limit(rows)
    t = some.toArrow()
    enc = encoders_of(shared_vocabularies(df.sparkSession, None, None))
    out, seen = {}, {}
    only = Rules(bands={})
    for block, _, failed, _, m in judge(t["text"].combine_chunks(), None, enc, only):
        named = t[lang].combine_chunks().slice(block.first, block.n).to_pylist()
        latin = scripts(block)
        for k in np.flatnonzero(~failed).tolist():
            row = [m.chars_per_token[k], m.byte_share[k], m.byte_tokens[k], m.chars_per_byte_token[k], m.entropy[k]]
            for name in {named[k], "latin" if latin[k] else None} - {None}:
                seen.setdefault(name, []).append(row)
    for name, got in sorted(seen.items()):
        cpt, share, n, bpt, entropy = np.array(got).T
        x = np.log2(n)
        a = np.stack([np.ones_like(x), x, x * x], 1)
        w = np.linalg.lstsq(a, entropy, rcond=None)[0]
        off = entropy - a @ w
        wide = lambda v: (float(v.min()) * (1 - slack), float(v.max()) * (1 + slack))
        out[name] = Band(wide(cpt), float(share.max()) + slack, wide(bpt), tuple(map(float, w)), (float(off.min()) - bits, float(off.max()) + bits), (float(x.min()), float(x.max())))
    return out


def op9_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
