"""A byte-level BPE tokenizer read from a tokenizer.json, and its use on columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Ids around a text, the id of unknown tokens where the vocabulary has none, and the greatest length.
START_ID, END_ID, UNKNOWN_ID, MAX_LENGTH = 0, 2, 3, 512
#: A contraction; else white space before the end, or all but the last of several; else letters, digits or other characters after one white-space character at most.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[ \t\n\v\f\r]+\Z|[ \t\n\v\f\r]+(?=[ \t\n\v\f\r][^ \t\n\v\f\r])|[ \t\n\v\f\r]?(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\v\f\r]+)")
_BAD_ESCAPE = re.compile(r'\\(?:(["\\/bfnrtu])|(.))', re.S)


def parse_json(text: str):
    """The first JSON value of text; what follows it is ignored, and an unknown escape stands for its character."""
    mended = _BAD_ESCAPE.sub(lambda m: m[0] if m[1] else m[2], text.lstrip())
    return json.JSONDecoder(strict=False).raw_decode(mended)[0]


def byte_symbols() -> dict[int, str]:
    """A visible character for each byte: itself where it has one, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = byte_symbols()


def pre_tokenize(text: str) -> list[str]:
    return _PIECE.findall(text)


def to_symbols(word: str) -> list[str]:
    return [_SYMBOLS[b] for b in word.encode()]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the neighbouring pair of least rank, wherever it stands, until no pair has a rank."""
    while len(symbols) > 1:
        pair = min(zip(symbols, symbols[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if pair not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            both = tuple(symbols[i : i + 2]) == pair
            out.append(symbols[i] + symbols[i + 1] if both else symbols[i])
            i += 1 + both
        symbols = out
    return symbols


class Tokenizer:
    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in merges)
        self.ranks = {p: i for i, p in enumerate(p for p in pairs if len(p) == 2)}
        self.unknown = vocab.get("<unk>", UNKNOWN_ID)
        self._word = lru_cache(100_000)(lambda w: [self.vocab.get(s, self.unknown) for s in merge(to_symbols(w), self.ranks)])

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            model = parse_json(f.read()).get("model") or {}
        if not isinstance(model.get("vocab"), dict) or not isinstance(model.get("merges"), list):
            raise ValueError(f"{path} has no model.vocab and model.merges")
        return cls(model["vocab"], model["merges"])

    def encode(self, text: str, max_length: int = MAX_LENGTH) -> list[int]:
        body = [i for w in pre_tokenize(text) for i in self._word(w)]
        return [START_ID, *body[: max_length - 2], END_ID]

    def __getstate__(self):
        return {"vocab": self.vocab, "merges": [list(p) for p in self.ranks]}

    def __setstate__(self, state):
        self.__init__(state["vocab"], state["merges"])


def encode_column(df: DataFrame, tokenizer: Tokenizer, text: str = "body", out: str = "ids", max_length: int = MAX_LENGTH) -> DataFrame:
    """df with the ids of `text`; a broadcast holds the vocabulary, and each worker remembers words."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [shared.value.encode(t or "", max_length) for t in pdf[text]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.mapInPandas(run, f"{schema}, `{out}` array<bigint>")
