"""Vectors for units: a column that is there already, or an ONNX model on token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.functions.bpe import Tokenizer, encode_column


def precomputed(df: DataFrame, idx: str, vector: str) -> DataFrame:
    """(idx, vector) from a column of vectors."""
    return df.select(F.col(idx).cast("long").alias("idx"), F.col(vector).alias("vector"))


def run_model(session, ids: list[list[int]]) -> np.ndarray:
    """The `pooler_output` of a batch; shorter rows are padded, and masked."""
    width = max(map(len, ids), default=1)
    tokens, mask = np.ones((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
    for row, x in enumerate(ids):
        tokens[row, : len(x)], mask[row, : len(x)] = x, 1
    return session.run(["pooler_output"], {"input_ids": tokens, "attention_mask": mask})[0]


def embed(units: DataFrame, model: str, tokenizer: Tokenizer, batch: int = 32) -> DataFrame:
    """(idx, vector) by an ONNX model, which every worker opens once; the file lies at the same path on all machines."""
    rows = encode_column(units.select("idx", "body"), tokenizer).select("idx", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model)
        for pdf in batches:
            order = pdf.ids.map(len).sort_values().index  # equal lengths together
            for at in range(0, len(order), batch):
                part = pdf.loc[order[at : at + batch]]
                yield pd.DataFrame({"idx": part.idx, "vector": list(run_model(session, [list(x) for x in part.ids]).astype(np.float32))})

    return rows.mapInPandas(run, "idx long, vector array<float>")
