"""Texts to vectors by a model of the caller's: a function from a list of texts to a matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagix.functions.text import encoder_text


def encode(docs: DataFrame, model: Callable[[list[str]], np.ndarray], name: str, dim: int, query: bool = False, batch: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(vec_id, embedding) of unit length, as floats, by Arrow batches. A zero vector stays zero. A matrix of another shape raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                x = np.asarray(model(part["text"].tolist()), np.float32)
                if x.shape != (len(part), dim):
                    raise RuntimeError(f"the model gave {x.shape} for {len(part)} texts of dimension {dim}")
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"vec_id": part["vec_id"], "embedding": list(x / np.where(norm > 0, norm, 1))})

    rows = docs.select(F.col(doc_id).alias("vec_id"), encoder_text(F.coalesce(F.col(text), F.lit("")), name, query).alias("text"))
    return rows.mapInPandas(run, "vec_id long, embedding array<float>")
