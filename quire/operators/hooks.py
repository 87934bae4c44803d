"""Places where a user's own model or step comes in, with plain defaults."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def route(rows: DataFrame, handlers: dict[str, Step]) -> DataFrame:
    """Each handler gets the rows of its step and returns document_id, step, outcome, next_step."""
    found = None
    for step, handler in handlers.items():
        part = handler(rows.filter(F.col("step") == step)).select("document_id", "step", "outcome", "next_step")
        found = part if found is None else found.unionByName(part)
    return found


def embedder(dim: int = 64, batch: int = 32, model: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[Column], Column]:
    """A function of a text column to vectors. The model gets texts in batches, in order; the default needs none: each word adds or
    takes one at a place that its hash gives, so texts with words in common are alike. Vectors are of length 1; a text whose
    words are none, or cancel out, is the first unit vector."""

    def default(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            hashes = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], np.int64)
            np.add.at(out[row], hashes // 2 % dim, np.where(hashes % 2, 1.0, -1.0))
        out[~out.any(1), 0] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use = model or default
        for texts in parts:
            values: list = []
            for at in range(0, len(texts), batch):
                got = use(["" if t is None else t for t in texts.iloc[at : at + batch]])
                if any(len(v) != dim for v in got):
                    raise ValueError(f"the model gave vectors of another size than {dim}")
                values += got
            yield pd.Series(values, index=texts.index)

    return embed


def extract_fields(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """pages: document_id, tag_id, page, text; patterns: tag_id, key, pattern (one group).
    The first match in page order gives the value, and the whole match the evidence."""
    met = pages.join(patterns, "tag_id")
    whole = met.withColumns({"value": F.expr("regexp_extract(text, pattern, 1)"), "evidence": F.expr("regexp_extract(text, pattern, 0)")}).filter("evidence <> ''")
    return whole.groupBy("document_id", "key").agg(F.min_by(F.struct("value", "evidence", "page"), "page").alias("f")).select("document_id", "key", "f.*")
