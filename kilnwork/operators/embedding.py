"""Vectors from an injected embedder, in Arrow batches. Blank texts and failures give null."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gets texts, gives a vector for each.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embedded(text: Column, embedder: Embedder) -> Column:
    """A vector for each text; a batch on which the embedder fails is tried text by text, so that one bad text costs no other its vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            where = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            try:
                for i, v in zip(where, embedder([texts.iloc[i] for i in where])):
                    out[i] = [float(x) for x in v]
            except Exception:  # noqa: BLE001  whatever the injected embedder raises
                for i in where:
                    try:
                        out[i] = [float(x) for x in embedder([texts.iloc[i]])[0]]
                    except Exception:  # noqa: BLE001
                        out[i] = None
            yield pd.Series(out, dtype=object)

    return run(text)


def with_embeddings(cases: DataFrame, embedder: Embedder, text: str = "retrieval_text") -> DataFrame:
    """Adds ``embedding`` and ``embedding_warning`` for texts that weren't embedded although they aren't blank."""
    out = cases.drop("embedding").withColumn("embedding", embedded(F.col(text), embedder))
    return out.withColumn("embedding_warning", F.when(F.col("embedding").isNull() & (F.trim(F.coalesce(text, F.lit(""))) != ""), F.lit("not embedded")))
