"""Hooks for models and embedders, and seeded augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def predictions(df: DataFrame, predict: Callable[[list[str]], list[dict[str, Any]]], fields: T.StructType, text: str = "text") -> DataFrame:
    """Add ``prediction`` (struct of ``fields``) and ``failure``: rows that the model fails on get null and the reason.

    Texts go to the model in batches; the texts of a batch that fails are asked one by one,
    so one bad text spoils no other.
    """
    def asked(texts: list[str]) -> tuple[list, str | None]:
        try:
            got = predict(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} results for {len(texts)} texts")
            return got, None
        except Exception as e:  # the model is foreign code: its failure is a result
            return [None] * len(texts), f"{type(e).__name__}: {e}"

    schema = T.StructType([*df.schema.fields, T.StructField("prediction", fields), T.StructField("failure", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].fillna("").tolist()
            got, why = asked(texts)
            if why is not None:
                each = [asked([t]) for t in texts]
                got, why = [g[0] for g, _ in each], [w for _, w in each]
            yield f.assign(prediction=got, failure=why)

    return df.mapInPandas(run, schema)


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function of a batch embedder."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return of


def thinned(text: Column, key: Column, seed: int, per_mille: int = 100) -> Column:
    """Leave out words by a hash of (seed, key, position); any engine repeats it."""
    words = F.split(text, " ")
    draw = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, i), 256), 1, 6), 16, 10).cast("int") % 1000
    return F.array_join(F.filter(words, lambda w, i: draw(i) >= per_mille), " ")
