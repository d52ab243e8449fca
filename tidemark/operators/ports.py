"""Model-backed steps (recognition, speech, captions, embeddings, text generation) as functions the caller supplies.

A step maps batches of rows to batches of rows; without one, its columns are null and the deterministic paths
of the other operators take over.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def applied(rows: DataFrame, inputs: list[str], output: str, kind: str, model: Callable[[pd.DataFrame], pd.Series] | None) -> DataFrame:
    """Adds ``output`` of type ``kind``: the model's value for each row of the input columns, or null without a model.

    The model is called once an Arrow batch, in the tasks; rows it fails on are its own to handle.
    """
    if model is None:
        return rows.withColumn(output, F.lit(None).cast(kind))

    @F.pandas_udf(kind)
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(batch), index=batch.index)

    return rows.withColumn(output, call(F.struct(*inputs)))


def rotated(models: list[Callable[[pd.DataFrame], pd.Series]], attempts: int = 2, pause: float = 0.0, otherwise: Callable[[pd.DataFrame], pd.Series] | None = None) -> Callable[[pd.DataFrame], pd.Series]:
    """One model of several: each is tried in order, all of them ``attempts`` times with a pause between rounds. Where all fail,
    ``otherwise`` answers, or else the last failure is raised."""

    def call(batch: pd.DataFrame) -> pd.Series:
        failure: Exception | None = None
        for round_ in range(attempts):
            if round_ and pause:
                time.sleep(pause)
            for model in models:
                try:
                    return model(batch)
                except Exception as e:  # noqa: BLE001 - whatever a service raises
                    failure = e
        if otherwise is None:
            raise failure or ValueError("no model")
        return otherwise(batch)

    return call


def expanded(rows: DataFrame, schema: StructType | str, model: Callable[[pd.DataFrame], pd.DataFrame] | None) -> DataFrame:
    """The rows a model makes of each batch: speech segments, video frames, triples. Without a model, none."""
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(call, schema)
