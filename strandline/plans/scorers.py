"""External scorers as plug-ins (Q12, Q15, Q19, A26): a model is a function from pandas frames to frames of class scores, loaded once a task.

The engine trains and ships no model; a scorer's package must be on the executors. Scores come back with the row's key columns, and
several models' scores are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = ("donor_prob", "acceptor_prob", "neither_prob")
SCORERS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def scorer(name: str):
    """Register a loader: called once a task, it gives the function that scores a batch."""

    def keep(load):
        if name in SCORERS:
            raise ValueError(f"{name} is there already")
        SCORERS[name] = load
        return load

    return keep


@scorer("motif")
def motif_scorer():
    """A deterministic stand-in: GT after a base speaks for a donor, AG before it for an acceptor. Needs `before` and `after` (two bases each)."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        donor = batch["after"].str.upper().eq("GT") * 0.8 + 0.1
        acceptor = batch["before"].str.upper().eq("AG") * 0.8 + 0.1
        total = donor + acceptor + 0.3
        return pd.DataFrame({"donor_prob": donor / total, "acceptor_prob": acceptor / total, "neither_prob": 0.3 / total})

    return score


def predict(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """keys and the three class scores of each row, in Arrow batches."""
    load = SCORERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            yield pd.concat([batch[keys].reset_index(drop=True), score(batch)[list(CHANNELS)].astype(float).reset_index(drop=True)], axis=1)

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} double" for c in CHANNELS)]))


def predict_mean(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The mean over models."""
    every = reduce(DataFrame.unionByName, (predict(df, n, keys) for n in names))
    return every.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in CHANNELS))


def high_confidence(df: DataFrame, threshold: float = 0.9, kind: str = "either") -> DataFrame:
    """Rows whose donor, acceptor or either score reaches the threshold."""
    d, a = F.col("donor_prob") >= threshold, F.col("acceptor_prob") >= threshold
    return df.where({"donor": d, "acceptor": a, "either": d | a}[kind])


def errors(classified: DataFrame, kind: str = "pred_type") -> DataFrame:
    """False positives and negatives."""
    return classified.where(F.col(kind).isin("FP", "FN"))
