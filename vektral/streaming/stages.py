"""Preprocessing stages fitted on one split and applied to all, and count-based windows of streams."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import apply_scaler, fit_scaler


class Stage(ABC):
    """Fitted on a dataset, then applied to any."""

    @abstractmethod
    def fit(self, ds: DataFrame) -> Stage: ...

    @abstractmethod
    def transform(self, ds: DataFrame) -> DataFrame: ...


class Scaler(Stage):
    """zscore (population) or minmax."""

    def __init__(self, kind: str = "zscore"):
        self.kind = kind

    def fit(self, ds: DataFrame) -> Scaler:
        row = fit_scaler(ds, self.kind).collect()
        self.model = ds.sparkSession.createDataFrame(row, "a array<double>, b array<double>")
        return self

    def transform(self, ds: DataFrame) -> DataFrame:
        return apply_scaler(ds, self.model)


class Pipeline:
    """Stages one after the other; each is fitted on the training rows as the ones before leave them."""

    def __init__(self, *stages: Stage):
        self.stages = stages

    def fit(self, ds: DataFrame, split: str = "TR") -> Pipeline:
        rows = ds.filter(F.col("split") == split)
        for stage in self.stages:
            rows = stage.fit(rows).transform(rows)
        return self

    def transform(self, ds: DataFrame) -> DataFrame:
        for stage in self.stages:
            ds = stage.transform(ds)
        return ds


def stream_windows(events: DataFrame, key: str, value: str, size: int, step: int, order: str = "event_id") -> DataFrame:
    """Count-based moving windows of a stream: per key the windows of the last `size` rows, every
    `step` rows.  State holds at most size rows a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, start, skip = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 1, 0)
        out = []
        # a key's rows of one micro-batch, in order whatever the parts they come in
        for v in pd.concat(list(batches)).sort_values(order)[value]:
            if skip:
                skip -= 1
                continue
            kept.append(float(v))
            if len(kept) == size:
                out.append((k[0], start, start + size - 1, sum(kept)))
                kept, start, skip = kept[step:], start + step, max(0, step - size)
        state.update((kept, start, skip))
        yield pd.DataFrame(out, columns=[key, "st", "en", "total"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, st long, en long, total double", "kept array<double>, start long, skip long", "append", "NoTimeout")


def run_stream(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until it has read all that is there, as a table in folder (a shared one)."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
