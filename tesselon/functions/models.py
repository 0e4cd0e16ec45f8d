"""Models that users bring: loaded once per partition, called per item, failures kept as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_model(df: DataFrame, factory: Callable[[], Callable[[dict], str]], keys: list[str]) -> DataFrame:
    """``keys`` with ``success``, ``output`` and ``error`` per row. ``factory`` makes the model, once per partition; the model
    takes a row as a dict and gives a text. An item that fails never stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            done = [safe_apply(model, row) for row in batch.to_dict("records")]
            yield batch[keys].assign(success=[d[0] for d in done], output=[d[1] for d in done], error=[d[2] for d in done])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInPandas(run, f"{kinds}, success boolean, output string, error string")


def safe_apply(model: Callable[[dict], str], row: dict) -> tuple[bool, str | None, str | None]:
    try:
        return True, model(row), None
    except Exception as e:  # noqa: BLE001 - whatever a model raises becomes the item's error
        return False, None, f"{type(e).__name__}: {e}"


def adapter_output(mapped: DataFrame, kind: str) -> DataFrame:
    """``mapped`` with ``metadata``: the model's JSON under ``extracted_text`` (ocr) or ``classification_result`` (inference)."""
    name = {"ocr": "extracted_text", "inference": "classification_result"}[kind]
    empty = F.create_map().cast("map<string,string>")
    return mapped.withColumn("metadata", F.when(F.col("success"), F.create_map(F.lit(name), F.col("output"))).otherwise(empty))
