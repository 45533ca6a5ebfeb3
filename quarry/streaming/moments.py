"""Aggregates and scores of unbounded tables, as plans of Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, columns: list[str], time: str, window: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """n, and mean and population variance of each column, by window of the event time and by the given columns.

    Rows later than `late` behind the newest are left out and the state of a window is dropped once it is closed.
    The same plan runs on a table at rest.
    """
    each = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_var"))]
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("window"), *(by or [])).agg(F.count("*").alias("n"), *each)


def score_stream(stream: DataFrame, model, output: str = "prediction") -> DataFrame:
    """The stream with the fitted model's predictions; no state is held."""
    model.check_fitted()
    return model.predict(stream, output)
