"""Progress events as a stream: projections, windows and a stateful carry-forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.functions.scalars import register

#: The share of a page that is done at each stage, and what is said of it.
STAGE_SHARE = {"enhancing": 0.12, "reading": 0.55, "grouping": 0.90, "checking": 0.97, "enhance": 0.12, "read": 0.55, "group": 0.90, "check": 0.97}
STAGE_MESSAGE = {"started": "Starting", "enhancing": "Straightening the photo", "reading": "Reading the counts", "grouping": "Matching the page to a slip", "checking": "Checking totals", "page": "Page ready", "complete": "Finished"}


def _of(values: dict, key: str, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key)), F.lit(default))


def progress(events: DataFrame) -> DataFrame:
    """Adds event, message, remaining_seconds and percent to (stage, elapsed, done, total), batch or stream."""
    register(events.sparkSession)
    d = events.withColumn("__f", _of(STAGE_SHARE, "stage", 0.0))
    args = "CAST(done AS DOUBLE), CAST(total AS DOUBLE), __f"
    event = F.when(F.col("stage").isin("started", "complete", "error"), F.col("stage")).otherwise("progress")
    return d.withColumns({"event": event, "message": _of(STAGE_MESSAGE, "stage", "Processing"), "remaining_seconds": F.expr(f"remaining_s(CAST(elapsed AS DOUBLE), {args})"), "percent": F.expr(f"percent_done({args})")}).drop("__f")


def outcomes(events: DataFrame) -> DataFrame:
    """(request_id, outcome, detail) of event rows (request_id, seq, event, detail): an error ends a request, a request
    that never completes is aborted."""
    d = events.groupBy("request_id").agg(F.min(F.when(F.col("event") == "error", F.struct("seq", "detail"))).alias("e"), F.bool_or(F.col("event") == "complete").alias("done"))
    return d.select("request_id", F.when(F.col("e").isNotNull(), "error").when(F.col("done"), "complete").otherwise("aborted").alias("outcome"), F.col("e.detail").alias("detail"))


def to_ndjson(events: DataFrame, path: str, checkpoint: str):
    """A stream of events as lines of JSON; what a batch is made of is a file."""
    return events.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def windowed(events: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(F.window("__ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest(events: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The last known value of each field by key, as a stream; state is one row a key. Order within a key is by seq."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None] * len(fields)
        for pdf in batches:
            for row in pdf.sort_values("seq")[fields].itertuples(index=False):
                held = [old if pd.isna(new) else str(new) for new, old in zip(row, held, strict=True)]
        state.update(tuple(held))
        yield pd.DataFrame([[k[0], *held]], columns=[key, *fields])

    schema = ", ".join(f"{f} string" for f in fields)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {events.schema[key].dataType.simpleString()}, {schema}", schema, "update", GroupStateTimeout.NoTimeout)
