"""A frozen replay over streams: the same projections, with batch guards in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyforge.plans.spec import Replay


def replay_stream(stream: DataFrame, replay: Replay) -> DataFrame:
    """Stateless: no aggregation, no watermark needed."""
    return replay.apply(stream)[0]


def guarded_stream(stream: DataFrame, replay: Replay, train_like: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, action: str = "warn", on_warning: Callable[[str], None] | None = None) -> StreamingQuery:
    """Replay each micro-batch after the null policy's scale and missing-rate guards, then hand it to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        if replay.nulls:
            replay.nulls.guard(train_like, batch, action, on_warning)
        sink(replay.apply(batch)[0], number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
