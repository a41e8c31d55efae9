"""Answering a stream of questions against stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the answers of each micro-batch to its own folder below `path`.

    A batch that runs again after a failure overwrites its own folder, so no
    answer appears twice."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
