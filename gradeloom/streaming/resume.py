"""Scoring that appends and resumes: a stream of solution files, each micro-batch scored and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.evaluation import score_batch
from ..schema import SOLUTION
from ..sources.runs import pending, read_rows


def scoring_stream(spark: SparkSession, source: str, run_folder: str, score: Callable[[DataFrame], DataFrame], checkpoint: str, per_batch: int = 1):
    """A query that scores solutions (JSON files under ``source``) as they arrive; start with ``.awaitTermination()``.

    ``score`` gives scored steps (``plans.evaluation.scored_steps``), which are evaluated once. The checkpoint remembers which files are done; a batch that was cut off
    before its commit is tried again as a whole, one that was cut off after it finds its uids done: each solution
    has one prediction, and its traces are those of that prediction.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        todo = pending(rows, read_rows(spark, run_folder)).persist()
        try:
            if not todo.isEmpty():
                score_batch(spark, run_folder, score(todo))
        finally:
            todo.unpersist()

    stream = spark.readStream.schema(SOLUTION).option("maxFilesPerTrigger", per_batch).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
