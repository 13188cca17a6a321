"""Incremental index building from a stream of chunk files (beyond the batch build)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..plans.build import build_index, next_index, todo
from ..schemas import CHUNK, EMBED_TYPES
from ..sources.chunks import load_index


def stream_index(spark: SparkSession, source: str, path: str, checkpoint: str, embed: Callable[[Column], Column]):
    """Add each new file's chunks to the index at ``path``; returns the running query.

    A chunk that the index has already is skipped, so a batch that is run again after a
    failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.filter(batch.chunk_type.isin(*EMBED_TYPES)).dropDuplicates(["chunk_id"])
        start = 0
        try:
            old = load_index(batch.sparkSession, path)
            rows = todo(rows, old)
            start = next_index(old)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        build_index(rows, embed, ["chunk_id"], start).write.mode("append").partitionBy("chunk_type").parquet(path)

    stream = spark.readStream.schema(CHUNK).json(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
