"""Incremental ingest: new files once, appended, with reports that merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, fmt: str = "parquet", files_per_batch: int | None = None) -> StreamingQuery:
    """Append what is new in ``source`` to ``sink`` and stop; each file is taken once over all runs with the checkpoint."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = source.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in spark.read.schema(schema).format(fmt).load(source).inputFiles()] == [name]:  # a stream reads folders; a single file is picked from its own
        reader, source = reader.option("pathGlobFilter", name), folder
    out = transform(reader.load(source)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start(sink)


def merged_report(stream: DataFrame, checkpoint: str, path: str, summarise: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Keep one report over all batches: each batch's summary is merged with the last report of an earlier batch.

    Reports are written as ``path/batch=N``; a batch that is repeated after a failure rewrites its own folder from
    the one before it, so it counts once.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        report = summarise(batch)
        if n > 0:
            report = merge(spark.read.parquet(f"{path}/batch={n - 1}"), report)
        report.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
