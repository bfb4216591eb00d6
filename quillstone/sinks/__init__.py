"""Writers: sharded JSON lines, CSV and TSV tables, id logs, manifests and prediction texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import stage


def write_jsonl(df: DataFrame, path: str, shard_size: int | None = None, mode: str = "errorifexists", gzip: bool = True) -> None:
    """JSON lines that keep null members; at most ``shard_size`` rows a file. Spark's commit makes the write atomic."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if gzip:
        w = w.option("compression", "gzip")
    if shard_size:
        w = w.option("maxRecordsPerFile", shard_size)
    w.json(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False, sep: str = ",", one_file: bool = False, mode: str = "overwrite", most: int = 64 << 20) -> None:
    """CSV or TSV with a header; ``one_file`` is for small tables only: more than ``most`` bytes by Spark's estimate are refused."""
    if one_file:
        df = stage(df)  # the table is made in parallel, one task only writes it
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if df.isEmpty() else df.select(F.sum(F.length(F.to_csv(F.struct(*df.columns))))).first()[0]
        if size > most:
            raise ValueError(f"{size} bytes are too many for one file")
    w = (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def write_ids(df: DataFrame, path: str, col: str = "id", mode: str = "append") -> None:
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def write_manifest(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_routed(df: DataFrame, path: str, passed: Column, shard_size: int | None = None) -> None:
    """Rows into ``outcome=passed`` and ``outcome=rejected`` in one pass."""
    w = df.withColumn("outcome", F.when(passed, "passed").otherwise("rejected")).write.mode("overwrite").partitionBy("outcome").option("ignoreNullFields", "false").option("compression", "gzip")
    if shard_size:
        w = w.option("maxRecordsPerFile", shard_size)
    w.json(path)


def prediction_line(labels: Column, scores: Column, threshold: float) -> Column:
    """``LABEL (0.85), LABEL2 (0.42)`` of the scores above the threshold; an empty line without any."""
    pairs = F.filter(F.arrays_zip(labels.alias("l"), scores.alias("s")), lambda x: x["s"] > threshold)
    return F.array_join(F.transform(pairs, lambda x: F.format_string("%s (%.2f)", x["l"], x["s"].cast("double"))), ", ")
