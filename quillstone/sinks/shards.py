"""Numbered shards ``part-00000.jsonl.gz``: written, continued, closed and packed; readers find them again by their number."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.jsonl import SHARD, ranked, whole_json


def shard_name(number: int, gzip: bool = True) -> str:
    return f"part-{number:05d}.jsonl{'.gz' if gzip else ''}"


def _files(spark: SparkSession, folder: str) -> tuple[object, object, dict[str, object]]:
    """(file system, folder, files by name); the folder may be missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, path, {s.getPath().getName(): s.getPath() for s in fs.listStatus(path) if s.isFile()} if fs.exists(path) else {}


def shard_numbers(spark: SparkSession, folder: str) -> dict[str, int]:
    """Shard files of a folder, finished and open, with their numbers."""
    import re

    return {name: int(m[1]) for name in _files(spark, folder)[2] if (m := re.search(SHARD, name))}


def json_line() -> Column:
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def write_lines(lines: DataFrame, folder: str, gzip: bool = True, replace: bool = False) -> list[str]:
    """Rows (shard, ord, line) to one file a shard, lines in order.

    Shards are written beside the folder and moved in by name once all are whole; a number that is taken is refused unless
    ``replace``.  The driver handles file names only.
    """
    spark = lines.sparkSession
    beside = f"{folder.rstrip('/')}/_new-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = lines.repartition(parts, "shard").sortWithinPartitions("shard", "ord").select("shard", "line").write.partitionBy("shard")
    (w.option("compression", "gzip") if gzip else w).text(beside)
    fs, path, there = _files(spark, folder)
    new = spark._jvm.org.apache.hadoop.fs.Path(beside)
    moves = []
    for shard in fs.listStatus(new):
        if shard.isDirectory() and "=" in shard.getPath().getName():
            files = [s.getPath() for s in fs.listStatus(shard.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            moves.append((files, shard_name(int(shard.getPath().getName().partition("=")[2]), gzip)))
    taken = sorted(name for _, name in moves if name in there)
    if taken and not replace:
        fs.delete(new, True)
        raise FileExistsError(f"{folder} has {taken[0]} already")
    for files, name in moves:
        if len(files) != 1:
            raise RuntimeError(f"{name} fell into {len(files)} files")
        target = spark._jvm.org.apache.hadoop.fs.Path(path, name)
        if name in there:
            fs.delete(target, False)
        fs.rename(files[0], target)
    fs.delete(new, True)
    return sorted(name for _, name in moves)


def write_shards(df: DataFrame, folder: str, order: list[str], shard_size: int, mode: str = "refuse", gzip: bool = True) -> list[str]:
    """Rows as JSON lines (null members kept) in shards of ``shard_size`` rows by ``order``; the names of the files written.

    ``refuse``: an error where the folder has shards; ``force``: they are replaced, those beyond the new ones removed;
    ``append``: numbers go on after the highest.
    """
    spark = df.sparkSession
    old = shard_numbers(spark, folder)
    if old and mode == "refuse":
        raise FileExistsError(f"{folder} has shards")
    start = max(old.values(), default=-1) + 1 if mode == "append" else 0
    rows = ranked(df.select(*order, json_line().alias("_json")), order, "_ord")
    written = write_lines(rows.select((F.floor(F.col("_ord") / shard_size) + start).cast("long").alias("shard"), F.col("_ord").alias("ord"), F.col("_json").alias("line")), folder, gzip, replace=mode == "force")
    if mode == "force":
        fs, _, files = _files(spark, folder)
        for name in old:
            if name not in written:
                fs.delete(files[name], False)
    return written


def close_shards(spark: SparkSession, folder: str) -> list[str]:
    """Open shards gzipped, then removed; one whose number is finished already is left alone."""
    numbers = shard_numbers(spark, folder)
    done = {n for name, n in numbers.items() if name.endswith(".gz")}
    todo = [name for name, n in numbers.items() if not name.endswith(".gz") and n not in done]
    if not todo:
        return []
    raw = spark.read.text([f"{folder.rstrip('/')}/{name}" for name in todo])
    file = F.col("_metadata.file_name")
    lines = raw.select(F.regexp_extract(file, SHARD, 1).cast("long").alias("shard"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"), F.col("value").alias("line"))
    written = write_lines(lines, folder)
    fs, _, files = _files(spark, folder)
    for name in todo:
        fs.delete(files[name], False)
    return written


def pack(spark: SparkSession, legacy: str, folder: str, shard_size: int = 1000, force: bool = False) -> list[str]:
    """A folder of one JSON object a file as shards, by application number; existing shards are refused unless ``force``."""
    records = whole_json(spark, legacy)
    rows = ranked(records.select("application_number", "file", F.to_json("v").alias("line")), ["application_number", "file"], "ord")
    if not force and shard_numbers(spark, folder):
        raise FileExistsError(f"{folder} has shards")
    return write_lines(rows.select(F.floor(F.col("ord") / shard_size).cast("long").alias("shard"), "ord", "line"), folder, replace=force)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).filter("trim(value) <> ''").count()
