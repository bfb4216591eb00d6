"""JSON lines, shards, id logs, CSV and prediction texts as DataFrames.

Order is meaning in these files: scans carry (shard, line) and nothing relies on the order of rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import strip
from quillstone.session import stage

SHARD = r"part-(\d+)\.jsonl(?:\.gz)?$"


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path)
    file = F.col("_metadata.file_name")
    return raw.select("value", file.alias("file"), F.regexp_extract(file, SHARD, 1).try_cast("long").alias("shard"), F.monotonically_increasing_id().alias("line"))


def json_objects(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines that hold a JSON object, as VARIANT column ``v``; blank, malformed and other lines are left out."""
    parsed = lines.withColumn("v", F.try_parse_json(F.col(col)))
    return parsed.filter("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(v, file, shard, line) of one JSONL file or folder, gzipped or not."""
    return json_objects(_lines(spark, path, None)).drop("value")


def read_shards(spark: SparkSession, path: str, include_open: bool = False, only_unfinished: bool = False) -> DataFrame:
    """Finished ``part-N.jsonl.gz`` shards, then, on request, open ``part-N.jsonl`` ones (phase 1).

    ``only_unfinished`` takes an open shard only where no finished shard has its number.  A missing folder is empty.
    """
    if "://" not in path and not os.path.isdir(path):
        return spark.createDataFrame([], "file string, shard long, line long, phase int").withColumn("v", F.try_parse_json(F.lit(None).cast("string")))
    done = json_objects(_lines(spark, path, "part-*.jsonl.gz")).drop("value").withColumn("phase", F.lit(0))
    if not (include_open or only_unfinished):
        return done
    opened = json_objects(_lines(spark, path, "part-*.jsonl")).drop("value").withColumn("phase", F.lit(1))
    if only_unfinished:
        opened = opened.join(done.select("shard").distinct(), "shard", "left_anti")
    return done.unionByName(opened)


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file (``summary.json`` and unreadable files left out); a missing application number is the file's stem."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_name").alias("file")).filter("file <> 'summary.json'")
    v = json_objects(raw).drop("value")
    stem = F.regexp_replace("file", r"\.json$", "")
    number = field(F.col("v"), "$.application_number")
    return v.withColumn("application_number", F.when(number == "", stem).otherwise(number))


def next_shard(shards: DataFrame) -> DataFrame:
    """One row: the number after the highest shard; 0 without shards."""
    return shards.agg((F.coalesce(F.max("shard"), F.lit(-1)) + 1).alias("next_shard"))


def field(v: Column, path: str) -> Column:
    """A member as text; empty where it is missing or null, JSON text where it is no scalar."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.nullif(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("null")), F.lit(""))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a log with one id a line: trimmed, distinct, blanks left out; a missing log is empty."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).filter("id <> ''").distinct()


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    first = F.min_by(F.struct("*"), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(first).select("r.*")


def read_seed(spark: SparkSession, path: str, column: str = "application_number") -> DataFrame:
    """(column, ord) of a CSV with a header (byte order mark allowed): trimmed, blanks dropped, first occurrences; other columns aren't read."""
    raw = spark.read.csv(path, header=True)
    if column not in raw.columns:
        raise ValueError(f"{path} has no column {column}")
    ids = raw.select(strip(F.col(column)).alias(column), F.monotonically_increasing_id().alias("ord")).filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return ids.groupBy(column).agg(F.min("ord").alias("ord"))


def read_claims_csv(spark: SparkSession, path: str, id_col: str = "application_number", text_col: str = "claim") -> DataFrame:
    """Claim rows of a CSV (gzipped or not, quoted newlines, any length): (id, text, ord), rows without either dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    missing = {id_col, text_col} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    rows = raw.select(strip(F.col(id_col)).alias(id_col), strip(F.col(text_col)).alias(text_col), F.monotonically_increasing_id().alias("ord"))
    return rows.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(id_col) != "") & (F.col(text_col) != ""))


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to id of a vocabulary file, one token a line, by its place; a repeated token keeps its last. Vocabularies are of bounded size."""
    lines = ranked(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")), ["_start", "_line"], "id")
    return {r.value.strip(): r.id for r in lines.orderBy("id").toLocalIterator()}


#: The sections of the classification, a label set of their own.
SECTIONS = list("ABCDEFGH") + ["Y"]


def read_examples(spark: SparkSession, path: str, header: bool = True, number_of_predictions: int = -1) -> DataFrame:
    """(group_ids, id, date, text, row_index) of a classifier's TSV: nothing is quoted, rows without a label are left out.

    ``number_of_predictions`` N stops at line N counting the header, so N - 1 rows are read; a negative number reads all.
    """
    lines = ranked(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")), ["_start", "_line"], "_n")
    if header:
        lines = lines.filter("_n > 0")
    if number_of_predictions >= 0:
        lines = lines.filter(F.col("_n") < number_of_predictions)
    part = F.split("value", "\t", -1)
    named = [F.coalesce(F.get(part, i), F.lit("")).alias(n) for i, n in enumerate(("group_ids", "id", "date", "text"))]
    return lines.select(*named, F.col("_n").alias("row_index")).filter(strip(F.col("group_ids")) != "")


def read_labels(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(label, position) of the first column of a TSV, blanks dropped."""
    raw = spark.read.csv(path, sep="\t", header=header, quote="")
    rows = raw.select(strip(F.col(f"`{raw.columns[0]}`")).alias("label"), F.monotonically_increasing_id().alias("ord")).filter("label <> ''")
    return ranked(rows, ["ord"], "position")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A global 0-based ordinal without a single-partition window: counts by range partition, then offsets, all in the JVM.

    The range partitions are kept in the shared folder, so that rows are counted and numbered in the same place; the
    driver gets one count a partition.
    """
    spread = stage(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for r in sorted(spread.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r.p, total))
        total += r.n
    if not offsets:
        return spread.withColumn(name, F.lit(0).cast("long")).drop("_id")
    return spread.withColumn(name, F.create_map(*[F.lit(x) for po in offsets for x in po])[part] + place).drop("_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(value, row_index) of a prediction text or a folder of them: lines as they stand, numbered in the order of files and lines.

    ``classify.predicted`` gives a line's labels and scores, ``classify.attach_predictions`` its input.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    return ranked(lines, ["_file", "_start", "_line"], "row_index").select("value", "row_index")
