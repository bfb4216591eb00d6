"""Joins, set operations, deduplication, ordinals and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.ipc import format_symbol, normalize_ipc
from quillstone.sources.jsonl import ranked

# Kinds of catalog entries that are places, by how specific they are.
PLACE_KINDS = ["s", "c", "u", "m", "1", "2", "3", "4", "5", "6", "7", "8", "9"]

#: A side is broadcast only below this many bytes; beyond, Spark joins by sort and merge.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side marked for broadcast if its estimated size is within the limit, else unchanged."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def pending(seed: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys of ``seed`` that aren't in ``done``; the limit counts after the anti join."""
    rest = seed.join(done.select(F.col(key)).distinct(), key, "left_anti")
    return first_rows(rest, ["ord"], limit)


def first_rows(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in order (a limit on input or on successes); all rows without a limit, none for a limit of 0 or less."""
    return df if limit is None else df.orderBy(*order).limit(max(0, limit))


def until_successes(df: DataFrame, order: list[str], succeeded: Column, limit: int | None) -> DataFrame:
    """Rows in order up to and with the one that brings the ``limit``-th success: what a run does that stops after so many."""
    if limit is None:
        return df
    if limit <= 0:
        return df.limit(0)
    last = ranked(df.filter(succeeded).select(*order), order, "_n").filter(F.col("_n") == limit - 1).first()
    return df if last is None else df.filter(F.struct(*order) <= F.struct(*[F.lit(last[c]).alias(c) for c in order]))


def recovered(log: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a log and of records found without a log entry."""
    return log.select(key).union(found.select(key)).filter(F.col(key).isNotNull()).distinct()


def place_kind_rank(kind: Column) -> Column:
    """0 for kinds that are no places."""
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PLACE_KINDS]), kind), F.lit(0))


def ordered_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; ties by all order columns."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def best_by_kind(catalog: DataFrame, symbol: str, kind: str, order: list[str]) -> DataFrame:
    """One place entry a symbol: the most specific kind, the first of equals."""
    places = catalog.withColumn("_rank", place_kind_rank(F.col(kind))).filter("_rank > 0")
    first = F.min_by(F.struct(*catalog.columns), F.struct((-F.col("_rank")).alias("r"), *order))
    return places.groupBy(symbol).agg(first.alias("e")).select("e.*")


def build_catalog(scheme: DataFrame, definitions: DataFrame) -> DataFrame:
    """Catalog rows of scheme entries: the best place entry a symbol, its notes in document order, its definition if it has one."""
    places = best_by_kind(scheme.filter("title IS NOT NULL AND title <> ''"), "symbol", "kind", ["ord"])
    in_order = F.array_sort(F.collect_list(F.struct("ord", "note")))  # a symbol's notes, a handful
    notes = scheme.filter("kind = 'n' AND note IS NOT NULL").groupBy("symbol").agg(F.array_join(F.transform(in_order, lambda x: x["note"]), " ").alias("scheme_note"))
    defined = definitions.withColumn("has_definition_entry", F.lit(True))
    return (
        places.drop("note", "ord", "end_symbol")
        .join(notes, "symbol", "left")
        .join(defined, "symbol", "left")
        .withColumns({"ipc_code": format_symbol(F.col("symbol")), "has_definition_entry": F.coalesce("has_definition_entry", F.lit(False))})
        .withColumnRenamed("symbol", "ipc_code_raw")
        .orderBy("ipc_code_raw")
    )


def catalog_lookup(catalog: DataFrame, order: list[str]) -> DataFrame:
    """One entry a normalised code, the last in order; entries without code or title are left out."""
    usable = catalog.withColumn("code", normalize_ipc(F.col("ipc_code"))).filter("code <> '' AND title IS NOT NULL AND trim(title) <> ''")
    return usable.groupBy("code").agg(F.max_by(F.struct(*catalog.columns), F.struct(*order)).alias("e")).select("code", "e.*")


def with_catalog(df: DataFrame, lookup: DataFrame, code: str = "primary_ipc", how: str = "inner") -> DataFrame:
    """Rows with the catalog entry of their code."""
    return df.withColumn("code", normalize_ipc(F.col(code))).join(small(lookup), "code", how)


def grounding_text(title: Column, definition: Column, note: Column, code: Column) -> Column:
    """``code title``, then the definition or, without one, the scheme note."""
    return F.concat_ws("\n", F.concat_ws(" ", code, title), F.coalesce(F.nullif(definition, F.lit("")), F.nullif(note, F.lit(""))))


def running_number(df: DataFrame, key: str, order: list[str], name: str = "claim_seq") -> DataFrame:
    """1, 2, 3 ... within each key, from the rows' global ordinals, so that a key of any size is sorted by many tasks."""
    rows = ranked(df, [key, *order], "_rank")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias("_first"))
    numbered = rows.join(small(first), F.col(key).eqNullSafe(F.col("_key")))
    return numbered.withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_key", "_first")


def shards(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """row_index (global, from 0) and shard (row_index / size), without a single-partition window."""
    return ranked(df, order, "row_index").withColumn("shard", F.floor(F.col("row_index") / size))


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 42, done: DataFrame | None = None) -> DataFrame:
    """``size`` distinct keys by the order of md5(seed:key), minus those done: a later run draws the same sample.

    The order is portable between engines; it is not that of Python's generator for the same seed.
    """
    drawn = df.filter(F.col(key).isNotNull()).select(key).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)
    return drawn if done is None else drawn.join(done.select(key), key, "left_anti")
