"""Counts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.ipc import normalize_ipc
from quillstone.functions.text import is_blank
from quillstone.operators.records import primary_texts
from quillstone.session import stage


def label_counts(df: DataFrame, codes: Column, distinct: bool = False) -> DataFrame:
    """(code, n): uses of each normalised code; a code twice in one record counts twice unless ``distinct``."""
    if distinct:
        return df.select(F.explode(F.array_distinct(F.transform(codes, normalize_ipc))).alias("code")).filter("code <> ''").groupBy("code").agg(F.count("*").alias("n"))
    # Spellings are counted first, so the patterns run once a spelling.
    spelled = df.select(F.explode(codes).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return spelled.groupBy(normalize_ipc(F.col("raw")).alias("code")).agg(F.sum("n").alias("n")).filter("code <> ''")


def frequency_of_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count("*").alias("codes"))


def tail_summary(counts: DataFrame, few: int = 5) -> DataFrame:
    """(metric, value): size and weight of the tail of rarely used codes; shares in per cent, 0 where there is nothing."""
    total = counts.agg(
        F.count("*").alias("codes"),
        F.count_if(F.col("n") == 1).alias("ones"),
        F.count_if(F.col("n") <= few).alias("few"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("uses"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    rows = [
        ("unique_codes", F.col("codes")), ("singleton_codes", F.col("ones")), ("singleton_pct", share("ones", "codes")), ("few_codes", F.col("few")), ("few_pct", share("few", "codes")),
        ("assignments", F.col("uses")), ("singleton_assignments", F.col("ones")), ("singleton_assignments_pct", share("ones", "uses")),
    ]
    return total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), 4).alias("value")) for k, v in rows])).alias("r")).select("r.*")


def describe(df: DataFrame, values: list[str]) -> DataFrame:
    """(metric, n, min, max, mean), a row for each column, from one pass; nulls don't count."""
    row = lambda v: F.struct(F.lit(v).alias("metric"), F.count(v).alias("n"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"), F.round(F.avg(v), 4).alias("mean"))
    return df.agg(F.array(*[row(v) for v in values]).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def percentile_cap(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """One row, ``cap``: the inclusive, interpolated quantile; null for no values."""
    return df.sparkSession.createDataFrame([(quantile(df, value, q),)], "cap double")


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The exact inclusive, interpolated quantile of a column, with no task that holds more than a range of its distinct values.

    Values are counted, spread by range, and only the range that the wanted ranks fall into is looked at in order; the driver gets
    one count a range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    spread = stage(counts.repartitionByRange("v").sortWithinPartitions("v")).withColumn("p", F.spark_partition_id())
    sizes = sorted(spread.groupBy("p").agg(F.sum("n").alias("n")).collect())
    total = sum(r.n for r in sizes)
    if not total:
        return None
    rank = (total - 1) * q
    low, high = int(rank), min(int(rank) + 1, total - 1)
    found, before = {}, 0
    for r in sizes:
        here = [k for k in {low, high} if before <= k < before + r.n]
        if here:
            upto = F.sum("n").over(Window.partitionBy("p").orderBy("v")) + before
            for k in here:
                found[k] = spread.filter(F.col("p") == r.p).withColumn("upto", upto).filter(F.col("upto") > k).agg(F.min("v")).first()[0]
        before += r.n
    return found[low] + (found[high] - found[low]) * (rank - low)


def clip(df: DataFrame, values: list[str], q: float = 0.99) -> DataFrame:
    """Rows in which each of ``values`` is at most its own ``q`` quantile.

    The quantiles are one row of scalars, read first, so the filter is a plain comparison.
    """
    # Whole numbers are sizes and counts here, with few distinct values, and share one pass; others go through the ranges of ``quantile``.
    whole = [v for v in values if df.schema[v].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]
    some = df.agg(*[F.percentile(F.col(v), q).alias(v) for v in whole]).first() if whole else {}
    caps = {v: some[v] if v in whole else quantile(df, v, q) for v in values}
    keep = F.lit(True)
    for v in values:
        keep = keep & (F.col(v) <= F.lit(caps[v]))
    return df.filter(keep)


def histogram(df: DataFrame, value: str, q: float = 0.99, fewest: int = 10, most: int = 40) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over values clipped at their ``q`` quantile.

    sqrt(n) bins, at least ``fewest`` and at most ``most``; the last bin holds its upper edge; empty bins are left out;
    a single value is one bin.
    """
    kept = clip(df.filter(F.col(value).isNotNull()), [value], q)
    n, low, high = kept.agg(F.count("*"), F.min(value), F.max(value)).first()
    bins = max(fewest, min(most, int((n or 0) ** 0.5)))
    low, high = float(low or 0), float(high or 0)
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long") if width else F.lit(0).cast("long")
    return kept.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", F.round(low + F.col("bin") * width, 6).alias("low"), F.round(low + (F.col("bin") + 1) * width, 6).alias("high"), "n")


def histogram_integer(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """(value, n) of the positive integers up to their ``q`` quantile."""
    return clip(df.filter(F.col(value) > 0), [value], q).groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, q: float = 0.99, grid: int = 20) -> DataFrame:
    """(x_bin, y_bin, n) of a ``grid`` x ``grid`` raster (rectangles, where plots draw hexagons) over values clipped on both axes."""
    kept = clip(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], q)
    e = kept.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(c: str, low, high) -> Column:
        width = ((high or 0) - (low or 0)) / grid
        return F.least(F.floor((F.col(c) - low) / width), F.lit(grid - 1)).cast("long") if width else F.lit(0).cast("long")

    return kept.groupBy(cell(x, e[0], e[1]).alias("x_bin"), cell(y, e[2], e[3]).alias("y_bin")).agg(F.count("*").alias("n"))


def coverage(clean: DataFrame) -> DataFrame:
    """One row of counters over clean records and their primary documents: what is there and what is missing."""
    rows = primary_texts(clean).select("doc", "ipcr_classification", F.col("application_number"))
    claims = F.filter(F.coalesce("doc.claims", F.array().cast("array<string>")), lambda c: ~is_blank(c))
    has = {
        "application_number": ~is_blank(F.col("application_number")),
        "document": F.col("doc").isNotNull(),
        "claims": F.size(claims) > 0,
        "abstract": ~is_blank(F.col("doc.abstract")),
        "codes": F.coalesce(F.size("ipcr_classification"), F.lit(0)) > 0,
    }
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"with_{k}") for k, c in has.items()]
    return rows.agg(F.count("*").alias("records"), *counts, *[(F.count("*") - F.count_if(F.coalesce(c, F.lit(False)))).alias(f"without_{k}") for k, c in has.items()], F.coalesce(F.sum(F.size(claims)), F.lit(0)).alias("claims"))


def marked_limit(bins: DataFrame, cap: float | None, limit: int = 512) -> DataFrame:
    """A histogram with the column ``bert_limit``: the limit where the axis reaches it (its cap is as large), else null."""
    return bins.withColumn("bert_limit", F.lit(limit if cap is not None and cap >= limit else None).cast("int"))


def corpus_summary(clean: DataFrame) -> DataFrame:
    """One row over clean records: records, documents a record, mean characters of claims and abstracts a document, records with documents and with codes."""
    docs = F.coalesce("published_documents", F.array().cast(clean.schema["published_documents"].dataType))
    chars = lambda f: F.aggregate(docs, F.lit(0).cast("long"), lambda s, d: s + F.coalesce(f(d), F.lit(0)))
    own = clean.select(
        F.size(docs).cast("long").alias("d"),
        chars(lambda d: F.length(F.array_join(d["claims"], ""))).alias("c"),
        chars(lambda d: F.length(d["abstract"])).alias("a"),
        F.col("ipcr_classification").isNotNull().alias("coded"),
    )
    mean = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return own.agg(
        F.count("*").alias("records"),
        mean(F.sum("d"), F.count("*")).alias("documents_per_record"),
        mean(F.sum("c"), F.sum("d")).alias("claims_chars_per_document"),
        mean(F.sum("a"), F.sum("d")).alias("abstract_chars_per_document"),
        F.count_if(F.col("d") > 0).alias("with_documents"),
        F.count_if("coded").alias("with_codes"),
    )
