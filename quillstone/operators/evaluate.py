"""Measures of answers and agreement that the methodology notes ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.ipc import SYMBOL, normalize_ipc
from quillstone.functions.overlap import counted_f1
from quillstone.functions.text import containment_form, let, tokens

LEVELS = ["section", "class", "subclass", "group", "full"]


def code_level(code: Column, level: str) -> Column:
    """The code cut to a level of the hierarchy; null where it doesn't reach it."""
    cut = {"section": F.substring(code, 1, 1), "class": F.substring(code, 1, 3), "subclass": F.substring(code, 1, 4), "group": F.when(F.contains(code, F.lit("/")), F.substring_index(code, "/", 1)), "full": code}[level]
    return F.when(F.length(code) >= {"section": 1, "class": 3, "subclass": 4, "group": 6, "full": 1}[level], cut)


def hierarchy_accuracy(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: rows with a true code, the share of guesses that are well formed, and the share right at each level."""
    pairs = df.select(F.nullif(normalize_ipc(truth), F.lit("")).alias("t"), F.nullif(normalize_ipc(guess), F.lit("")).alias("g")).filter("t IS NOT NULL")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    right = [share(code_level(F.col("t"), x) == code_level(F.col("g"), x)).alias(f"{x}_accuracy") for x in LEVELS]
    return pairs.agg(F.count("*").alias("rows"), share(F.col("g").rlike(f"^{SYMBOL}$")).alias("well_formed"), *right)


def ngrams(c: Column, n: int) -> Column:
    """Runs of n words; none where there are fewer."""
    if n == 1:
        return tokens(c)
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return let(tokens(c), lambda words: F.when(F.size(words) >= n, runs(words)).otherwise(F.array().cast("array<string>")))


def ngram_f1(reference: Column, candidate: Column, n: int) -> Column:
    """F1 of word n-grams, counted with repeats; 0 where either text has fewer than n words."""
    return counted_f1(ngrams(reference, n), ngrams(candidate, n))


def exact_match(reference: Column, candidate: Column) -> Column:
    """Equal but for letter case and white space."""
    return containment_form(reference) == containment_form(candidate)


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: (n, agreement, kappa) of two raters; kappa is null where chance alone would agree always."""
    cells = confusion(df, a, b)
    side = lambda c: cells.groupBy(F.col(c).cast("string").alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side(a).join(side(b), "v", "full").agg(F.sum(F.coalesce(F.col(f"n_{a}"), F.lit(0)) * F.coalesce(F.col(f"n_{b}"), F.lit(0)).cast("double")).alias("e"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    one = seen.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")  # one row each
    po, pe = F.try_divide(F.col("same").cast("double"), F.col("n")), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    return one.select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def split_of(key: Column, parts: Sequence[tuple[str, float]], seed: int = 42) -> Column:
    """The part a key falls into by its hash: all rows of a key are in one part, in every run and engine."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    out, edge = F.lit(parts[-1][0]), sum(w for _, w in parts[:-1])
    for name, weight in reversed(parts[:-1]):
        out = F.when(u < edge, name).otherwise(out)
        edge -= weight
    return F.when(key.isNotNull(), out)
