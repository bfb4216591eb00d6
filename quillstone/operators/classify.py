"""Classifier inputs, predictions and their evaluation; the model itself is an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import tsv_field
from quillstone.operators.relate import small
from quillstone.sources.jsonl import ranked

# The constant date of classifier inputs and the form of a predicted label.
INPUT_DATE = "1970-01-01"
LABEL = r"(\S+)\s+\(([0-9.]+)\)"


def claim_inputs(claims: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """(key, claim_seq, id, text, row_index): running number within the key, ``key__seq`` as id, a global ordinal."""
    rows = ranked(claims, [key, *order], "row_index")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("row_index").alias("_first"))
    numbered = rows.join(small(first), F.col(key) == F.col("_key")).withColumn("claim_seq", F.col("row_index") - F.col("_first") + 1)
    return numbered.select(key, "claim_seq", F.concat_ws("__", key, "claim_seq").alias("id"), tsv_field(F.col(text)).alias("text"), "row_index")


def input_tsv(inputs: DataFrame, placeholder: str) -> DataFrame:
    return inputs.select(F.lit(placeholder).alias("group_ids"), "id", F.lit(INPUT_DATE).alias("date"), "text")


def predicted(line: Column) -> tuple[Column, Column]:
    """(labels, scores as written) of ``LABEL (0.85), ...``; empty lists for a blank line."""
    part = lambda i: F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(LABEL), F.lit(i))
    return F.transform(part(1), lambda x: F.ltrim(x)), part(2)


def attach_predictions(inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """Inputs with the prediction of the same ordinal; the longer side's rest is dropped.  ``lines``: (row_index, value)."""
    labels, scores = predicted(F.col("value"))
    return inputs.join(lines, "row_index").select("row_index", "id", labels.alias("labels"), scores.alias("scores"))


def multi_hot(scores: Column, threshold: float) -> Column:
    """1 where a score is above the threshold; from 1 on, the threshold is a number of labels: those above the next best score of the row."""
    if threshold < 1:
        return F.transform(scores, lambda p: (p > threshold).cast("int"))
    least = F.get(F.sort_array(scores, asc=False), F.lit(int(threshold)))
    return F.transform(scores, lambda p: F.when(least.isNull() | (p > least), 1).otherwise(0))


def label_positions(labels: Column, catalog: list[str]) -> Column:
    """Multi-hot array of a row's labels over the catalog."""
    return F.transform(F.array(*[F.lit(x) for x in catalog]), lambda x: F.array_contains(labels, x).cast("int"))


def element_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: the share of equal elements over all rows and labels."""
    same = F.aggregate(F.zip_with(truth, guess, lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.agg(F.round(F.try_divide(F.sum(same), F.sum(F.size(truth))), 6).alias("accuracy"))


def predict(df: DataFrame, text: str, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 30) -> DataFrame:
    """Rows with ``scores``; the model is made once a worker and called with batches of texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for s in batches:
            texts, out = s.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                out += model(texts[i : i + batch])
            yield pd.Series(out)

    return df.withColumn("scores", run(text))
