"""Overlap and similarity of texts and vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillstone.functions.stem import porter
from quillstone.functions.text import containment_form, let, occurrences, tokens


def token_f1(reference: Column, candidate: Column) -> Column:
    """F1 of the words both have, counted with repeats; 0 where either has none."""
    return counted_f1(tokens(reference), tokens(candidate))


def counted_f1(reference: Column, candidate: Column) -> Column:
    """F1 of the elements two arrays share, counted with repeats; 0 where neither has any."""
    score = lambda a, b: F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))
    return let(occurrences(reference), lambda a: let(occurrences(candidate), lambda b: score(a, b)))


def answer_contained(answer: Column, context: Column) -> Column:
    a = containment_form(answer)
    return (a != "") & containment_form(context).contains(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word operation for many cells."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_words(text: str | None) -> list[str]:
    return [porter(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


@F.pandas_udf(DoubleType())
def rouge_l_f1(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ROUGE-L F1 of stemmed words; 0 where either text has none."""
    for reference, candidate in batches:
        out = []
        for r, c in zip(reference, candidate):
            a, b = rouge_words(r), rouge_words(c)
            out.append(2.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0)
        yield pd.Series(out, dtype="float64")


def hash_embedding(dim: int = 256):
    """A stand-in for a sentence encoder: hashed word counts of unit length (array<float>)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        def one(t):
            v = np.zeros(dim, "float32")
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return embed
