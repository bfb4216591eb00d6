"""Basic and WordPiece tokenisation and classifier features; the vocabulary is a broadcast of bounded size."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def _cjk(cp: int) -> bool:
    # The blocks of CJK ideographs.
    blocks = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
    return any(a <= cp <= b for a, b in blocks)


def _punctuation(ch: str) -> bool:
    return ch.isascii() and ch.isprintable() and not ch.isalnum() and ch != " " or unicodedata.category(ch)[0] == "P"


def basic_tokens(text: str | None, lower: bool = True) -> list[str]:
    """Words, ideographs and marks: control characters dropped, accents removed in lower case."""
    spaced = []
    for ch in text or "":
        if ch in "\0�" or unicodedata.category(ch)[0] == "C" and ch not in "\t\n\r":
            continue
        spaced.append(f" {ch} " if _cjk(ord(ch)) else " " if ch.isspace() else ch)
    out = []
    for word in "".join(spaced).split():
        if lower:
            word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        piece = ""
        for ch in word:
            if _punctuation(ch):
                out += [piece, ch]
                piece = ""
            else:
                piece += ch
        out.append(piece)
    return [w for w in out if w]


def wordpieces(word: str, vocabulary: dict[str, int], longest: int = 200, unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces from the left, ``##`` before all but the first; unknown where a rest has none."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


class WordPiece:
    """Column functions over one vocabulary (token -> id), broadcast once."""

    def __init__(self, spark: SparkSession, vocabulary: dict[str, int], lower: bool = True) -> None:
        self.shared, self.lower = spark.sparkContext.broadcast(vocabulary), lower

    def _udf(self, make, kind: str):
        shared, lower = self.shared, self.lower

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocab, known = shared.value, {}

            def split(text):
                out = []
                # Control characters are dropped, not blanks: a text that has some is taken in one piece.
                for chunk in [text] if text and CONTROL.search(text) else (text or "").split():
                    p = known.get(chunk)
                    if p is None:
                        p = [x for w in basic_tokens(chunk, lower) for x in wordpieces(w, vocab)]
                        if len(chunk) < 100:
                            if len(known) > 200_000:
                                known.clear()
                            known[chunk] = p
                    out += p
                return out

            for s in batches:
                yield s.map(lambda t: make(split(t), vocab))

        return run

    def pieces(self, text: Column) -> Column:
        return self._udf(lambda p, v: p, "array<string>")(text)

    def length(self, text: Column) -> Column:
        """Number of pieces, without special tokens or truncation."""
        return self._udf(lambda p, v: len(p), "int")(text)

    def features(self, text: Column, size: int = 128) -> Column:
        """struct<input_ids, input_mask, segment_ids> of ``[CLS] pieces [SEP]``, cut and padded to ``size``."""
        ids = self._udf(lambda p, v: [v[x] for x in ["[CLS]", *p[: size - 2], "[SEP]"] if x in v], "array<int>")(text)
        pad = lambda c: F.concat(c, F.array_repeat(F.lit(0), size - F.size(ids)))
        return F.struct(pad(ids).alias("input_ids"), pad(F.transform(ids, lambda _: F.lit(1))).alias("input_mask"), F.array_repeat(F.lit(0), size).alias("segment_ids"))


def truncate_pair(a: Column, b: Column, most: int) -> Column:
    """struct<a, b>: the longer of two arrays is cut from its end until both fit (a loses only while it is longer)."""
    na, nb = F.size(a), F.size(b)
    over = F.greatest(na + nb - most, F.lit(0))
    # The longer one is cut first to the other's length; what remains is shared, b before a on a tie.
    first = F.least(over, F.abs(na - nb))
    rest = over - first
    cut_a = F.when(na > nb, first).otherwise(0) + F.floor(rest / 2)
    cut_b = F.when(nb > na, first).otherwise(0) + F.ceil(rest / 2)
    return F.struct(F.slice(a, F.lit(1), (na - cut_a).cast("int")).alias("a"), F.slice(b, F.lit(1), (nb - cut_b).cast("int")).alias("b"))
