"""Per-document text statistics that tell prose from lists, tables and junk.

What is common and what looks like language is learned from the corpus itself: words that most documents of a language
share, and letter sequences of words that several documents have.  A text is read in segments (a line, or a sentence
where a line holds several); more than three equal characters in a row count as three.  Every count belongs to one segment, so counts of chunks add up; a chunk keeps the text of
its first and last, unfinished segments as boundary state, which is measured once a neighbour completes it, and chunks
merge as a tree.  Ratios and rules come last.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.session import stage

CHUNK = 1 << 20
FAN = 16
GRAM_BITS, CONTEXT_BITS = 18, 15
ALPHABET, WORST = 30, -4.0  # letters a script is taken to have, floor of a letter's evidence
DOUBT, DOUBT_SHARE = 20.0, 2e-4  # weight of not knowing: so many letters, or that share of all

# Scripts written without blanks, whose characters count as words.
UNSPACED = "⺀-〿぀-ヿ㄀-ㄯ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿\U00020000-\U0003ffff"
TERMINALS = ".!?。！？।۔"

_WORD = re.compile(rf"[{UNSPACED}]|[^\W\d_{UNSPACED}]+")
_UNSPACED = re.compile(rf"[{UNSPACED}]")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_CELL = re.compile(r"[^|,;]+")
_NUMERIC = re.compile(r"[<>±~]?[+-]?\d+(?:[.:]\d+)*%?|n\.d\.|-+")
_HEX = re.compile(r"[0-9a-f]{2}|[0-9a-f]{8}:?")
_CODE = re.compile(r"[A-HY]\d\d[A-Z](?:\d{1,4}/\d{2,6})?|\d{1,4}/\d{2,6}|\d{1,4}/|/")
_INVISIBLE = re.compile("[​﻿]+")
_RUN = re.compile(r"(.)\1{3,}")
_CLOSING = "\"'”’»)]"
_BOUNDARY = re.compile(rf"\n|[{TERMINALS}][^\S\n]+(?=\S)")


# What the corpus teaches


def _bucket(text: str, bits: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) >> (32 - bits)


@dataclass
class Language:
    """Words that hold texts together, and counts of letter triples and of the pairs they begin with, by bucket."""

    common: frozenset[str]
    grams: np.ndarray
    contexts: np.ndarray

    def __post_init__(self) -> None:
        self.doubt = max(DOUBT, DOUBT_SHARE * float(self.contexts.sum()))
        spelled = [w for w in self.common if len(w) > 1]
        #: Evidence a letter of the common words: what the corpus knows of spelling, 0 for a corpus too small to know any.
        self.typical = max(0.0, sum(map(self.evidence, spelled)) / max(1, sum(map(len, spelled))))

    def evidence(self, word: str) -> float:
        """Sum over the letters of log P(letter | two before) - log P(any letter): below 0 for noise, near 0 where the corpus knows no such letters."""
        w, total = f"^{word}$", 0.0
        for i in range(len(w) - 2):
            n, of = self.grams[_bucket(w[i : i + 3], GRAM_BITS)], self.contexts[_bucket(w[i : i + 2], CONTEXT_BITS)]
            total += max(WORST, math.log((n + self.doubt / ALPHABET) / (of + self.doubt) * ALPHABET))
        return total


def _words_of_token(token: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(token))


class _Memo(dict):
    """What is known of tokens seen before, up to a number of them."""

    def __init__(self, find, most: int = 200_000) -> None:
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) > self.most:
            self.clear()
        value = self[key] = self.find(key)
        return value


def word_documents(df: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """(lang, word, n): texts of each language label that have the word; the word '' counts the label's texts. All rows are read."""
    lang = F.regexp_extract(F.lower(F.trim(F.col(lang_col).cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1) if lang_col else F.lit("")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts, size = _Memo(_words_of_token), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, c in counts.items():
                keys = list(c)
                for lo in range(0, len(keys), 50_000):
                    some = keys[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array([c[k] for k in some], pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(chain.from_iterable(map(memo.__getitem__, set(text.lower().split()))))
                words.add("")
                c = counts.setdefault(name, Counter())
                c.update(words)
            size += b.num_rows
            if sum(map(len, counts.values())) > 1_000_000:
                yield from flush()
        yield from flush()

    texts = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND trim(text) <> ''")
    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text_col: str = "text", lang_col: str | None = None, share: float = 0.4) -> Language:
    """The language model of a corpus, from every text.

    A word is common where at least ``share`` of a language's texts have it, with a margin of two standard deviations
    that few texts don't reach.  The shares of a language's words add up to the words of its average text, so the driver
    gets at most that many / ``share`` words a language, and one count a bucket of letter triples, whatever the size of the corpus.
    Letter triples come from words that two texts or more have.
    """
    words = stage(word_documents(df, text_col, lang_col))
    sizes = words.filter("word = ''").select("lang", F.col("n").alias("texts"))
    enough = F.col("n") - 2 * F.sqrt("n") >= share * F.col("texts")
    common = [r.word for r in words.filter("word <> ''").join(F.broadcast(sizes), "lang").filter(enough).select("word").distinct().collect()]  # one row a language is broadcast

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, contexts = np.zeros(1 << GRAM_BITS, np.int64), np.zeros(1 << CONTEXT_BITS, np.int64)
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = f"^{word}$"
                for i in range(len(w) - 2):
                    grams[_bucket(w[i : i + 3], GRAM_BITS)] += n
                    contexts[_bucket(w[i : i + 2], CONTEXT_BITS)] += n
        for kind, c in enumerate((grams, contexts)):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], names=["kind", "bucket", "n"])

    spelled = words.filter(rf"word <> '' AND NOT word rlike '[{UNSPACED}]'").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    buckets = spelled.mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()  # at most 2^18 + 2^15 rows
    grams, contexts = np.zeros(1 << GRAM_BITS), np.zeros(1 << CONTEXT_BITS)
    for kind, bucket, n in buckets:
        (contexts if kind else grams)[bucket] = n
    return Language(frozenset(common), grams, contexts)


# Measures

COUNTS = ["chars", "words", "letters", "symbols", "common", "natural", "evidence", "cells", "numeric", "hex", "code_chars", "terminals", "separators", "prose_chars", "lines", "ended_lines"]
_FACTS = 13  # the first of COUNTS belong to single tokens
NATURAL = 0.3  # share of the typical evidence a letter from which a word looks like language
EVIDENCE_UNIT = 64  # evidence is summed in whole parts, so that sums are the same in any order


class Measure:
    """Counts of texts; facts of tokens are kept in a table as long as there is room."""

    def __init__(self, language: Language, share: float = 0.12, most: int = 300_000) -> None:
        self.language, self.share, self.most = language, share, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 14, _FACTS + 2), np.int64)
        self.said: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        """(letters if the word looks like language, evidence)."""
        found = self.said.get(w)
        if found is None:
            e = self.language.evidence(w)
            found = self.said[w] = (len(w) if e >= NATURAL * self.language.typical * len(w) else 0, round(e * EVIDENCE_UNIT))
        return found

    def facts(self, token: str) -> list[int]:
        token = _RUN.sub(r"\1\1\1", token)
        low = token.lower()
        words = _WORD.findall(low)
        common = sum(w in self.language.common for w in words)
        natural = evidence = 0
        for w in words:
            if len(w) > 1 or not _UNSPACED.match(w):
                n, e = self.word(w)
                natural, evidence = natural + n, evidence + e
            else:
                natural += 1
        cells = _CELL.findall(token)
        numeric = sum(_NUMERIC.fullmatch(c) is not None for c in cells)
        hexes = sum(_HEX.fullmatch(c) is not None for c in cells)
        bare = token.strip(".,;:()[]")
        letters = len(_LETTER.findall(token))
        if (_DIGIT.search(bare) or letters < 0.6 * len(bare)) and not _UNSPACED.search(bare):  # letters among digits and marks are no words
            natural = common = 0
        code = len(token) if _CODE.fullmatch(bare) else 0
        terminals = sum(map(token.count, "。！？")) or int(letters > 0 and token.rstrip(_CLOSING)[-1:] in TERMINALS)
        last = token.rstrip(_CLOSING)[-1:]
        return [len(token), len(words), letters, len(_SYMBOL.findall(token)), common, natural, evidence, len(cells), numeric, hexes, code, terminals, int(token[-1] in ",;:、；："), int(token[-1] in TERMINALS), int(last != "" and last in TERMINALS + ",;:、；：")]

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in dict.fromkeys(tokens):
                if t not in known:
                    if len(known) >= len(self.table):
                        self.table = np.vstack([self.table, np.zeros_like(self.table)])
                    self.table[len(known)] = self.facts(t)
                    known[t] = len(known)
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, texts: list[str], whole: bool = True) -> np.ndarray:
        """(texts, COUNTS). ``whole``: a text's end ends its last line."""
        if len(self.known) > self.most or len(self.said) > self.most:
            self.clear()
        tokens: list[str] = []
        places, line_at, owners = [0], [], []  # token bounds of texts, of lines, and the lines' texts
        lines = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = _INVISIBLE.sub(" ", text).split("\n") if "​" in text or "﻿" in text else text.split("\n")
            lines[i] = len(parts) - 1 + (1 if whole and text and text[-1] != "\n" else 0)
            for part in parts:
                own = part.split()
                if own:
                    line_at.append(len(tokens))
                    tokens += own
                    owners.append(i if whole or part is not parts[-1] else -1)
            places.append(len(tokens))
        out = np.zeros((len(texts), len(COUNTS)), np.int64)
        out[:, 14] = lines
        if not tokens:
            return out
        rows = self.rows_of(tokens)
        facts = self.table[rows]
        starts = np.zeros(len(tokens), bool)
        starts[line_at] = True
        starts[1:] |= facts[:-1, _FACTS] > 0
        at = np.flatnonzero(starts)
        unit = np.add.reduceat(facts[:, [0, 1, 4]], at)
        prose = np.where((unit[:, 2] > 0) & (unit[:, 2] >= self.share * unit[:, 1]), unit[:, 0], 0)
        bounds = np.array(places)
        full = bounds[1:] > bounds[:-1]
        out[full, :_FACTS] = np.add.reduceat(facts[:, :_FACTS], bounds[:-1][full])
        text_of = np.searchsorted(bounds, at, "right") - 1
        np.add.at(out[:, 13], text_of, prose)
        ends = facts[np.r_[np.array(line_at[1:], np.int64), len(tokens)] - 1, _FACTS + 1]
        owner = np.array(owners)
        np.add.at(out[:, 15], owner[owner >= 0], ends[owner >= 0])
        return out


# Chunks


def chunk_state(text: str, measure: Measure) -> tuple[np.ndarray, str, str | None]:
    """(counts of the segments that lie whole inside, text before them, text after them or None if no boundary is inside)."""
    cuts = _BOUNDARY.search(text)
    if cuts is None:
        return np.zeros(len(COUNTS), np.int64), text, None
    first, last = cuts.end(), cuts.end()
    # The last boundary: looked for in ever longer ends of the text.
    reach = 4096
    while True:
        lo = max(first, len(text) - reach)
        found = [m.end() for m in _BOUNDARY.finditer(text, lo)]
        if found or lo == first:
            last = found[-1] if found else first
            break
        reach *= 8
    return measure([text[first:last]], whole=False)[0], text[:first], text[last:]


def merge_states(states: list[tuple[np.ndarray, str, str | None]], measure: Measure) -> tuple[np.ndarray, str, str | None]:
    """Neighbouring states, in order, as one."""
    total = np.zeros(len(COUNTS), np.int64)
    head: str | None = None
    tail: list[str] = []
    for counts, before, after in states:
        total += counts
        tail.append(before)
        if after is not None:
            if head is None:
                head = "".join(tail)
            else:
                total += measure(["".join(tail)], whole=False)[0]
            tail = [after]
    return (total, "".join(tail), None) if head is None else (total, head, "".join(tail))


def _close(state: tuple[np.ndarray, str, str | None], measure: Measure) -> np.ndarray:
    counts, head, tail = state
    if tail is None:
        return counts + measure([head])[0]
    return counts + measure([head], whole=False)[0] + measure([tail])[0]


def text_counts(df: DataFrame, language: Language, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, *COUNTS), one row for each distinct (id, text).

    Null and empty texts give a row of zeros.  Texts of up to ``chunk`` characters are measured where they lie.  Longer ones are
    cut, their pieces dealt out over the cluster, and the pieces' states merged ``FAN`` neighbours at a time, twice, then
    to the end; the result is that of the whole text.
    """
    shared = df.sparkSession.sparkContext.broadcast(language)
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    counted = ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                counts = measure([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]], names=["_id", "_key", *COUNTS])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                counts, head, tail = chunk_state(b.column(3)[k].as_py(), measure)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(k, 1) for c in range(3)] + [pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([head]), pa.array([tail], pa.string())], names=["_id", "_key", "_i", "counts", "head", "tail"])

    def states(p: pd.DataFrame) -> list[tuple[np.ndarray, str, str | None]]:
        p = p.sort_values("_i")
        return [(np.array(c, np.int64), h, t) for c, h, t in zip(p["counts"], p["head"], p["tail"])]

    def join(p: pd.DataFrame) -> pd.DataFrame:
        counts, head, tail = merge_states(states(p), Measure(shared.value))
        return pd.DataFrame({"_id": [p["_id"].iloc[0]], "_key": [p["_key"].iloc[0]], "_i": [int(p["_i"].min()) // FAN], "counts": [counts.tolist()], "head": [head], "tail": [tail]})

    def close(p: pd.DataFrame) -> pd.DataFrame:
        measure = Measure(shared.value)
        counts = _close(merge_states(states(p), measure), measure)
        return pd.DataFrame({"_id": [p["_id"].iloc[0]], "_key": [p["_key"].iloc[0]], **{c: [int(n)] for c, n in zip(COUNTS, counts)}})

    long = F.length("_text") > chunk
    short = spread(base.filter(~F.coalesce(long, F.lit(False))).select("_id", "_key", "_text")).mapInArrow(run, f"_id {kind}, _key long, {counted}")
    last = F.floor((F.length("_text") - 1) / chunk).cast("int")
    pieces = base.filter(long).select("_id", "_key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("_text", i * chunk + 1, F.lit(chunk)))).alias("_i", "piece"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = pieces.repartition(n, "_id", "_key", "_i").mapInArrow(cut, f"_id {kind}, _key long, _i int, counts array<long>, head string, tail string")
    level = level.dropDuplicates(["_id", "_key", "_i"])  # a repeated row is cut as often as it is there
    for _ in range(2):
        level = level.groupBy("_id", "_key", F.floor(F.col("_i") / FAN).alias("_g")).applyInPandas(lambda key, p: join(p), f"_id {kind}, _key long, _i int, counts array<long>, head string, tail string")
    merged = level.groupBy("_id", "_key").applyInPandas(lambda key, p: close(p), f"_id {kind}, _key long, {counted}")
    once = short.groupBy("_id", "_key").agg(*[F.max(c).alias(c) for c in COUNTS])  # equal rows have equal counts
    return once.unionByName(merged).select(F.col("_id").alias(id_col), *COUNTS)


def share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, language: Language | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct (id, text): its measures and kind (``prose``, ``list``, ``table``, ``junk``; null without text).

    A segment is prose where 12 in 100 of its words or more are common ones of the corpus (``language``, else learned from
    ``df``; ``lang_col`` names a language label, which may be missing or wrong).  A text is prose where half of its
    characters are in such segments, or where it is written in sentences of letters the corpus neither knows well nor takes for noise:
    a language it has too little of.  Of the rest, dumps of bytes are junk, mostly words that look like language or
    classification codes a list, numeric cells a table, and what is left is junk.
    """
    language = language or learn(df, text_col, lang_col)
    per_letter = F.col("evidence") / (EVIDENCE_UNIT * F.greatest(F.col("letters"), F.lit(1)))
    # A corpus in which no word is common knows no language well, so anything that isn't noise may be one.
    low, high = (-0.1 - 0.3 * language.typical, 0.1 + 0.4 * language.typical) if language.typical else (-0.5, math.inf)
    sentence = share("words", "terminals")
    foreign = (sentence >= 4) & (sentence <= 200) & (share("letters", "chars") >= 0.75) & (3 * (F.col("separators") + F.col("lines")) <= F.col("words") + 6) & (per_letter >= low) & (per_letter <= high)
    kind = (
        F.when(F.col("chars") == 0, F.lit(None))
        .when(share("prose_chars", "chars") >= 0.5, "prose")
        .when(foreign, "prose")
        .when(share("hex", "cells") >= 0.75, "junk")
        .when(share("code_chars", "chars") >= 0.4, "list")
        .when((F.col("natural") >= 0.65 * F.col("letters")) & (F.col("letters") >= 0.5 * F.col("chars")), "list")
        .when(share("numeric", "cells") >= 0.35, "table")
        .otherwise("junk")
    )
    return text_counts(df, language, id_col, text_col, chunk).select(
        F.col(id_col),
        F.col("words"),
        share("letters", "words").alias("mean_word_length"),
        share("symbols", "chars").alias("symbol_ratio"),
        F.col("lines"),
        share("ended_lines", "lines").alias("ended_line_share"),
        share("common", "words").alias("common_word_share"),
        share("prose_chars", "chars").alias("prose_share"),
        F.round(per_letter, 4).alias("letter_evidence"),
        share("numeric", "cells").alias("numeric_share"),
        share("hex", "cells").alias("hex_share"),
        share("letters", "chars").alias("letter_share"),
        share("natural", "letters").alias("natural_share"),
        F.least(share("code_chars", "chars"), F.lit(1.0)).alias("code_share"),
        kind.alias("kind"),
    )
