"""Defective instruction-response pairs: empty, refused, copied, in another language, or broken off.

Three models are trained on the data at hand: naive Bayes over character n-grams for the language of a text, naive Bayes
over words for sentences that decline, and the likelihood of a text's last words at the end of a text against anywhere in one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.llm.survivor import STAND_IN_WORDS

#: Labels a model may put before its answer, and words that alone are no answer.
LABELS = "abstract answer assistant classification code justification label note output question reply response result summary value dear user the".split()

#: Seeds. Answers that sound so and speak of themselves or to their reader train the model of declining sentences.
DECLINING = (
    r"\b(?:can(?:no|')?t|cannot|can not|could not|couldn't|won't|will not|would not|wouldn't|do not|don't|does not|must not|not able|not possible|not permit\w*|not allow\w*|not in a position|not appropriate|"
    r"inappropriate|unable|declin\w*|refus\w*|refrain\w*|rather not|outside (?:what|my)|beyond (?:what|my)|against my|apolog\w*|sorry|regret\w*|unfortunately|no (?:help|assistance|answer|comment)|impossible|prohibit\w*|forbid\w*|not comfortable)\b"
)
SPEAKING = r"\b(?:i|i'm|i'd|i've|i'll|me|my|mine|myself|you|your|we|our|us|language model|assistant|ai)\b"

_WORD = re.compile(r"[^\W_]+")
_LABEL = re.compile(r"^(?:\s*[\"'*#>-]*\s*(?:" + "|".join(LABELS[:-1]) + r"|dear user|dear reader|here is[^:\n]*)\s*[:,]\s*)+", re.I)
_HEAD = re.compile(r"^\s*classification\s*:[^\n]*(?:\n|$)\s*(?:justification\s*:)?\s*", re.I)
_NOTHING = frozenset(STAND_IN_WORDS) | frozenset(LABELS)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_CHAR_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
GRAM_BITS, END_BITS, WORD_BITS = 15, 15, 15
SEEDS = re.compile(DECLINING, re.I), re.compile(SPEAKING, re.I)


def body(output: str) -> str:
    """The answer without labels and without the head of a classification."""
    text = _HEAD.sub("", output, count=1)
    return _LABEL.sub("", text).strip()


def is_empty(output: str | None) -> bool:
    if output is None:
        return True
    text = _HEAD.sub("", output, count=1) if "\n" in output or _LABEL.match(output) else output
    words = _WORD.findall(text.lower())
    return all(w in _NOTHING for w in words)


def features(sentence: str) -> list[int]:
    """Buckets of the words and word pairs of a sentence, each once."""
    w = _WORD.findall(sentence.lower().replace("’", "'").replace("'", ""))
    return sorted({zlib.crc32(f.encode()) >> (32 - WORD_BITS) for f in (*w, *map(" ".join, zip(w, w[1:])))})


def sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.split(text) if _WORD.search(x)]


def foreign_share(sentence: str, known: set[str]) -> float:
    """The share of a sentence's words of four letters or more that don't stand in what was given; of all its words where it has none so long."""
    words = _WORD.findall(sentence.lower())
    words = [w for w in words if len(w) > 3] or words
    return sum(w not in known for w in words) / max(1, len(words))


class DecliningModel:
    """Naive Bayes over words and word pairs of sentences: declining against all others."""

    def __init__(self, declining: np.ndarray, other: np.ndarray) -> None:
        rate = lambda c: np.log((c + 0.1) / (c.sum() + 0.1 * len(c)))
        self.log = (rate(declining) - rate(other)).astype(np.float32)
        self.trained = bool(declining.sum())

    def declines(self, sentence: str) -> bool:
        """Whether the words of the sentence are clearly those of declining: by a nat a word or more."""
        f = features(sentence)
        return self.trained and bool(f) and float(self.log[f].sum()) > len(f) / 2 + 2

    def is_refusal(self, text: str, given: str) -> bool:
        """Whether half of the text or more, by length, declines in words that are mostly not those of what was given."""
        parts = sentences(text)
        said = [x for x in parts if self.declines(x)]
        if 2 * sum(map(len, said)) < sum(map(len, parts)) or not said:
            return False
        known = set(_WORD.findall(given.lower()))
        return 2 * sum(len(x) for x in said if foreign_share(x, known) >= 0.5) >= sum(map(len, parts))


def train_declining(pairs: DataFrame) -> DecliningModel:
    """From the sentences of every (input, output).

    An answer with a sentence that fits the seeds, in words of its own, gives its foreign sentences as declining ones; all
    other answers' sentences, and those in the words of what was given, are the others.  The driver gets two counts a bucket of words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << WORD_BITS), np.int64)
        for b in batches:
            for given, output in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seeded = SEEDS[0].search(output.replace("’", "'")) is not None
                if not seeded:
                    counts[1, features(output)] += 1
                    continue
                known = set(_WORD.findall((given or "").lower()))
                parts = [(x, foreign_share(x, known) >= 0.5) for x in sentences(body(output))]
                seeded = any(own and all(r.search(x.replace("’", "'")) for r in SEEDS) for x, own in parts)
                for x, own in parts:
                    counts[0 if seeded and own else 1, features(x)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["key", "declining", "other"])

    rows = pairs.select("input", "output").filter("output IS NOT NULL").mapInArrow(run, "key int, declining long, other long").groupBy("key").agg(F.sum("declining"), F.sum("other")).collect()  # at most 2^WORD_BITS rows
    counts = np.zeros((2, 1 << WORD_BITS))
    for k, d, o in rows:
        counts[:, k] = d, o
    return DecliningModel(*counts)


def shingles(text: str, n: int = 3) -> set[tuple[str, ...]]:
    """Word triples; an ideograph or syllable counts as a word."""
    words = (_WORD if text.isascii() else _CHAR_WORD).findall(text.lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def is_copy(task: str, text: str, question: str, given: str) -> bool:
    """Most word triples of the answer stand in what was given; for questions on a text, only all of the text or the question itself."""
    own = shingles(text)
    if not own:
        return False
    asked = shingles(question)
    if asked and len(own & asked) >= 0.75 * len(own) and len(own & asked) >= 0.75 * len(asked) and len(asked) > 1:
        return True
    source = shingles(given)
    inside = len(own & source)
    if task == "mrc":
        return len(source) > 8 and inside >= 0.75 * len(own) and inside >= 0.75 * len(source)
    return len(own) > 3 and inside >= 0.6 * len(own)


def gram_codes(text: str) -> np.ndarray:
    """Buckets of the character 1- to 4-grams of a text's letters, in lower case, other characters as blanks."""
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    code = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(4):
        if len(code) <= n:
            break
        h = (h[: len(code) - n] * np.uint64(0x9E3779B1) + code[n:] + np.uint64(1)) & np.uint64(0xFFFFFFFF)
        out.append(((h * np.uint64(0x85EBCA6B + 2 * n)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - GRAM_BITS))
    return np.concatenate(out).astype(np.int64)


class LanguageModel:
    """Multinomial naive Bayes; ``scores`` gives mean log-likelihoods per n-gram, comparable between languages."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        smooth = counts + 0.05
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, text: str) -> np.ndarray:
        return self.log[:, gram_codes(text)].mean(axis=1)

    def differ(self, one: str, two: str, margin: float = 0.25, odds: float = 12.0) -> bool:
        """Whether each text is clearly more likely in a language that isn't the other's: by ``margin`` an n-gram and e^``odds`` in all."""
        g, h = gram_codes(one), gram_codes(two)
        a, b = self.log[:, g].mean(axis=1), self.log[:, h].mean(axis=1)
        i, j = int(a.argmax()), int(b.argmax())
        if i == j or UNTOLD in (self.names[i], self.names[j]):
            return False
        return a[i] - a[j] > max(margin, odds / len(g)) and b[j] - b[i] > max(margin, odds / len(h))


UNTOLD = "und"


def train_languages(labelled: DataFrame, per_language: int = 1500, least: int = 20) -> LanguageModel:
    """From (text, lang): about ``per_language`` texts a language, chosen by their hash where they lie (the documented bound of the fit).

    lang counts by its primary subtag; equal texts count once; languages of fewer than ``least`` texts are one, ``und``, of which no
    text can be told to be in another.  Counts are summed by Spark; the driver gets one row per language and n-gram bucket.
    """
    lang = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    usable = labelled.filter("text IS NOT NULL AND length(trim(text)) >= 40").select(lang.alias("lang"), "text").filter("lang <> ''")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageModel(["und"], np.zeros((1, 1 << GRAM_BITS)))
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    some = usable.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part[F.col("lang")].cast("double") * (1 << 30)).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = total.setdefault(name, np.zeros(1 << GRAM_BITS, np.int64))
                t += np.bincount(gram_codes(text), minlength=1 << GRAM_BITS)
                n[name] = n.get(name, 0) + 1
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n[name], t[at]], pa.int64())], names=["lang", "gram", "n"])

    rows = some.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    few = set(rows.lang[(rows.gram == -1) & (rows.n < least)])
    rows["lang"] = [UNTOLD if x in few else x for x in rows.lang]
    names = sorted(set(rows.lang)) or [UNTOLD]
    counts = np.zeros((len(names), 1 << GRAM_BITS))
    for i, name in enumerate(names):
        own = rows[(rows.lang == name) & (rows.gram >= 0)]
        np.add.at(counts[i], own.gram.to_numpy(), own.n.to_numpy())
    return LanguageModel(names, counts)


KINDS = ("abstract_drafting", "ipc_reasoning", "mrc", "other")
_TRAILING = re.compile(r"[\"'”’»)\]*\s\u200b\ufeff]+$")
CLASSES = len(KINDS) * 3


def mark_class(kind: str, word: str) -> int:
    """The kind of answer and what its last word ends in: a closing mark, another mark, or none."""
    last = _TRAILING.sub("", word)[-1:]
    return KINDS.index(kind) * 3 + (0 if last in ".!?。！？" and last else 1 if last in ",;:-‐‑–—" and last else 2)


def ending(kind: str, words: list[str], i: int) -> int:
    """Bucket of the two words that end at i in an answer of a kind: digits as 9, words of four letters or more by their last mark."""

    def shape(w: str) -> str:
        w = re.sub(r"\d+", "9", w.lower())
        bare = w.rstrip(".,;:!?)\"'")
        return w if len(bare) <= 3 else "~" + w[len(bare) :]

    return zlib.crc32(f"{kind} {shape(words[i - 1]) if i else '^'} {shape(words[i])}".encode()) >> (32 - END_BITS)


class EndModel:
    """How likely an answer ends where it does, by its last two words; where these are seldom, by the mark they end in."""

    def __init__(self, end: np.ndarray, anywhere: np.ndarray) -> None:
        self.end, self.anywhere = end, anywhere  # buckets, then classes

    def score(self, kind: str, text: str, weight: float = 2e-3) -> float:
        """log P(end | last two words) - log P(end | closing mark) in answers of a kind, the text's own counts left out.

        P(end | last two words) is backed off to P(end | mark) with the ``weight`` of that share of the kind's words, so two words
        that hardly stand anywhere but at the ends of broken-off answers don't count as an end.
        """
        words = text.split()
        if not words:
            return -math.inf
        k, c, first = ending(kind, words, len(words) - 1), (1 << END_BITS) + mark_class(kind, words[-1]), (1 << END_BITS) + KINDS.index(kind) * 3
        rate = lambda m, own: (max(0.0, self.end[m] - own) + 1e-3) / (max(0.0, self.anywhere[m] - own) + 1)
        w = 1 + weight * self.anywhere[first : first + 3].sum()
        p = (max(0.0, self.end[k] - 1) + w * rate(c, 1)) / (max(0.0, self.anywhere[k] - max(1, text.count(" ".join(words[-2:])))) + w)
        return math.log(p) - math.log(rate(first, c == first))


def kind_of(task: str | None, question: str | None) -> str:
    kind = (task or "").strip().lower()
    return kind if kind in KINDS else "mrc" if not kind and (question or "").rstrip().endswith("?") else "other"


def train_endings(pairs: DataFrame) -> EndModel:
    """From every answer: how often two words, and words with a mark, stand at an end and anywhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << END_BITS) + CLASSES
        end, anywhere = np.zeros(size, np.int64), np.zeros(size, np.int64)
        seen: dict[tuple[str, str, str], tuple[int, int]] = {}
        for b in batches:
            for task, question, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                words, kind, keys = text.split(), kind_of(task, question), []
                for i, w in enumerate(words):
                    pair = (kind, words[i - 1] if i else "", w)
                    key = seen.get(pair)
                    if key is None:
                        if len(seen) > 300_000:
                            seen.clear()
                        key = seen[pair] = (ending(kind, words, i), (1 << END_BITS) + mark_class(kind, w))
                    keys.append(key)
                if keys:
                    np.add.at(anywhere, np.array(keys).ravel(), 1)
                    end[list(keys[-1])] += 1
        at = np.flatnonzero(anywhere)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(end[at]), pa.array(anywhere[at])], names=["key", "end", "anywhere"])

    texts = pairs.select("task", "instruction", "output").filter("output IS NOT NULL")
    rows = texts.mapInArrow(run, "key int, end long, anywhere long").groupBy("key").agg(F.sum("end"), F.sum("anywhere")).collect()  # at most 2^END_BITS + CLASSES rows
    end, anywhere = np.zeros((1 << END_BITS) + CLASSES), np.zeros((1 << END_BITS) + CLASSES)
    for k, e, n in rows:
        end[k], anywhere[k] = e, n
    return EndModel(end, anywhere)


def is_truncated(kind: str, text: str, given: str, endings: EndModel, least: float = -2.5, phrase: float = -1.6) -> bool:
    """Whether answers of this kind hardly ever end so: a score under ``least``, twice that where a closing mark speaks for an end.

    An answer to a question on a text may be a bare phrase: without a closing mark it is whole where its last words end a
    sentence or clause of the text asked about, or where its score is ``phrase`` or more.
    """
    words = text.split()
    closed = bool(words) and mark_class(kind, words[-1]) % 3 == 0
    likely = endings.score(kind, text)
    if kind != "mrc" or closed:
        return likely < (2 * least if closed else least)
    last = " ".join(words[-2:]).lower()
    known = set(_WORD.findall(given.lower()))  # only bare phrases get here
    cut = _WORD.findall(words[-1].lower())[-1:]
    if cut and cut[0] not in known and any(w.startswith(cut[0]) for w in known):  # inside a word
        return True
    return mark_class(kind, words[-1]) % 3 == 1 or not re.search(re.escape(last) + r"\s*(?:[.;,]|$)", given.lower()) and likely < phrase


def defect(task: str | None, question: str | None, given: str | None, output: str | None, languages: LanguageModel, declining: DecliningModel, endings: EndModel) -> str | None:
    """The first that applies of empty, refusal, copy, language, truncated."""
    if is_empty(output):
        return "empty"
    kind = kind_of(task, question)
    question, given = question or "", given or ""
    text = body(output)
    if not text:
        return "empty"
    if declining.is_refusal(text, given):
        return "refusal"
    if is_copy(kind, text, question, given):
        return "copy"
    if languages.differ(text, given):
        return "language"
    if is_truncated(kind, output, given, endings):
        return "truncated"
    return None


def broken_pairs(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(row_id, defect) of the defective rows of (row_id, task, instruction, input, output).

    ``labelled`` (text, lang) trains the languages.  A null or blank output is ``empty``; null instruction, input or
    task leave out the checks that need them; a row gets one defect, in the order empty, refusal, copy, language,
    truncated; repeated rows are judged alike.  Three small aggregations train the models, the verdict is map-only.
    """
    sc = pairs.sparkSession.sparkContext
    models = sc.broadcast((train_languages(labelled), train_declining(pairs), train_endings(pairs)))  # all of fixed size
    rows = pairs.select("row_id", "task", "instruction", "input", "output")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, d) for i, r in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)))) if (d := defect(*r, *models.value))]
            if found:
                at, kinds = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(kinds)], names=["row_id", "defect"])

    return spread(rows).mapInArrow(run, f"row_id {pairs.schema['row_id'].dataType.simpleString()}, defect string")
