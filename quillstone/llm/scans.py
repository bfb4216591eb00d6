"""Noise of scanned pages: words broken by hyphens, misread characters, running headers and page numbers.

A page is read as a stream: lines that are no text are set aside and the rest is joined.  Every stretch of it between two
marks that has something the lexicon doesn't know, or a word broken by a hyphen, is decoded as one lattice over its
characters: an edge is a word as written or with misread characters, it may go across blanks, line breaks and hyphens that
don't belong there and end where a blank lacks, all at once; the cheapest path is taken.  Words that are known as written
are taken apart or joined only together with some that aren't.  The lexicon is a table that is never collected: stretches
and words meet by a key that is the same for a word and every misreading of it.  Paragraphs (claims) are cut by dynamic
programming over numbered starts.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.session import stage

#: What scanning makes of characters (left) and what they were (right).
CONFUSIONS = {
    "rn": "m", "vv": "w", "cl": "d", "li": "h", "ii": "u", "ri": "n", "b": "h", "c": "e", "1": "li", "0": "o", "5": "s", "9": "g", "6": "bh", "8": "b", "c1": "d", "1i": "hu", "i1": "u", "11": "u", "r1": "n", "rri": "m", "r11": "m",
    "3": "e", "4": "a", "7": "t", "2": "z", "l": "i", "i": "l", "|": "li", "!": "li", "$": "s", "@": "a", "nn": "m", "iii": "m", "lc": "k", "fi": "h", "tl": "d",
}
#: Letters that stand for digits in misread numbers.
DIGIT_LIKE = "OoQDlI|iSsZz"

HYPHENS = "-‐‑‒–­¬⁃−"
_BREAK = re.compile(r"\r\n|[\n\r\f\v\u0085  ]")
_PAGE = re.compile(rf"[-–—\[(~|*. ]*(?:p(?:age|g|\.)?\.?\s*)?[\d{DIGIT_LIKE}]{{0,3}}\d[\d{DIGIT_LIKE}]{{0,3}}(?:\s*(?:/|of)\s*[\d{DIGIT_LIKE}]{{1,4}})?[-–—\])~|* ]*", re.I)
_HEADING = re.compile(r"(?:the\s+)?(?:amended\s+)?claims?\s*[:.]?|what\s+(?:is|we|i)\s+claim(?:ed)?(?:\s+is)?\s*[:.]?|we\s+claim\s*:?|claims?\s+what\b.*", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:[|!$@][^\W_]+)*(?:'[^\W_]+)?")
_PIECE = r"[^\W_]+(?:[|!$@][^\W_]+)*"
_REFERENCE = re.compile(r"(?:[A-Z]{1,4}|[A-Z]{0,3}[\d/.-]*\d[\d/.-]*[A-Z]?\d?|[A-Z]\d+\.[A-Z]{2}|[A-Z]{2,4}/[A-Z]{2}\d+/\d+|[A-Z][a-z]*|ref\.?|of|no\.?|our|your|page|sheet|[-–|:]+)[,;:]?")
_OWNER = re.compile(r"(?:[A-Z][\w.,&'’]*\s+){1,7}[-–—]\s+[A-Z][a-z]*")
_NUMBERED = re.compile(r"(?<![\w/.-])(\d+)\s*\.\s+(?=[A-Z])")

_BLANKS = re.compile(r"[ \t\u00a0]{2,}|[\t\u00a0]")
_DIGIT = re.compile(r"\d")
_UPPER, _LOWER = re.compile("[A-Z]"), re.compile("[a-z]")
_JOINT = rf"[{HYPHENS}]\n"
_SOFT = re.compile("([^\\W\\d_]+)\u00ad\n(?=([^\\W\\d_]))")
_WORD = re.compile(_PIECE)
_HYPHENS = frozenset(HYPHENS)
_LAST = re.compile(rf"({_PIECE})[{HYPHENS}]$")
_RUN = re.compile(rf"(?<![^\W_]')(?<![^\W_]){_PIECE}(?:(?:[ \n]|({_JOINT})){_PIECE})*")
_LETTERS_AT_END = re.compile(r"[^\W\d_]+$")
_MARK = re.compile(r"[A-Z]\d{1,4}[a-z]?|\d{1,4}[a-z]|[a-z]\d")
_TO_DIGITS = str.maketrans("OoQDlI|iSsZz", "000011115522")

KINDS = ["hyphen", "misread", "header", "page_no"]


#: Costs of readings, in nats next to -log P(word): a confusion, an unknown word and each of its letters, a blank that doesn't belong, one that is missing, a hyphen at a line's end that is a word's own.
CONFUSED, UNKNOWN, UNKNOWN_LETTER, MERGED, SPLIT, KEPT = 3.5, 18.0, 1.5, 8.0, 12.0, 12.0
KEY_BITS = 22  # the least cost of a word by hash of its key: 4 MB, however many words there are


def unknown_cost(word: str) -> float:
    return UNKNOWN + UNKNOWN_LETTER * len(word)


class Lexicon:
    """Words with their counts out of ``total``; finds what a misread word was."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        self.counts = counts
        self.words = sorted(counts)
        self.total = total or sum(counts.values()) or 1
        self.longest = max(map(len, CONFUSIONS))

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return math.log(self.total / n) if n else unknown_cost(word)

    def _starts(self, prefix: str) -> bool:
        i = bisect.bisect_left(self.words, prefix)
        return i < len(self.words) and self.words[i].startswith(prefix)

    def correct(self, word: str) -> tuple[str, int] | None:
        """The known word that ``word`` is a misreading of with fewest confusions, then most frequent, and their number.

        Left to right over the characters; only beginnings of known words are kept, and no more confusions than an
        unknown word would be cheaper than.
        """
        most = int(unknown_cost(word) / CONFUSED)
        ends: list[dict[str, int]] = [{} for _ in range(len(word) + 1)]
        ends[0][""] = 0
        for i in range(len(word)):
            for read, edits in ends[i].items():
                steps = [(1, word[i], edits)]
                if edits < most:
                    for n in range(1, self.longest + 1):
                        for was in CONFUSIONS.get(word[i : i + n], "") if i + n <= len(word) else "":
                            steps.append((n, was, edits + 1))
                for n, char, e in steps:
                    longer = read + char
                    if e < ends[i + n].get(longer, most + 1) and self._starts(longer):
                        ends[i + n][longer] = e
        whole = [(e, -self.counts[w], w) for w, e in ends[-1].items() if e and w in self.counts]
        return (min(whole)[2], min(whole)[0]) if whole else None

    def read(self, word: str) -> tuple[str, int, int] | None:
        """(what it says, confusions, count): itself where it is known, else the known word it is a misreading of, where that is cheaper than not knowing it."""
        if word in self.counts:
            return word, 0, self.counts[word]
        found = self.correct(word)
        if found is None or self.cost(found[0]) + CONFUSED * found[1] >= unknown_cost(word):
            return None
        return found[0], found[1], self.counts[found[0]]


# A word and each of its misreadings have one key: characters that scanning mixes up count as one, and so do runs of them.
_STROKES, _OPEN = "il1|!hbunrmf68", "cet37"
_ALIKE = str.maketrans({**dict.fromkeys(_STROKES, "i"), **dict.fromkeys(_OPEN, "e"), "0": "o", "5": "s", "$": "s", "9": "g", "4": "a", "@": "a", "2": "z", "d": "ei", "k": "ie", "w": "vv"})
_STROKE_RUN = re.compile("i+")


def reading_key(word: str) -> str:
    return _STROKE_RUN.sub("i", word.translate(_ALIKE))


def _key_column(word: Column) -> Column:
    """reading_key as a column."""
    single = {**dict.fromkeys(_STROKES, "i"), **dict.fromkeys(_OPEN, "e"), "0": "o", "5": "s", "$": "s", "9": "g", "4": "a", "@": "a", "2": "z"}
    plain = F.translate(word, "".join(single), "".join(single.values()))
    for char, said in (("d", "ei"), ("k", "ie"), ("w", "vv")):
        plain = F.replace(plain, F.lit(char), F.lit(said))
    return F.regexp_replace(plain, "i+", "i")


def misread_number(token: str) -> bool:
    """Digits mixed with letters that look like digits, and nothing else."""
    return any(map(str.isdigit, token)) and not token.isdigit() and all(c.isdigit() or c in DIGIT_LIKE for c in token) and not re.fullmatch(r"\d+(?:s|i|D|Q|z|Z)", token)


def split_lines(text: str) -> list[str]:
    return [line.strip() for line in _BREAK.split(_BLANKS.sub(" ", text))]


def kinds_of_lines(lines: list[str]) -> list[str]:
    """``blank``, ``page_no``, ``header``, ``heading`` or ``text`` for each line."""
    whole = "".join(lines)
    upper, lower = len(_UPPER.findall(whole)), len(_LOWER.findall(whole))
    shouting = upper > 1.5 * lower
    out = []
    for k, line in enumerate(lines):
        if not line:
            out.append("blank")
        elif _PAGE.fullmatch(line) and not line.endswith("."):
            out.append("page_no")
        elif _HEADING.fullmatch(line):
            out.append("heading")
        elif is_header(line, shouting):
            out.append("header")
        else:
            out.append("text")
    return out


def is_header(line: str, shouting: bool) -> bool:
    """References only, a title in capitals, or an owner and a title; never the end of a sentence or words that go on."""
    if " - " in line or " – " in line or " — " in line:
        if _OWNER.match(line) and not re.match(r"[A-Z][a-z]?\s", line):
            return True
    if line[-1] in ".;,:" or re.match(r"\d{1,3}\s*\.\s", line):
        return False
    small = len(_LOWER.findall(line))
    if not _DIGIT.search(line) and small > 0.1 * len(line):
        return False
    letters = [c for c in line if c.isalpha()]
    lower = sum(map(str.islower, letters))
    if not shouting and len(letters) >= 6 and lower <= 0.1 * len(letters) and len([w for w in _TOKEN.findall(line) if w.isalpha()]) >= 2:
        return True
    parts = line.split(" ")
    if len(parts) < 2 or not any(map(str.isdigit, line)):
        return False
    if not all(_REFERENCE.fullmatch(p) for p in parts):
        return False
    return line[0].isupper() or line[0].isdigit() and len([p for p in parts if any(map(str.isdigit, p))]) > 1 and all(len(p) > 4 for p in parts)


Reading = tuple[str, int, int]  # what a stretch says, confusions, count


def _cost(text: str, reading: Reading | None, total: int) -> float:
    return unknown_cost(text) if reading is None else math.log(total / reading[2]) + CONFUSED * reading[1]


def is_number(token: str) -> bool:
    """Whether a token with digits is read as a number or a mark whatever the lexicon says."""
    digits = sum(map(str.isdigit, token))
    return bool(digits) and (not misread_number(token) and _MARK.fullmatch(token) is not None or misread_number(token) and (digits > len(token) / 2 or len(token) < 3))


def mended_number(token: str, readings: Callable[[str], Reading | None]) -> str | None:
    """A number or mark as it was before misreading; None for a word."""
    if token.isdigit():
        return token
    if _DIGIT.search(token) and misread_number(token) and (is_number(token) or not readings(token.lower())):
        return token.translate(_TO_DIGITS)
    return token if is_number(token) else None


def page_stream(text: str | None) -> tuple[list[str], str]:
    """(kinds of lines set aside, the lines of text, one after the other)."""
    if not text or not text.strip():
        return [], ""
    lines = split_lines(text)
    kinds = kinds_of_lines(lines)
    return [k for k in ("header", "page_no") if k in kinds], "\n".join(line for line, k in zip(lines, kinds) if k == "text")


BLANK, HYPHEN, LOOSE = range(3)  # joints: a blank or line break; a hyphen at a line's end between letters; one that touches another character


def joint(left: str, gap: str, right: str) -> int | None:
    """What joins two words; None where nothing may go across: a mark, or a capital after a small letter, which begins a word."""
    if len(gap) == 1:
        return None if right[0].isupper() and left[-1].islower() else BLANK
    end = _LETTERS_AT_END.search(left)
    if right[0].islower() or end and end[0].isupper():
        return HYPHEN if end and right[0].isalpha() else LOOSE
    return LOOSE if right[0].isdigit() and end else None


def lowered(word: str) -> str:
    """In lower case, of the same length."""
    low = word.lower()
    return low if len(low) == len(word) else "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


Edge = tuple[float, Reading | None, bool, float]


class Known:
    """What is known of the strings of a page: the readings got for it, and the frequent words with their counts."""

    def __init__(self, readings: dict[str, Reading], frequent: dict[str, int], total: int, floor: list[float]) -> None:
        self.readings, self.frequent, self.total, self.floor = readings, frequent, total, floor

    def __call__(self, s: str) -> Reading | None:
        n = self.frequent.get(s)
        return (s, 0, n) if n else self.readings.get(s)

    def clean(self, s: str) -> bool:
        return s in self.frequent or s in self.readings and not self.readings[s][1]


def restored(word: str, reading: Reading | None) -> str:
    return word if not reading or not reading[1] else reading[0].capitalize() if word[0].isupper() else reading[0]


class Stretch:
    """Words joined by blanks, line breaks or hyphens at a line's end: a lattice over their characters.

    ``cost``: of each word as written, or as the known word it is a misreading of.  ``open``: words that aren't known as written.
    """

    def __init__(self, at: int, words: list[str], gaps: list[str], joints: list[int]) -> None:
        self.at, self.words, self.gaps, self.joints = at, words, gaps, joints
        self.raw = "".join(words)
        self.text = lowered(self.raw)
        self.ends = list(itertools.accumulate(map(len, words)))
        self.starts = [0, *self.ends[:-1]]

    def broken(self, longest: int) -> Iterator[tuple[int, int]]:
        """First and last word of what hyphens at line ends may have broken, as far as the lexicon can have it."""
        for a in range(len(self.joints)):
            for b in range(a, len(self.joints)):
                if self.joints[b] == BLANK or self.ends[b + 1] - self.starts[a] > longest:
                    break
                yield a, b + 1

    def string(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.ends[b]]

    def read(self, known: Known) -> bool:
        """Price the words as they stand; whether anything is to decode."""
        found = [known(self.string(i, i)) for i in range(len(self.words))]
        self.clean = [r is not None and not r[1] for r in found]
        self.cost = [_cost(w, r, known.total) for w, r in zip(self.words, found)]
        self.open = [not c for c in self.clean]
        for a, b in self.broken(len(known.floor)):
            whole = known(self.string(a, b))
            if whole and not whole[1]:
                self.open[a : b + 1] = [False] * (b + 1 - a)
        return any(r and r[1] for r in found) or any(self.open) or any(j != BLANK for j in self.joints)

    def spans(self, floor: list[float]) -> Iterator[tuple[int, int, int, int, float]]:
        """(start, end, first word, last word, what it may cost) of the edges, other than words as they stand, that a cheapest path may take.

        Left out is only what can't be cheaper than the words as they stand, were its words as cheap as the cheapest of their
        length (``floor``): cuts and crossings have their price, and what is changed in one go has a word that isn't known.
        """
        n = len(self.words)
        if not any(self.open):
            return
        least, beyond = min(floor), len(floor) - 1
        cost, cross = self.cost, [MERGED if j == BLANK else -KEPT for j in self.joints]
        left, right = [0.0] * n, [0.0] * n  # the most that going on to the words before and after can save
        for i in range(1, n):
            left[i] = max(0.0, left[i - 1] + cost[i - 1] - cross[i - 1])
        for i in range(n - 2, -1, -1):
            right[i] = max(0.0, right[i + 1] + cost[i + 1] - cross[i])
        reach = [False] * n
        for order, before, after, step in ((range(n), left, right, 1), (range(n - 1, -1, -1), right, left, -1)):
            saved = -math.inf
            for k, i in enumerate(order):
                if k:
                    saved += cost[i] - cross[min(i, i - step)]
                if self.open[i]:
                    saved = max(saved, cost[i] + before[i])
                reach[i] |= saved + after[i] > least
        cut = SPLIT + least
        for a in range(n):
            if not reach[a]:
                continue
            saved, opened = -least, False
            for b in range(a, n):
                saved += cost[b] - (cross[b - 1] if b > a else 0.0)
                opened |= self.open[b]
                if not reach[b] or saved + left[a] + right[b] <= 0 or self.starts[b] - self.ends[a] > beyond:
                    break
                start, end = self.starts[a], self.ends[b]
                firsts = range(start + 1, self.ends[a]) if saved - cut + left[a] > 0 else ()
                lasts = range(self.starts[b] + 1, end) if saved - cut + right[b] > 0 else ()
                if a < b and opened and saved + least > floor[min(end - start, beyond)]:
                    yield start, end, a, b, saved + least
                room = saved - SPLIT + left[a]
                for p in firsts:
                    if room > floor[min(end - p, beyond)]:
                        yield p, end, a, b, room
                room = saved - SPLIT + right[b]
                for q in lasts:
                    if room > floor[min(q - start, beyond)]:
                        yield start, q, a, b, room
                room = saved - 2 * cut + least + left[a] + right[b]
                if room > least:
                    for p in range(start + 1, self.ends[a]):
                        for q in range(max(p, self.starts[b]) + 1, min(end, p + beyond)):
                            if room > floor[q - p]:
                                yield p, q, a, b, room

    def edges(self, known: Known, least_cost: Callable[[str], float] | None) -> tuple[dict[int, dict[int, Edge]], int, int]:
        """By start and end: (cost, reading, whether a hyphen is dropped in it, the least it can cost for all that is known); without what isn't known; and the first word that may be other than as it stands, and the one after the last."""
        edges: dict[int, dict[int, Edge]] = {}

        def edge(p: int, q: int, a: int, b: int, reading: Reading | None, cost: float, least: float) -> None:
            inside = self.joints[a:b]
            extra = MERGED * inside.count(BLANK)
            if q < self.ends[b]:
                extra += SPLIT
            elif b < len(self.joints) and self.joints[b] != BLANK:
                extra += KEPT
            edges.setdefault(p, {})[q] = cost + extra, reading, len(inside) > inside.count(BLANK), least + extra

        touched = [i for i, j in enumerate(self.joints) if j != BLANK]
        first, stop = (touched[0], touched[-1] + 2) if touched else (len(self.words), 0)
        for p, q, a, b, room in self.spans(known.floor):
            s = self.text[p:q]
            reading = known(s)
            cost = _cost(s, reading, known.total) if reading else math.inf
            least = cost if reading or not least_cost else least_cost(s)
            if least < room:
                edge(p, q, a, b, reading, cost, least)
                first, stop = min(first, a), max(stop, b + 1)
        for a, b in self.broken(len(known.floor)):
            s = self.string(a, b)
            if reading := known(s):
                edge(self.starts[a], self.ends[b], a, b, reading, _cost(s, reading, known.total), _cost(s, reading, known.total))
        for i in range(first, stop):
            edge(self.starts[i], self.ends[i], i, i, known(self.string(i, i)), self.cost[i], self.cost[i])
        return edges, min(first, stop), stop

    def decode(self, known: Known, least_cost: Callable[[str], float] | None) -> tuple[set[str], str, set[str]]:
        """(kinds of noise, what the cheapest path says, strings whose reading may make another one cheaper)."""
        edges, first, stop = self.edges(known, least_cost)
        begin, end = (self.starts[first], self.ends[stop - 1]) if stop else (0, 0)
        none: dict[int, Edge] = {}
        best: list[tuple[float, int, Reading | None, bool]] = [(math.inf, 0, None, False)] * (end + 1)
        least = [math.inf] * (end + 1)
        best[begin], least[begin] = (0.0, begin, None, False), 0.0
        ends = [KEPT if j != BLANK else 0.0 for j in self.joints] + [0.0]
        asked = False
        # An unknown word that hyphens broke goes on from word to word: its cost if all its parts are known, which keep the hyphen, and if one isn't.
        whole, low_whole = [(math.inf, 0)] * 2, [math.inf] * 2
        for i in range(first, stop):
            start, close = self.starts[i], self.ends[i]
            more, low_more = [(math.inf, 0)] * 2, [math.inf] * 2
            letters = UNKNOWN_LETTER * (close - start)
            on = i > first and self.joints[i - 1] == HYPHEN
            for k in range(2) if on else ():
                to = 1 if not self.clean[i] else k
                more[to] = min(more[to], (whole[k][0] + KEPT + letters, whole[k][1]))
                low_more[to] = min(low_more[to], low_whole[k] + KEPT + letters)
            if more[1][0] + ends[i] < best[close][0]:
                best[close] = more[1][0] + ends[i], more[1][1], None, True
            least[close] = min(least[close], low_more[1] + ends[i])
            to = int(not self.clean[i])
            whole = list(more)
            whole[to] = min(whole[to], (best[start][0] + UNKNOWN + letters, start))
            low_whole = list(low_more)
            low_whole[to] = min(low_whole[to], least[start] + UNKNOWN + letters)
            part, since, low_part = math.inf, start, math.inf  # the cheapest part of the word, not known, that goes on from p
            for p in range(start, close) if self.open[i] else (p for p in range(start, close) if p in edges):
                here = best[p][0]
                for q, (cost, reading, broken, low) in edges.get(p, none).items():
                    if here + cost < best[q][0]:
                        best[q] = here + cost, p, reading, broken
                    if least[p] + low < least[q]:
                        least[q] = least[p] + low
                    asked |= low < cost
                if self.open[i]:
                    if here + UNKNOWN < part:
                        part, since = here + UNKNOWN, p
                    part, low_part = part + UNKNOWN_LETTER, min(low_part, least[p] + UNKNOWN) + UNKNOWN_LETTER
                    ending = SPLIT if p + 1 < close else ends[i]
                    if part + ending < best[p + 1][0] - 1e-9:
                        best[p + 1] = part + ending, since, None, False
                    least[p + 1] = min(least[p + 1], low_part + ending)
        strings = set()
        if asked and least[end] < best[end][0] - 1e-9:
            rest = [math.inf] * end + [0.0]
            whole_rest = [math.inf] * 2  # from the start of the next word on, within an unknown word all of whose parts are known so far, and another
            for i in range(stop - 1, first - 1, -1):
                part = math.inf
                letters, on = UNKNOWN_LETTER * (self.ends[i] - self.starts[i]), i < stop - 1 and self.joints[i] == HYPHEN
                closed = min(ends[i] + rest[self.ends[i]], KEPT + whole_rest[1] if on else math.inf)
                whole_rest = [letters + (closed if not self.clean[i] else KEPT + whole_rest[0] if on else math.inf), letters + closed]
                rest[self.starts[i]] = UNKNOWN + whole_rest[0]
                for p in range(self.ends[i] - 1, self.starts[i] - 1, -1):
                    if self.open[i]:
                        part = min(part, (SPLIT if p + 1 < self.ends[i] else ends[i]) + rest[p + 1]) + UNKNOWN_LETTER
                        rest[p] = min(rest[p], part + UNKNOWN)
                    for q, (cost, _, _, low) in edges.get(p, none).items():
                        rest[p] = min(rest[p], low + rest[q])
                        if low < cost and least[p] + low + rest[q] < best[end][0] - 1e-9:
                            strings.add(self.text[p:q])
        path, q = [], end
        while q > begin:
            path.append((q, best[q]))
            q = best[q][1]
        chosen = [(self.starts[i], self.ends[i], known(self.string(i, i)), False) for i in range(first)]
        chosen += [(p, q, reading, broken) for q, (_, p, reading, broken) in reversed(path)]
        chosen += [(self.starts[i], self.ends[i], known(self.string(i, i)), False) for i in range(stop, len(self.words))]
        after = {e: gap[:-1] if j == HYPHEN else gap[:-1] + " " for e, gap, j in zip(self.ends, self.gaps, self.joints)}
        found, out = set(), []
        for p, q, reading, broken in chosen:
            if reading and reading[1]:
                found.add("misread")
            if broken:
                found.add("hyphen")
            out += [restored(self.raw[p:q], reading), "" if q == len(self.text) else after.get(q, " ")]
        return found, "".join(out), strings


def stretches(stream: str, known: Known) -> Iterator[Stretch | tuple[int, int, str]]:
    """The stretches of a stream with other than known words, and (start, end, what it says) of each number in them and of line breaks after hyphens beside one."""
    other = {w for w in set(_WORD.findall(stream.lower())).difference(known.frequent) if not w.isdigit() and not known.clean(w)}
    for m in _RUN.finditer(stream):
        if m[1] is None and other.isdisjoint(m.group().lower().split()):
            continue
        at, words, gaps, joints = 0, [], [], []
        last, was_number = None, False
        for w in _WORD.finditer(stream, m.start(), m.end()):
            word = w.group()
            number = None if word.isalpha() else mended_number(word, known)
            how = joint(last.group(), stream[last.end() : w.start()], word) if last else None
            if number is not None or how is None or was_number:
                if any(joints) or not other.isdisjoint(map(str.lower, words)):
                    yield Stretch(at, words, gaps, joints)
                at, words, gaps, joints = w.start(), [], [], []
                if how == HYPHEN:
                    yield w.start() - 1, w.start(), ""
            if number is None:
                if words:
                    gaps.append(stream[last.end() : w.start()])
                    joints.append(how)
                words.append(word)
            else:
                yield w.start(), w.end(), number
            last, was_number = w, number is not None
        if any(joints) or not other.isdisjoint(map(str.lower, words)):
            yield Stretch(at, words, gaps, joints)


def softened(stream: str) -> tuple[str, bool]:
    """The stream with words joined that a soft hyphen breaks, and whether there are any."""
    if "\u00ad\n" not in stream:
        return stream, False
    text = _SOFT.sub(lambda m: m[1] if m[2].islower() or m[1].isupper() else m[0], stream)
    return text, text != stream


def floors(most: dict[int, int], total: int) -> list[float]:
    """For each length of a string, up to one that none of the words has, the least that its reading costs: ``most`` has the largest count of the words of a length."""
    cost = {length: math.log(total / n) for length, n in most.items()}
    wide = max(map(len, CONFUSIONS)) - 1  # a confusion makes of one character so many more
    return [min((c + CONFUSED * math.ceil((size - w) / wide) for w, c in cost.items() if w <= size <= w * (wide + 1)), default=math.inf) for size in range((wide + 1) * max(cost, default=0) + 2)]


def questions(stream: str, frequent: dict[str, int], longest: int) -> set[str]:
    """What has to be looked up first for a stream: words that are neither frequent nor numbers, and what hyphens may have broken, if no longer than a reading's ``longest``."""
    stream = softened(stream)[0]
    out = {low for w in set(_WORD.findall(stream)) if (low := lowered(w)) not in frequent and not w.isdigit() and not is_number(w)}
    lines = stream.split("\n")
    for i, line in enumerate(lines[:-1]):
        end = _LAST.search(line) if line[-1:] in HYPHENS else None
        start = end and _WORD.match(lines[i + 1])
        left = lowered(end[1]) if end else ""
        while start:  # on, where nothing but a part of the word stands in a line
            left += lowered(start.group())
            if len(left) > longest:
                break
            out.add(left)
            i += 1
            start = i + 1 < len(lines) and lines[i][start.end() :] in _HYPHENS and _WORD.match(lines[i + 1])
    return out.difference(frequent)


class LeastCosts(dict):
    """A cost that a string's reading isn't under, by a table over hashes of keys; forgets all when it has grown to a million."""

    def __init__(self, table: bytes) -> None:
        self.table = table

    def __missing__(self, s: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        cost = self.table[zlib.crc32(reading_key(s).encode("utf-8", "replace")) >> (32 - KEY_BITS)]
        self[s] = cost = cost if cost < 255 else math.inf
        return cost


def mend(stream: str, known: Known, least_cost: Callable[[str], float] | None = None) -> tuple[set[str], str, set[str]]:
    """(kinds of noise, repaired text, strings still to look up) of a stream by what is known; none are to look up without ``least_cost``, what a string's reading isn't under."""
    stream, broken = softened(stream)
    found, asked = {"hyphen"} if broken else set(), set()
    out, at = [], 0
    for x in stretches(stream, known):
        if isinstance(x, Stretch):
            if not x.read(known):
                continue
            kinds, said, strings = x.decode(known, least_cost)
            start, end = x.at, x.at + len(x.raw) + sum(map(len, x.gaps))
            found |= kinds
            asked |= strings
        else:
            start, end, said = x
            if said and said != stream[start:end]:
                found.add("misread")
        out += [stream[at:start], said]
        at = end
    return found, "".join([*out, stream[at:]]).replace("\n", " ").strip(), asked


def paragraphs(text: str) -> list[str]:
    """Claims of a stream: the longest chain of starts numbered 1, 2, 3 ..., by dynamic programming over candidates."""
    best: dict[int, tuple[int, int, tuple | None]] = {}  # by number: length of the chain, where its last claim starts, the chain before
    for m in _NUMBERED.finditer(text):
        number = int(m[1])
        before = best.get(number - 1) if number > 1 else None
        length = 1 if number == 1 else before[0] + 1 if before else 0
        if length and (number not in best or length > best[number][0]):
            best[number] = (length, m.start(), before)
    chain, cuts = max(best.values(), key=lambda c: c[0], default=None), []
    while chain:
        cuts.append(chain[1])
        chain = chain[2]
    edges = [0, *[c for c in reversed(cuts) if c], len(text)]
    return [p for a, b in zip(edges, edges[1:]) if (p := text[a:b].strip())]


def repair(text: str | None, lexicon: Lexicon) -> tuple[set[str], str]:
    """The kinds of noise of a single text, and its repaired paragraphs, with a lexicon at hand."""
    aside, stream = page_stream(text)
    most: dict[int, int] = {}
    for w, n in lexicon.counts.items():
        most[len(w)] = max(n, most.get(len(w), 0))
    known = Known({}, {}, lexicon.total, floors(most, lexicon.total))
    ask = lambda strings: known.readings.update({s: r for s in strings if (r := lexicon.read(s))})
    ask(questions(stream, {}, len(known.floor)))
    ask(mend(stream, known, lambda s: 0.0)[2])
    found, mended, _ = mend(stream, known)
    return {*aside, *found}, "\n".join(paragraphs(mended))


def words_in(df: DataFrame, col: str, inner: bool = False) -> DataFrame:
    """(w, n) of the words of letters of a column; ``inner``: none that begins or ends a line, where it may be a part, unless a full stop ends it."""
    text = rf"regexp_replace(`{col}`, '(?m)^[ \\t]*[^ \\t\\r\\n]+|[^ \\t\\r\\n]*[^ \\t\\r\\n.][ \\t]*$', ' ')" if inner else f"`{col}`"
    return df.select(F.explode(F.expr(rf"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+', 0)")).alias("w")).filter(r"w rlike '^\\p{L}+$'").groupBy("w").agg(F.count("*").alias("n"))


def look_up(strings: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """(s, said, edits, n) of the distinct strings ``s`` that the lexicon (word, n) knows or can mend.

    Strings and words of one key meet in one partition, words first; a partition's share of the lexicon is all that a task holds.
    """
    both = lexicon.select(_key_column(F.col("word")).alias("k"), F.lit(0).alias("asked"), F.col("word").alias("s"), "n").unionByName(strings.select(_key_column(F.col("s")).alias("k"), F.lit(1).alias("asked"), "s", F.lit(0).cast("long").alias("n")))
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        lexicon: Lexicon | None = None
        for b in batches:
            out = []
            for asked, s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not asked:
                    counts[s] = n
                    continue
                if lexicon is None:
                    lexicon = Lexicon(counts, total)
                found = lexicon.read(s)
                if found:
                    out.append((s, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=pa.schema([("s", pa.string()), ("said", pa.string()), ("edits", pa.int64()), ("n", pa.int64())]))

    return both.repartition(parts, "k").sortWithinPartitions("asked").select("asked", "s", "n").mapInArrow(run, "s string, said string, edits long, n long")


def lexicon_of(clean: list[tuple[DataFrame, str]], scans: DataFrame, text_col: str, least: int = 3) -> tuple[DataFrame, int]:
    """The table (word, n) of known words, and the number of all their uses.

    Words come from clean text columns (used ``least`` times or more) and, where these lack one, from the scans themselves, if it is
    frequent there (once in ten thousand texts of sixty words) and no misreading of a clean word or of one three times as frequent.
    """
    texts = None
    for df, col in clean:
        part = words_in(df, col)
        texts = part if texts is None else texts.unionByName(part)
    known = texts.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.col("w").alias("word"), "n")
    own = words_in(scans, text_col, inner=True).filter(F.col("n") >= least)
    # Both lists with a mark of where a word stands; rare words of the scans are left to be decoded.
    merged = stage(known.withColumn("own", F.lit(0)).unionByName(own.select(F.col("w").alias("word"), "n", F.lit(1).alias("own"))))
    scanned, total = merged.agg(F.coalesce(F.sum(F.when(F.col("own") == 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("own") == 0, F.col("n"))), F.lit(0))).first()
    clean_words = merged.filter("own = 0").select("word", "n")
    extra = merged.filter((F.col("own") == 1) & (F.col("n") >= max(least, 1e-4 * scanned / 60)) & (F.length("word") > 2)).select("word", "n").join(clean_words.select("word"), "word", "left_anti")
    # One table by key, clean words first, so that each extra word is judged by all it could be a misreading of.
    both = clean_words.withColumn("own", F.lit(0)).unionByName(extra.withColumn("own", F.lit(1)))
    parts = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[str, int] = {}
        more: dict[str, int] = {}
        for b in batches:
            for own, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                (more if own else base)[word] = n
        first, all_words = Lexicon(base), Lexicon({**base, **more})
        kept = dict(base)
        for w, n in more.items():
            was = first.correct(w) or ((found := all_words.correct(w)) and all_words.counts[found[0]] >= 3 * n and found or None)
            if not was:
                kept[w] = n
        keys = list(kept)
        for lo in range(0, len(keys), 50_000):
            some = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([kept[w] for w in some], pa.int64())], names=["word", "n"])

    lexicon = both.select(_key_column(F.col("word")).alias("k"), "own", "word", "n").repartition(parts, "k").sortWithinPartitions("own").select("own", "word", "n").mapInArrow(judge, "word string, n long")
    return stage(lexicon), int(total) or 1


def least_costs(lexicon: DataFrame, total: int) -> bytes:
    """For each hash of a key the least cost, rounded down, of the words that have it; 255 where none has."""
    h = F.shiftrightunsigned(F.crc32(_key_column(F.col("word")).cast("binary")), 32 - KEY_BITS).cast("int")
    cost = F.least(F.floor(F.log(F.lit(float(total)) / F.max("n")) - 1e-6), F.lit(254)).cast("short")
    found = lexicon.groupBy(h.alias("h")).agg(cost.alias("cost")).toArrow()
    table = np.full(1 << KEY_BITS, 255, np.uint8)
    table[found.column(0).to_numpy()] = np.maximum(found.column(1).to_numpy(), 0)
    return table.tobytes()


def scan_noise(scans: DataFrame, clean: list[tuple[DataFrame, str]], text_col: str = "claims_text") -> DataFrame:
    """(scan_id, kinds, repaired), one row for each distinct (scan_id, text): the kinds of noise and the repaired paragraphs, one a line.

    Null, empty and blank texts have no noise and repair to an empty text; whole texts of any length are read.  The lexicon and
    the readings stay tables: texts ask for the distinct words they can't take for frequent ones, and get back the few that
    are known or mended; then for the other edges of the lattices that the cheapest path may take, where a table of fixed
    size (the least cost of a word by hash of its key) leaves that open.  Words that make up a ten-thousandth of all uses or more, of which
    there are ten thousand at most, are broadcast with their counts so that nobody asks for them.
    """
    sc = scans.sparkSession.sparkContext
    kind = scans.schema["scan_id"].dataType.simpleString()
    lexicon, total = lexicon_of(clean, scans, text_col)
    frequent = sc.broadcast({r.word: r.n for r in lexicon.filter(F.col("n") >= 1e-4 * total).collect()})
    keys = sc.broadcast(least_costs(lexicon, total))
    floor = floors({r[0]: r[1] for r in lexicon.groupBy(F.length("word")).agg(F.max("n")).collect()}, total)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                done = [page_stream(t) for t in part.column(2).to_pylist()]
                asked = [sorted(questions(s, frequent.value, len(floor))) for _, s in done]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k for k, _ in done], pa.list_(pa.string())), pa.array([s for _, s in done], pa.string()), pa.array(asked, pa.list_(pa.string()))], names=["scan_id", "_key", "aside", "stream", "asked"])

    keyed = spread(scans.select("scan_id", F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text")))
    pages = stage(keyed.mapInArrow(read, f"scan_id {kind}, _key long, aside array<string>, stream string, asked array<string>"))

    def answers(asked: DataFrame, table: DataFrame) -> DataFrame:
        """The readings that a page asked for, as one array a page."""
        return asked.join(table, "s").groupBy("scan_id", "_key").agg(F.collect_set(F.struct("s", "said", "edits", "n")).alias("got"))

    first = pages.select("scan_id", "_key", F.explode("asked").alias("s"))
    readings = stage(look_up(first.select("s").distinct(), lexicon, total))
    with_readings = pages.drop("asked").join(answers(first, readings), ["scan_id", "_key"], "left")

    def told(aside: list[str], found: set[str], text: str) -> tuple[list[str], str]:
        return [k for k in KINDS if k in {*aside, *found}], "\n".join(paragraphs(text))

    def unread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_cost = LeastCosts(keys.value).__getitem__
        for b in batches:
            rows = []
            for aside, stream, got in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                found, text, more = mend(stream, Known(_dict(got), frequent.value, total, floor), least_cost)
                rows.append((aside, None, sorted(more)) if more else (*told(aside, found, text), []))
            kinds, repaired, asked = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(repaired, pa.string()), pa.array(asked, pa.list_(pa.string()))], names=["scan_id", "_key", "kinds", "repaired", "asked"])

    once = stage(with_readings.select("scan_id", "_key", "aside", "stream", "got").mapInArrow(unread, f"scan_id {kind}, _key long, kinds array<string>, repaired string, asked array<string>"))
    second = once.select("scan_id", "_key", F.explode("asked").alias("s"))
    more = look_up(second.select("s").distinct(), lexicon, total)
    waiting = once.filter("repaired IS NULL").select("scan_id", "_key").join(with_readings, ["scan_id", "_key"]).join(answers(second, more).withColumnRenamed("got", "more"), ["scan_id", "_key"], "left")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [told(aside, *mend(stream, Known(_dict(got) | _dict(more), frequent.value, total, floor))[:2]) for aside, stream, got, more in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            kinds, repaired = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(repaired, pa.string())], names=["scan_id", "_key", "kinds", "repaired"])

    late = waiting.select("scan_id", "_key", "aside", "stream", "got", "more").mapInArrow(finish, f"scan_id {kind}, _key long, kinds array<string>, repaired string")
    early = once.filter("repaired IS NOT NULL").select("scan_id", "_key", "kinds", "repaired")
    return early.unionByName(late).dropDuplicates(["scan_id", "_key"]).drop("_key")


def _dict(got: list[dict] | None) -> dict[str, Reading]:
    return {g["s"]: (g["said"], g["edits"], g["n"]) for g in got or []}
