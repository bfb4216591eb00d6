"""Public byte-level BPE tokenizers: exact encoding of a corpus, and token totals by slice.

Two engines over one vocabulary.  ``PrefixEncoder`` encodes by dynamic programming over byte prefixes: the encoding
of every prefix ends in one valid last token, found from the last tokens of shorter prefixes, so texts can be
extended and edited without starting again.  ``count_symbols`` merges a batch of distinct pieces at once by joining
adjacent symbols with the table of merge ranks.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.llm.terms import canonical_code

TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the pre-split of the 50k byte-level vocabulary; white space is Unicode's White_Space.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

NONE = -1


class Vocabulary:
    """Tokens by rank and, for each merged token, the two tokens it is merged from."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.left = np.arange(len(tokens), dtype=np.int32)
        self.right = self.left.copy()
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self.left[i], self.right[i] = self._last_merge(t, i)
        self._engine = None

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1], below)) < below]
            if not ranked:
                raise ValueError(f"token {below} can't be merged from lower ones")
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of base64 token and rank, as tiktoken has them; ranks must be dense."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(sorted(ranks, key=ranks.__getitem__))

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "left": self.left, "right": self.right}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self._engine = None

    @property
    def engine(self) -> PrefixEngine:
        if self._engine is None:
            self._engine = PrefixEngine(self)
        return self._engine


class PrefixEngine:
    """What all PrefixEncoders of a vocabulary share: the automaton of its tokens and the test of adjacent tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v = vocabulary
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.pair = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.longest = max(map(len, vocabulary.tokens))
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary.tokens):
            self.matcher.add_word(t.decode("latin-1"), (i, len(t)))
        self.matcher.make_automaton()
        self.adjacent: dict[tuple[int, int], bool] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether byte pair encoding of the bytes of a and b gives a, b: undo merges next to the seam, latest first."""
        known = self.adjacent.get((a, b))
        if known is not None:
            return known
        if len(self.adjacent) > 2_000_000:
            self.adjacent.clear()
        x, y, limit = a, b, len(self.left)
        while True:
            merged = self.pair.get((x, y))
            if merged is not None and merged < limit:
                ok = False
                break
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            if whole_x and whole_y:
                ok = True
                break
            # The later of the two merges is undone: a merge across the seam must not come before it. Of equal ranks the
            # leftmost is merged first, so the right one is undone first, and an equal one across the seam precedes it.
            if not whole_x and (whole_y or x > y):
                limit, x = x, self.right[x]
            else:
                limit, y = y + 1, self.left[y]
        self.adjacent[a, b] = ok
        return ok


class PrefixEncoder:
    """The encoding of one pre-split piece that can grow and be edited.

    ``last[i]`` is the one token that ends the encoding of the first i + 1 bytes.
    """

    def __init__(self, engine: PrefixEngine, data: bytes = b"") -> None:
        self.engine, self.data, self.last = engine, bytearray(), []
        self.append(data)

    def _solve(self, start: int, stop: int, old: list[int] | None = None) -> int:
        """Fill last from ``start`` on; with ``old`` (last tokens of the same bytes before) stop where they agree again."""
        e, last, sizes = self.engine, self.last, self.engine.v.tokens
        first = max(0, start - e.longest)
        text = bytes(self.data[first:stop]).decode("latin-1")
        same, at, found = 0, -1, False
        for end, (token, n) in e.matcher.iter(text):
            end += first
            if end < start:
                continue
            if end != at:
                at, found = end, False
            if found:
                continue
            before = end - n
            if before < -1 or (before >= 0 and not e.stays_apart(last[before], token)):
                continue
            last.append(token)
            found = True
            if old is not None:
                same = same + 1 if old[end - start] == token else 0
                if same > len(sizes[token]) and same >= e.longest:
                    return end + 1
        return stop

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self._solve(start, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in place of bytes start to stop; only bytes near the edit are encoded again."""
        tail = self.last[stop:]
        self.data[start:stop] = data
        del self.last[start:]
        self._solve(start, start + len(data))
        begin = start + len(data)
        done = self._solve(begin, len(self.data), tail) if tail else begin
        self.last.extend(tail[done - begin :])

    def tokens(self) -> list[int]:
        out, i = [], len(self.last) - 1
        while i >= 0:
            out.append(self.last[i])
            i -= len(self.engine.v.tokens[self.last[i]])
        return out[::-1]


class TextEncoder:
    """Texts to ids: pre-split, then each distinct piece by a PrefixEncoder; pieces seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000) -> None:
        import regex

        self.v, self.keep, self.known = vocabulary, keep, {}
        self.split = regex.compile(PRE_SPLIT).findall

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        one = self.v.rank.get(data)
        ids = [one] if one is not None else PrefixEncoder(self.v.engine, data).tokens()
        if len(data) <= 64:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            out += ids if ids is not None else self.piece(p)
        return out


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids): every text's ids, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list; repeated rows give repeated rows.  Map-only: the vocabulary (half a MB,
    fixed) is broadcast, whole texts are encoded where they lie.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(f"{tokenizer_dir}/{name}.tiktoken"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(shared.value)
        for b in batches:
            begin, values, offsets = 0, [], [0]
            for i, text in enumerate(b.column(1)):
                values += encoder.encode(text.as_py())
                offsets.append(len(values))
                if len(values) > 1_000_000 or i == b.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(values, np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, i + 1 - begin), ids], names=[id_col, "ids"])
                    begin, values, offsets = i + 1, [], [0]

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


class MergeTable:
    """Merge ranks keyed by pairs of symbols, sorted for joining with arrays of pairs."""

    def __init__(self, v: Vocabulary) -> None:
        made = np.flatnonzero(v.left != np.arange(len(v.tokens), dtype=np.int32))
        key = v.left[made].astype(np.int64) << 32 | v.right[made]
        order = np.argsort(key)
        self.key, self.made = key[order], made[order].astype(np.int64)
        self.byte = np.full(256, NONE, np.int32)
        for i, t in enumerate(v.tokens):
            if len(t) == 1:
                self.byte[t[0]] = i

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of adjacent symbols, or a number beyond all ranks."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.made[at], 1 << 40)


def count_symbols(pieces: Sequence[bytes], table: MergeTable) -> np.ndarray:
    """The number of tokens of each piece: symbol arrays are merged in rounds, each piece by its lowest-ranked pair."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    out = sizes.copy()
    live = np.flatnonzero(sizes > 1)
    symbols = table.byte[np.frombuffer(b"".join(pieces[i] for i in live), np.uint8)]
    owner = np.repeat(np.arange(len(live)), sizes[live])
    while len(symbols) > 1:
        rank = np.full(len(symbols), 1 << 40, np.int64)
        rank[:-1] = np.where(owner[:-1] == owner[1:], table.join(symbols[:-1], symbols[1:]), 1 << 40)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.r_[starts, len(symbols)])
        least_of = np.repeat(least, counts)
        hit = (rank == least_of) & (rank < 1 << 40)
        # In a run of overlapping pairs (a a a) every other one is merged, from the left.
        index = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
        hit &= (index - run_start) % 2 == 0
        merged = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[merged] = rank[merged]
        keep = np.ones(len(symbols), bool)
        keep[merged + 1] = False
        done = np.repeat(least >= 1 << 40, counts)
        finished = starts[least >= 1 << 40]
        out[live[owner[finished]]] = counts[least >= 1 << 40]
        keep &= ~done
        symbols, owner = symbols[keep], owner[keep]
    if len(symbols):
        out[live[owner]] = 1
    return out


def token_budget(texts: DataFrame, text_cols: Sequence[str] = ("abstract", "claims_text"), tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(source, lang, section, texts, chars, tokens) over all rows.

    lang is the primary subtag in lower case, section the first letter of the canonical primary_ipc; each is
    ``unknown`` where it is missing or no code.  Null and empty texts have no tokens but their rows count in texts.

    Each partition counts its pieces by slice before anything moves; one shuffle brings equal pieces together, each
    distinct piece of a batch is merged once, and a second, tiny one adds up the slices.  A hot slice is spread
    over its pieces; a hot piece is one row per slice and input batch.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Vocabulary.load(f"{tokenizer_dir}/{name}.tiktoken"))
    lang = F.regexp_extract(F.lower(F.trim(F.col("lang"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    named = lambda c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("unknown"))
    rows = texts.select(named(F.col("source")).alias("source"), named(lang).alias("lang"), named(F.substring(canonical_code(F.col("primary_ipc")), 1, 1)).alias("section"), *text_cols)
    slices = ["source", "lang", "section"]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PRE_SPLIT).findall
        for b in batches:
            count: dict[tuple, Counter] = {}
            columns = [c.to_pylist() for c in b.columns]
            for key, *row in zip(zip(*columns[:3]), *columns[3:]):
                c = count.setdefault(key, Counter())
                c[""] += 1
                for text in row:
                    if text:
                        c.update(find(text))
            flat = [(*k, p, n) for k, c in count.items() for p, n in c.items()]
            for i in range(0, len(flat), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat[i : i + 50_000])], names=[*slices, "piece", "n"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = MergeTable(shared.value), {}
        for b in batches:
            pieces = b.column(3).dictionary_encode()
            tokens = count_symbols([p.encode("utf-8", "replace") for p in pieces.dictionary.to_pylist()], table)[pieces.indices.to_numpy()]
            for k, p, n, t in zip(zip(*(c.to_pylist() for c in b.columns[:3])), b.column(3).to_pylist(), b.column(4).to_pylist(), tokens.tolist()):
                s = sums.setdefault(k, [0, 0, 0])
                if p:
                    s[1] += n * len(p)
                    s[2] += n * t
                else:
                    s[0] += n
        if sums:
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in zip(*sums)], *[pa.array(x, pa.int64()) for x in zip(*sums.values())]], names=[*slices, "texts", "chars", "tokens"])

    pieces = spread(rows).mapInArrow(split, "source string, lang string, section string, piece string, n long")
    counted = pieces.groupBy(*slices, "piece").agg(F.sum("n").alias("n"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        counted.repartition(parts, "piece")
        .sortWithinPartitions("piece")
        .mapInArrow(merge, "source string, lang string, section string, texts long, chars long, tokens long")
        .groupBy(*slices)
        .agg(F.sum("texts").alias("texts"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    )
