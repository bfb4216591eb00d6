"""Evaluation texts in a corpus: latent semantic retrieval of passages, then exact, subsequence and answer checks.

Passages of the corpus span a TF-IDF space; a randomised SVD of it is computed distributed, over all distinct texts.  The
items' passages are projected and indexed, all documents' passages are projected and looked up.  Verbatim leaks are
candidates of cosine 1: equal passages have equal projections, so no cut of the space can lose one.  Paraphrases are
candidates of a lower cosine, checked by longest common subsequence and by the words an item can't do without.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.operators.relate import small
from quillstone.session import stage

_WORD = re.compile(r"[^\W_]+")
HASH_BITS = 16  # words of the whole corpus share 2^16 rows of its space
FILTER_BITS = 26  # the filter of the items' passages has 2^26 bits, 8 MB, however many items there are
UNIT = 1 << 40  # coordinates are whole numbers of 1 / UNIT, so that sums are exact


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """A block of evaluation items: ids of their words in one vocabulary, item after item, and where each begins."""

    keys: list[int]
    vocabulary: dict[str, int]
    words: np.ndarray
    starts: np.ndarray

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def read_items(items: DataFrame, id_col: str, text_col: str, max_chars: int) -> list[Items]:
    """All items, in blocks of at most ``max_chars`` characters (an item longer than that is a block of its own).

    The items are the stated query set; only they reach the driver, and only block by block the executors.
    """
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for row in items.select(F.col(id_col).cast("long"), text_col).filter(f"`{text_col}` IS NOT NULL").toLocalIterator():
        if size and size + len(row[1]) > max_chars:
            blocks.append([])
            size = 0
        size += len(row[1])
        blocks[-1].append((row[0], words_of(row[1])))
    out = []
    for block in blocks:
        vocabulary: dict[str, int] = {}
        words = [vocabulary.setdefault(w, len(vocabulary)) for _, ws in block for w in ws]
        out.append(Items([k for k, _ in block], vocabulary, np.array(words, np.int32), np.cumsum([0, *(len(ws) for _, ws in block)])[:-1]))
    return out


def word_ids(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the texts one after the other (-1: not in the vocabulary; also once after each text), and their text's place."""
    get, ids, sizes = vocabulary.get, [], []
    for t in texts:
        ws = words_of(t)
        ids += [get(w, -1) for w in ws]
        ids.append(-1)
        sizes.append(len(ws) + 1)
    return np.array(ids, np.int32), np.repeat(np.arange(len(texts)), sizes)


def _passages(ids: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Known words and the number of their passage; passages are consecutive runs of ``size`` words of one text."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    number = np.cumsum(place % size == 0) - 1
    known = ids >= 0
    return ids[known], number[known]


def _gram_product(corpus: DataFrame, vocabulary, width: int, basis, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(A^T A basis, document frequencies) of the passage-term matrix A of all texts; one pass, summed by Spark.

    The driver gets one row per word of the items' vocabulary.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, base = vocabulary.value, basis.value
        get = vocab.lookup() if isinstance(vocab, _HashedVocabulary) else vocab
        total, df = np.zeros((len(vocab), width)), np.zeros(len(vocab))
        for part in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            ids, owner = word_ids(part.column(0).to_pylist(), get)
            if not len(ids):
                continue
            every, number_of = _passages(ids, owner, passage)
            first = np.flatnonzero(np.r_[True, number_of[1:] != number_of[:-1]])
            for at, end in ((first[k], first[k + 1024] if k + 1024 < len(first) else len(every)) for k in range(0, len(first) if len(every) else 0, 1024)):
                terms, number = every[at:end], number_of[at:end]
                starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                sums = np.add.reduceat(base[terms], starts)
                row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(number)]))
                # By term: its passages lie together, in order, so both its frequency and its sum are runs.
                order = np.argsort(terms.astype(np.uint16) if len(vocab) <= 1 << 16 else terms, kind="stable")
                term, row = terms[order], row[order]
                runs = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
                new = np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]
                df[term[runs]] += np.add.reduceat(new.astype(np.int64), runs)
                total[term[runs]] += np.add.reduceat(sums[row], runs)
        used = np.flatnonzero(df)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used]), *[pa.array(total[used, i]) for i in range(width)]], names=["term", "df", *[f"v{i}" for i in range(width)]])

    parts = corpus.mapInArrow(run, "term int, df double, " + ", ".join(f"v{i} double" for i in range(width)))
    sums = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ["df", *[f"v{i}" for i in range(width)]]]).collect()
    product, df = np.zeros((len(vocabulary.value), width)), np.zeros(len(vocabulary.value))
    for r in sums:
        df[r[0]], product[r[0]] = r[1], r[2:]
    return product, df


def latent_space(corpus: DataFrame, words, rank: int, passage: int = 48, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """idf-weighted projection (words x rank) onto the leading right singular vectors of the TF-IDF passages of the texts.

    Randomised range finding: one pass sketches the range of A^T from Gaussian test vectors and counts document
    frequencies; a second pass gives the small projected matrix, whose eigenvectors rotate the basis.  Also gives the words' idf.
    """
    sc = corpus.sparkSession.sparkContext
    n = len(words)
    width = min(rank, n)
    vocabulary = sc.broadcast(words)
    sketch, df = _gram_product(corpus, vocabulary, width, sc.broadcast(np.random.default_rng(seed).standard_normal((n, width))), passage)
    idf = np.log1p(1.0 / ((df + 1) / (df.sum() + 1)))
    q, _ = np.linalg.qr(idf[:, None] * sketch)
    product, _ = _gram_product(corpus, vocabulary, width, sc.broadcast(idf[:, None] * q), passage)
    small = q.T @ (idf[:, None] * product)
    values, rotation = np.linalg.eigh((small + small.T) / 2)
    basis = q @ rotation[:, np.argsort(-values)]
    # Words whose coordinates vanish in the kept space keep a trace of themselves, so that their passages can be told apart.
    trace = np.random.default_rng(seed + 1).standard_normal((n, width)) * 1e-3
    return idf[:, None] * (basis + trace), idf


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` known words."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    unknown = np.r_[0, np.cumsum(ids < 0)]
    return np.flatnonzero(unknown[size:] == unknown[:-size])


def fitted(texts: DataFrame, sample: int | None = None) -> DataFrame:
    """What the space is fitted on, equal texts once: all of them, or about ``sample`` chosen by their hash where a caller asks for that."""
    if sample is not None:
        texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, texts.count())) * (1 << 30)))
    return texts.select("text").distinct()


class _Buckets(dict):
    """The row of each word of any text; forgets all when it has grown to a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) >> (32 - HASH_BITS)
        return value

    def get(self, word: str, default: int = -1) -> int:
        return self[word]


class _HashedVocabulary:
    """A vocabulary of all words, by hash."""

    def __len__(self) -> int:
        return 1 << HASH_BITS

    def lookup(self) -> _Buckets:
        return _Buckets()


def run_keys(ids: np.ndarray, size: int, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``size`` words of one text, and a 64-bit key of each run's projection: its coordinates, exactly summed and mixed."""
    at = windows(ids, size)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    key = np.zeros(len(at), np.uint64)
    known = np.where(ids < 0, 0, ids)
    for axis in space.T:
        total = np.r_[0, np.cumsum(np.ascontiguousarray(axis)[known])]
        key = (key ^ (total[at + size] - total[at]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return at, key * np.uint64(0xBF58476D1CE4E5B9)


def _runs(id_name: str, size: int, shared, filtered=None):
    """Rows (id, text) to the distinct runs (id, key, words) of each text; with a filter only those it lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, get = shared.value, _Buckets()
        bits = None if filtered is None else filtered.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(t) + 1 for t in texts])
                words = [w for t in texts for w in (*t, "")]
                ids = np.fromiter(map(get.__getitem__, words), np.int32, len(words))
                ids[np.cumsum(sizes) - 1] = -1  # a mark after each text
                at, key = run_keys(ids, size, space)
                if bits is not None and len(at):
                    bit = key >> np.uint64(64 - FILTER_BITS)
                    kept = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1
                    at, key = at[kept], key[kept]
                if not len(at):
                    continue
                owner = np.searchsorted(np.cumsum(sizes), at, "right")
                found = dict.fromkeys(zip(owner.tolist(), key.view(np.int64).tolist(), (" ".join(words[i : i + size]) for i in at.tolist())))
                owner, key, text = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(key, pa.int64()), pa.array(text)], names=[id_name, "key", "run"])

    return run


def verbatim(corpus: DataFrame, items: DataFrame, run_words: int = 12, rank: int = 8, sample: int | None = None) -> DataFrame:
    """(doc_id, item_id) of documents that have ``run_words`` or more consecutive words of an item.

    Runs of that many words are candidates where their projections are equal.  The items' runs are a table by the key of their
    projection, and a filter of fixed size over these keys is broadcast: one pass over the corpus projects every run and
    sends on those that pass, which are joined with the table and compared word by word.  The space is fitted on all distinct texts
    (on about ``sample`` of them where that is given); no run is lost whatever it is.  Null, empty and shorter texts give nothing; whole texts are searched; repeated rows count once.
    """
    sc = corpus.sparkSession.sparkContext
    texts = corpus.select("doc_id", "text").filter("text IS NOT NULL")
    space, _ = latent_space(fitted(texts, sample), _HashedVocabulary(), rank)
    shared = sc.broadcast(np.round(space / max(np.abs(space).max(), 1e-300) * UNIT).astype(np.int64))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    index = stage(asked.mapInArrow(_runs("item_id", run_words, shared), "item_id long, key long, run string").distinct())
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    cells = index.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63))")).alias("bits")).collect()  # at most 2^20 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for cell, value in cells:
        bits[cell] = value
    kind = corpus.schema["doc_id"].dataType.simpleString()
    hits = spread(texts).mapInArrow(_runs("doc_id", run_words, shared, sc.broadcast(bits.view(np.uint64))), f"doc_id {kind}, key long, run string")
    return hits.join(small(index), ["key", "run"]).select("doc_id", "item_id").distinct()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v = mask = (1 << len(a)) - 1
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the length of their longest common subsequence; bit-parallel over ``a``, all pairs at once.

    Places without a word have different negative numbers in ``a`` and ``b``.
    """
    size = a.shape[1]
    if size > 64:
        return np.array([common_subsequence(x, y) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    packed = np.packbits(a[:, None, :] == b[:, :, None], axis=2, bitorder="little")
    places = np.zeros((*packed.shape[:2], 8), np.uint8)
    places[:, :, : packed.shape[2]] = packed
    places = np.ascontiguousarray(places.view("<u8")[:, :, 0].T)
    mask = np.uint64(2**size - 1)
    v = np.full(len(a), mask)
    for row in places:
        u = v & row
        v = ((v + u) | (v - u)) & mask
    return size - np.bitwise_count(v).astype(np.int64)


def cut(starts: np.ndarray, lengths: np.ndarray, size: int, step: int) -> np.ndarray:
    """Starts of windows of ``size`` words every ``step`` words of each text, and of its last one; texts shorter than that have one, at their start."""
    last = np.maximum(lengths - size, 0)
    n = np.where(lengths > 0, last // step + 1 + (last % step > 0), 0)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n) + np.minimum(place * step, np.repeat(last, n))


def directions(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors of the windows from ``at`` to ``ends``, to single precision; unknown words have no vector."""
    sums = np.zeros((len(ids) + 1, space.shape[1]))
    np.cumsum(np.concatenate([space, np.zeros((1, space.shape[1]))])[ids], axis=0, out=sums[1:])
    out = sums[ends] - sums[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm < 1e-9, np.inf, norm)).astype(np.float32)


def around(ids: np.ndarray, low: np.ndarray, width: int, starts: np.ndarray, ends: np.ndarray, none: int) -> np.ndarray:
    """``width`` words from each of ``low`` on, ``none`` in the place of those outside of the text."""
    at = low[:, None] + np.arange(width)
    return np.where((at >= starts[:, None]) & (at < ends[:, None]), ids[np.clip(at, 0, len(ids) - 1)], none)


def key_words(windows: np.ndarray, idf: np.ndarray, numbers: np.ndarray, most: int = 6) -> np.ndarray:
    """For each window the words an answer can't do without: its numbers, then its rarest words, ``most`` of them (-3 where it has fewer)."""
    weight = np.where(numbers, np.inf, idf)
    out = np.full((len(windows), most), -3, np.int64)
    for row, w in zip(out, windows):
        own = np.unique(w[w >= 0])
        best = own[np.argsort(-weight[own], kind="stable")][:most]
        row[: len(best)] = best
    return out


def answered(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The share of each row's key words that its text has."""
    there = (keys[:, :, None] == text[:, None, :]).any(axis=2).sum(axis=1)
    return there / np.maximum((keys >= 0).sum(axis=1), 1)


def paraphrased(corpus: DataFrame, items: DataFrame, cosine: float = 0.6, common: float = 0.75, answer: float = 1 / 3, size: int = 24, rank: int = 128, sample: int | None = None, max_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, overlap) of documents with a passage close to an item's though not verbatim.

    Passages are windows of ``size`` words: the documents' at every word, the items' every ``size`` / 6 words and at their
    end; a shorter text is one window.  Candidates have at least ``cosine``; one counts where the longest common subsequence
    of a window of the item, at any word up to ``size`` / 6 from the candidate's, and the document's (with half a window on
    either side) covers ``common`` of the item's window, and where the passage has at least the share ``answer`` of the window's
    key words (its numbers and rarest words).  The space is fitted on all distinct texts (on about ``sample`` of them where that
    is given).  overlap is the largest such cover.  The items are the stated query set: they are
    held against all rows in blocks of ``max_chars``, and in products of at most 1024 by 4096 windows.
    """
    texts = spread(corpus.select("doc_id", "text").filter("text IS NOT NULL"))
    basis = fitted(texts, sample)
    found = None
    step = max(1, size // 6)
    kind = corpus.schema["doc_id"].dataType.simpleString()
    for block in read_items(items, "item_id", "text", max_chars):
        if not len(block.words):
            continue
        lengths = np.diff(np.r_[block.starts, len(block.words)])
        space, idf = latent_space(basis, block.vocabulary, rank)
        numbers = np.array([any(map(str.isdigit, w)) for w in block.vocabulary])
        groups = []  # items of a length under ``size`` have windows of their own length
        for n in np.unique(np.minimum(lengths, size))[::-1]:
            mine = np.minimum(lengths, size) == n
            if not n:
                continue
            at = cut(block.starts[mine], lengths[mine], n, step)
            o = block.owner(at)
            low = block.starts[o]
            spans = around(block.words, at - step, n + 2 * step, low, low + lengths[o], -2)
            groups.append((int(n), directions(block.words, at, at + n, space), spans, key_words(spans[:, step : step + n], idf, numbers), np.array(block.keys)[o]))
        index = corpus.sparkSession.sparkContext.broadcast((block.vocabulary, space, groups))

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            vocabulary, space, groups = index.value
            for b in (whole.slice(lo, 128) for whole in batches for lo in range(0, whole.num_rows, 128)):
                keys, best = b.column(0), {}
                ids, owner = word_ids(b.column(1).to_pylist(), vocabulary)
                starts = np.searchsorted(owner, np.arange(b.num_rows))
                ends = np.r_[starts[1:], len(ids)] - 1  # without the mark after a text
                for n, vectors, spans, needed, owners in groups:
                    at = cut(starts, ends - starts, n, 1)
                    unit = directions(ids, at, np.minimum(at + n, ends[owner[at]]), space)
                    for lo, v in ((lo, v) for lo in range(0, len(at), 1024) for v in range(0, len(vectors), 4096)):
                        w, i = np.nonzero(unit[lo : lo + 1024] @ vectors[v : v + 4096].T >= cosine)
                        i += v
                        s = at[w + lo]
                        # Windows near each other are compared at once first: none of them has more in common than all of them.
                        near = (s // step) * len(vectors) + i
                        _, one, of = np.unique(near + owner[s] * ((len(ids) // step + 1) * len(vectors)), return_index=True, return_inverse=True)
                        hopeful = np.zeros(len(one), bool)
                        for k in range(0, len(one), 4096):
                            c = one[k : k + 4096]
                            d = owner[s[c]]
                            hopeful[k : k + 4096] = common_lengths(spans[i[c]], around(ids, s[c] // step * step - n // 2, n + 2 * (n // 2) + step, starts[d], ends[d], -1)) >= common * n
                        kept = np.flatnonzero(hopeful[of])
                        for k in range(0, len(kept), 4096):
                            c = kept[k : k + 4096]
                            d = owner[s[c]]
                            text = around(ids, s[c] - n // 2, n + 2 * (n // 2), starts[d], ends[d], -1)
                            most = np.max([common_lengths(spans[i[c], o : o + n], text) for o in range(2 * step + 1)], axis=0)
                            for p in np.flatnonzero((most >= common * n) & (answered(needed[i[c]], text) >= answer - 1e-9)):
                                pair = int(d[p]), int(owners[i[c[p]]])
                                best[pair] = max(best.get(pair, 0.0), float(most[p]) / n)
                if best:
                    d, i = zip(*best)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(d, pa.int64())), pa.array(i, pa.int64()), pa.array(list(best.values()))], names=["doc_id", "item_id", "overlap"])

        hits = texts.mapInArrow(run, f"doc_id {kind}, item_id long, overlap double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return corpus.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, overlap double")
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))
