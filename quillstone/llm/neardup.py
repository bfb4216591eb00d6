"""Records that share most of their word shingles: exact candidates, bit-sliced distances, exact verification.

Equal shingle sets are one class, compared once.  Shingles have one order for all texts, seldom ones first; two sets of a
similarity share k shingles among the first few of each (as many as the similarity allows to differ, and k more), none of them so
far back that too few are left for the similarity.  Sets that don't meet k times so can't be similar; no similar pair is lost.  Sketches of the candidates, parities of the shingle
set, are compared bit-sliced: bit planes lie vertically, one lane a pair, and carry-save adders count the differing bits of
many pairs at once.  Two sketches differ in at most as many bits as the sets differ in shingles, so the radius that a
similarity implies loses no similar pair either.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import spread
from quillstone.session import stage

_WORD = re.compile(r"[^\W_]+")
BITS = 512
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """The 64-bit hash of each word; forgets all when it has grown to half a million."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Texts to the sorted arrays of 64-bit hashes of their distinct word sequences."""

    def __init__(self, words: int) -> None:
        self.words, self.hashes = words, _Hashes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all sets one after the other, their bounds: set i is from bounds[i] to bounds[i + 1])."""
        words = [_WORD.findall(t.lower()) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = max(0, len(h) - self.words + 1)
        s = np.zeros(n, np.uint64)
        for i in range(self.words):
            s = _mix(s * np.uint64(_MULTIPLIERS[i % 3]) + h[i : i + n])
        inside = owner[:n] == owner[self.words - 1 : self.words - 1 + n]
        s, owner = s[inside], owner[:n][inside]
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])][: len(s)]
        s, owner = s[new], owner[new]
        return s, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketch(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set BITS parities: bit b is the parity of the number of its shingles that hash to b."""
    sets = len(bounds) - 1
    cell = np.repeat(np.arange(sets), np.diff(bounds)) * BITS + (_mix(shingles * np.uint64(_MULTIPLIERS[1])) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(cell, minlength=sets * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, BITS), axis=1, bitorder="little")


def _add(counter: list[np.ndarray], carry: np.ndarray, level: int) -> None:
    """Ripple one plane of weight 2^level into the vertical counter."""
    while level < len(counter):
        counter[level], carry = counter[level] ^ carry, counter[level] & carry
        level += 1


def within(sketches: np.ndarray, left: np.ndarray, right: np.ndarray, radius: np.ndarray, lanes: int = 8192, group: int = 32) -> np.ndarray:
    """Whether sketches[left] and sketches[right] differ in at most ``radius`` bits, for each lane.

    Planes of a block of lanes are taken in groups: full adders compress three planes of a weight into two, the rest
    ripples into a vertical counter that starts at (all ones - radius), so that a lane beyond its radius overflows
    into a sticky plane; a block is abandoned once all its lanes have overflowed.
    """
    out = np.zeros(len(left), bool)
    depth = BITS.bit_length()
    for lo in range(0, len(left), lanes):
        a, b = left[lo : lo + lanes], right[lo : lo + lanes]
        n = len(a)
        words = -(-n // 64)
        pad = np.zeros((words * 64 - n, sketches.shape[1]), np.uint8)
        horizontal = np.unpackbits(np.vstack([sketches[a] ^ sketches[b], pad]), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(horizontal.T), axis=1, bitorder="little").view(np.uint64)
        start = np.full(words * 64, 2**depth - 1, np.int64)
        start[:n] -= np.minimum(radius[lo : lo + lanes], 2**depth - 1)
        counter = [np.packbits((start >> k & 1).astype(np.uint8), bitorder="little").view(np.uint64) for k in range(depth)]
        counter.append(np.packbits(np.r_[np.zeros(n, np.uint8), np.ones(words * 64 - n, np.uint8)], bitorder="little").view(np.uint64))
        for g in range(0, BITS, group):
            level: list[list[np.ndarray]] = [list(planes[g : g + group])]
            k = 0
            while k < len(level):
                todo, carries = level[k], []
                while len(todo) > 2:
                    x, y, z = todo.pop(), todo.pop(), todo.pop()
                    half = x ^ y
                    todo.append(half ^ z)
                    carries.append((x & y) | (half & z))
                for plane in todo:
                    sticky = counter[depth]
                    _add(counter, plane, k)
                    counter[depth] |= sticky
                if carries:
                    level.append(carries)
                k += 1
            if (~counter[depth] == 0).all():
                break
        else:
            out[lo : lo + lanes] = np.unpackbits(counter[depth].view(np.uint8), bitorder="little")[:n] == 0
    return out


def first_shingles(shingles: np.ndarray, bounds: np.ndarray, similarity: float, meets: int, usual: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits of each set's shingles at which a similar set meets it ``meets`` times, their bounds): its first n - ceil(similarity n) + meets by (uses, hash), in that order."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    if len(usual):
        at = np.minimum(np.searchsorted(usual, shingles), len(usual) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(usual[at] == shingles, uses[at], 0), owner))]
    few = np.minimum(n, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + meets)
    kept = np.arange(len(shingles)) - np.repeat(bounds[:-1], n) < np.repeat(few, n)
    return shingles[kept].astype(np.uint32).view(np.int32), np.r_[0, np.cumsum(few)]


def usual_shingles(texts: DataFrame, words: int, sample: int, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, their uses) of about ``sample`` texts, chosen by hash, where ``least`` or more of these have them.

    They only settle the order of shingles, that is how much work is done and not what is found.
    """
    n = texts.count()
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))).select("text").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                yield pa.RecordBatch.from_arrays([pa.array(shingler(b.column(0).slice(lo, 1000).to_pylist())[0].view(np.int64))], names=["s"])

    rows = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least).toPandas()  # at most the shingles of ``sample`` texts / ``least``
    usual = rows.s.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(usual)
    return usual[order], rows.n.to_numpy(np.int64)[order]


def fingerprints(texts: DataFrame, words: int, similarity: float, meets: int, sample: int) -> DataFrame:
    """(id, set_key, n, sketch, firsts) of each (id, text) with at least one shingle."""
    order = texts.sparkSession.sparkContext.broadcast(usual_shingles(texts, words, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(words)
        usual, uses = order.value
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                flat, bounds = shingler(part.column(1).to_pylist())
                keep = np.flatnonzero(np.diff(bounds))
                if not len(keep):
                    continue
                bounds = np.r_[bounds[keep], len(flat)]
                firsts, edges = first_shingles(flat, bounds, similarity, meets, usual, uses)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep)),
                        pa.array([xxhash.xxh3_128_digest(flat[i:j].tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array([x.tobytes() for x in sketch(flat, bounds)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(firsts)),
                    ],
                    names=["id", "set_key", "n", "sketch", "firsts"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts).mapInArrow(run, f"id {kind}, set_key binary, n int, sketch binary, firsts array<int>")


# What a bucket row says beside its id, in one number: size of the set and place of the shingle, 30 bits each; in a block of two parts also which part.
_CROSS, _SIDE, _SIZE = 62, 61, 30


def _bucket_pairs(similarity: float, meets: int, block: int = 1 << 18):
    """Rows (bucket, id, packed) in the order of bucket to the pairs (a, b) of each that may be similar by their sizes and by what is left after the place.

    In a block of two parts of a hot bucket sets of one part are compared with those of the other.  Pairs go out block by block;
    a pair of sets so small that they need fewer meetings goes out more than once, so that it reaches the number too.
    """

    def pairs(packed: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, pos = packed >> _SIZE & ((1 << 30) - 1), packed & ((1 << 30) - 1)
        cross, side = packed >> _CROSS & 1 == 1, packed >> _SIDE & 1
        # All buckets at once, each in the order of size: the partners of a set are a run of those after it.
        sizes = np.diff(np.r_[starts, len(n)])
        bucket = np.repeat(np.arange(len(starts)), sizes)
        at = np.lexsort((n, bucket))
        wide = int(n.max()) + 1
        key = bucket * wide + n[at]
        last = np.searchsorted(key, bucket * wide + np.minimum(np.floor(n[at] / similarity + 1e-9).astype(np.int64), wide - 1), "right")
        counts = np.maximum(last - np.arange(len(at)) - 1, 0)
        total, edge = np.cumsum(counts), 0
        while edge < len(at):
            done = total[edge - 1] if edge else 0
            stop = max(edge + 1, int(np.searchsorted(total, done + block, "right")))
            c = counts[edge:stop]
            left = np.repeat(np.arange(edge, stop), c)
            right = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + left + 1
            a, b = at[left], at[right]
            common = np.ceil((n[a] + n[b]) * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)  # what similar sets of these sizes share
            kept = (~cross[a] | (side[a] != side[b])) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= common - meets + 1)
            a, b = a[kept], b[kept]
            if len(a):
                times = np.maximum(meets - common[kept], 0) + 1
                yield np.repeat(a, times), np.repeat(b, times)
            edge = stop

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        kind = None

        def emit(bucket: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in pairs(packed, starts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], kind), pa.array(ids[b], kind)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field(1).type
            rows = [b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            if cut:
                yield from emit(*(x[:cut] for x in rows))
            rest = [x[cut:] for x in rows]
        if rest is not None and len(rest[0]):
            yield from emit(*rest)

    return run


def _close_sketches(similarity: float):
    """Rows (a, na, sa, b, nb, sb) to the pairs (a, b) whose sketches are within the radius of the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            total = b.column(1).to_numpy().astype(np.int64) + b.column(4).to_numpy()
            sketches = np.frombuffer(b"".join([*b.column(2).to_pylist(), *b.column(5).to_pylist()]), np.uint8).reshape(-1, BITS // 8)
            at = np.arange(b.num_rows)
            # similar: |difference| <= (1 - s) / (1 + s) * (|a| + |b|)
            ok = within(sketches, at, at + b.num_rows, np.floor(total * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(3).take(keep)], names=["a", "b"])

    return run


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                flat, bounds = shingler(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "shingles"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, shingles array<long>")


def similar_classes(heads: DataFrame, texts: DataFrame, words: int, similarity: float, meets: int, part: int) -> DataFrame:
    """(a, b), a < b: pairs of the fingerprints ``heads`` of at least ``similarity``, verified on the shingles of their texts."""
    kind = heads.schema["id"].dataType.simpleString()
    packed = F.shiftleft(F.col("n").cast("long"), _SIZE).bitwiseOR(F.col("pos").cast("long"))
    posted = heads.select(F.posexplode("firsts").alias("pos", "key"), "id", "n").select("key", "id", packed.alias("packed"))
    # Hot keys are looked for in one of 16 sets: a key missed by chance is worked on unsplit, which changes no result.
    some = heads.filter(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).select(F.explode("firsts").alias("key"))
    hot = stage(some.groupBy("key").agg((F.count("*") * 16).alias("m")).filter(F.col("m") > part))
    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(buckets: DataFrame) -> DataFrame:
        rows = buckets.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "id", "packed")
        return rows.mapInArrow(_bucket_pairs(similarity, meets), f"a {kind}, b {kind}")

    plain = F.col("key").cast("long").alias("bucket")
    if hot.isEmpty():
        meetings = met(posted.select(plain, "id", "packed"))
    else:
        # A bucket of more than ``part`` sets is cut into c parts; block (i, j) compares part i with part j, (i, i) with itself.
        c = F.ceil(F.col("m") / part).cast("int")
        own = F.pmod(F.xxhash64("id"), c).cast("int")
        i, j = F.least("own", "other"), F.greatest("own", "other")
        marks = F.when(i < j, F.lit(1 << _CROSS)).otherwise(0).bitwiseOR(F.when(F.col("own") > F.col("other"), F.lit(1 << _SIDE)).otherwise(0))
        blocks = (
            posted.join(hot, "key")
            .select("key", "id", "packed", c.alias("c"), own.alias("own"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
            .select(F.xxhash64("key", i, j).alias("bucket"), "id", F.col("packed").bitwiseOR(marks).alias("packed"))
        )
        meetings = met(posted.join(hot, "key", "left_anti").select(plain, "id", "packed")).unionByName(met(blocks))
    counted = meetings.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("m"))
    candidates = counted.filter((F.col("a") != F.col("b")) & (F.col("m") >= meets)).select("a", "b")
    side = lambda x: heads.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    close = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(_close_sketches(similarity), f"a {kind}, b {kind}")
    pairs = stage(close.dropDuplicates(["a", "b"]))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = _shingle_sets(texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), words)
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(few.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(few.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("all"))
        .filter(F.col("common") >= similarity * F.col("all"))
        .select("a", "b")
    )


def near_duplicates(df: DataFrame, id_col: str, text: Column, words: int = 5, similarity: float = 0.8, meets: int = 4, sample: int = 8000, part: int = 2048, few: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class_id) of every text with a shingle, and (a, b) of all pairs of classes of at least ``similarity``.

    A class is a set of texts with the same shingles, named by its smallest id.  No similar pair is lost.  ``sample`` texts
    settle which shingles count as usual and come last in the order.  Texts that are null or shorter than a shingle are in
    no class; repeated rows count once; ids are taken to name one text each.  Hot classes cost one comparison; hot buckets are cut into blocks.
    """
    texts = df.select(F.col(id_col).alias("id"), text.alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    prints = stage(fingerprints(texts, words, similarity, meets, sample))
    classes = prints.groupBy("set_key").agg(F.min("id").alias("class_id"))
    members = stage(prints.select("id", "set_key").join(classes, "set_key").select("id", "class_id").distinct())
    others = members.filter("id <> class_id").select("id")
    if others.count() <= few:  # so many ids are broadcast at most, beyond that they are joined by a shuffle
        others = F.broadcast(others)
    heads = stage(prints.select("id", "n", "sketch", "firsts").join(others, "id", "left_anti"))
    return members, similar_classes(heads, texts, words, similarity, meets, part)


def expand(members: DataFrame, links: DataFrame, part: int = 1000) -> DataFrame:
    """(text_a, text_b), text_a < text_b: every pair of similar texts, those of one class included.

    The pairs of a class, and those of two linked classes, are as many as its texts squared; a class is cut into parts of
    about ``part`` texts, so that no task pairs more than a part with a part.
    """
    sizes = members.groupBy("class_id").agg(F.ceil(F.count("*") / part).cast("int").alias("c"))
    cut = members.join(sizes, "class_id").withColumn("p", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    one = cut.select(F.col("class_id").alias("a"), F.col("p").alias("pa"), F.col("id").alias("x"))
    two = cut.select(F.col("class_id").alias("b"), F.col("p").alias("pb"), F.col("id").alias("y"))
    spans = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    of = lambda x: sizes.select(F.col("class_id").alias(x), F.col("c").alias(f"c{x}"))
    linked = links.join(of("a"), "a").join(of("b"), "b").withColumn("pa", spans("ca")).withColumn("pb", spans("cb"))
    between = linked.join(one, ["a", "pa"]).join(two, ["b", "pb"]).select("x", "y")
    own = of("a").withColumn("pa", spans("ca")).withColumn("b", F.col("a")).withColumn("pb", spans("ca"))
    inside = own.join(one, ["a", "pa"]).join(two, ["b", "pb"]).filter("x < y").select("x", "y")
    return between.unionByName(inside).select(F.least("x", "y").alias("text_a"), F.greatest("x", "y").alias("text_b"))
