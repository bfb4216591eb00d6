"""Counts of every distinct classification code by radix partitioning and out-of-core aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import let
from quillstone.llm.survivor import squeeze
from quillstone.session import shared_dir, stage


def canonical_code(c: Column) -> Column:
    """``A01B1/02`` of any spelling: letter case, blanks, edition in brackets, padded symbols; null where it is no code.

    Subgroups keep at least two digits.
    """
    bare = F.upper(F.regexp_replace(c, r"(?U)\([^)]*\)?|[\s\u200b\ufeff]+", ""))

    def code(t: Column) -> Column:
        plain = F.regexp_replace(t, "^(.{4})0+(?=[0-9])", "$1")
        padded = F.regexp_replace(t, "^(.{4})0{0,3}([0-9]{1,4})(?<=^.{8})([0-9]{2})([0-9]*?)0*$", "$1$2/$3$4")
        return F.when(t.rlike("^[A-HY][0-9]{2}[A-Z]0*[0-9]{1,4}/[0-9]{2,6}$"), plain).when(t.rlike("^[A-HY][0-9]{2}[A-Z][0-9]{10}$"), padded)

    return let(bare, code)


def code_uses(clean: DataFrame) -> DataFrame:
    """(term, app, uses): each use of a code in a record with an application number."""
    codes = F.concat(F.coalesce("ipcr_classification", F.array().cast("array<string>")), F.array("primary_ipc"))
    spelled = clean.select(squeeze(F.col("application_number")).alias("app"), F.explode(codes).alias("raw")).filter("app <> '' AND raw IS NOT NULL")
    return spelled.select(canonical_code(F.col("raw")).alias("term"), "app", F.lit(1).cast("long").alias("uses")).filter("term IS NOT NULL")


def _duck(spill: str | None, memory_mb: int):
    """Rows (radix, term, member) in the order of radix to (term, uses, members): one DuckDB table a radix, which spills where it outgrows its memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": False, **({"temp_directory": spill} if spill else {"max_temp_directory_size": "0B"})})

        def count() -> Iterator[pa.RecordBatch]:
            yield from con.sql("SELECT term, sum(uses)::BIGINT AS uses, count(DISTINCT member)::BIGINT AS members FROM part GROUP BY 1").to_arrow_table().to_batches(max_chunksize=20_000)

        now = None
        for b in batches:
            radix = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(radix[1:] != radix[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if radix[lo] != now:
                    if now is not None:
                        yield from count()
                    con.execute("CREATE OR REPLACE TABLE part (term VARCHAR, member VARCHAR, uses BIGINT)")
                    now = radix[lo]
                con.register("b", pa.Table.from_batches([b.slice(lo, hi - lo)]))
                con.execute("INSERT INTO part SELECT term, member, sum(uses) FROM b GROUP BY 1, 2")
                con.unregister("b")
        if now is not None:
            yield from count()
        con.close()

    return run


def term_counts(uses: DataFrame, bits: int = 6, split_rows: int = 2_000_000, memory_mb: int = 256) -> DataFrame:
    """(term, uses, members) of every distinct term over (term, member[, uses]): how often it occurs and in how many members.

    Terms are partitioned by ``bits`` bits of their hash.  A partition of more than ``split_rows`` rows is split by the next
    bits, again and again while it holds several terms; one hot term that is still too large is split by bits of the member's hash, so
    that the parts' distinct members are disjoint and part counts add up exactly.  Spark's shuffle files are the partitions on
    disk; each is one DuckDB table under ``memory_mb``, which spills to the shared folder.  Null terms or members are ignored.

    The driver sees one row a partition of at most 2^bits, and per level those of the oversized ones.
    """
    spark = uses.sparkSession
    rows = uses.filter("term IS NOT NULL AND member IS NOT NULL").select("term", "member", (F.col("uses") if "uses" in uses.columns else F.lit(1)).cast("long").alias("uses"))
    hashed = F.xxhash64("term")
    radix, depth = F.shiftrightunsigned(hashed, 64 - bits), bits
    sizes = rows.groupBy(radix.alias("radix")).agg(F.count("*").alias("n"), F.min("term").alias("a"), F.max("term").alias("b")).collect()  # at most 2^bits rows
    found = [(r.radix, depth, r.n, r.a == r.b) for r in sizes]
    leaves: list[tuple[int, int, int]] = []  # radix, its bits, parts by member
    while found:
        leaves += [(r, d, 1) for r, d, n, _ in found if n <= split_rows] + [(r, d, -(-n // split_rows)) for r, d, n, one in found if n > split_rows and (one or d + bits > 63)]
        large = [r for r, d, n, one in found if n > split_rows and not one and d + bits <= 63]
        if not large:
            break
        mine = F.shiftrightunsigned(hashed, 64 - depth).isin(large)
        depth += bits
        deeper = rows.filter(mine).groupBy(F.shiftrightunsigned(hashed, 64 - depth).alias("radix")).agg(F.count("*").alias("n"), F.min("term").alias("a"), F.max("term").alias("b")).collect()
        found = [(r.radix, depth, r.n, r.a == r.b) for r in deeper]
    # A row's partition is its leaf: the number of the leaf, and of the part by member.
    leaf = F.lit(None).cast("int")
    split = F.lit(1)
    first = 0
    for d in sorted({d for _, d, _ in leaves}):
        own = [(r, p) for r, x, p in leaves if x == d]
        at = F.shiftrightunsigned(hashed, 64 - d)
        leaf = F.coalesce(leaf, F.create_map(*[F.lit(x) for i, (r, _) in enumerate(own) for x in (r, first + i)])[at])
        many = [(r, p) for r, p in own if p > 1]
        if many:
            split = F.coalesce(F.create_map(*[F.lit(x) for r, p in many for x in (r, p)])[at], split)
        first += len(own)
    url = urlparse(shared_dir(spark))
    spill = f"{url.path}/radix-spill" if url.scheme in ("", "file") else None  # where the folder is no path, a part must fit in memory
    part = F.pmod(F.xxhash64("member"), split).cast("int")
    total = sum(p for _, _, p in leaves)
    n = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in sizes) // split_rows))))
    parts = rows.select((leaf.cast("long") * 65536 + part).alias("radix"), "term", "member", "uses").repartition(n, "radix").sortWithinPartitions("radix")
    counted = parts.mapInArrow(_duck(spill, memory_mb), "term string, uses long, members long")
    return counted.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("members").alias("members"))


def marked_codes(clean: DataFrame, rare: int = 2, common: float = 0.05) -> DataFrame:
    """(code, uses, applications, mark): every distinct code; mark is ``rare``, ``common`` or null.

    Rows without an application number don't count, values that are no code don't either.
    """
    apps = clean.select(squeeze(F.col("application_number")).alias("a")).filter("a <> ''").agg(F.count_distinct("a")).first()[0]
    counts = term_counts(stage(code_uses(clean).select("term", F.col("app").alias("member"), "uses")))
    mark = F.when(F.col("members") <= rare, "rare").when(F.col("members") >= common * apps, "common")
    return counts.select(F.col("term").alias("code"), "uses", F.col("members").alias("applications"), mark.alias("mark"))
