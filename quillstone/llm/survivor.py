"""The best representative of each group of documents, field by field, and a two-sided source quality model."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import stage

#: Document type codes, best first; all others rank alike after them.
RANKED_CODES = ["B9", "B2", "B1", "C1", "A2", "A1"]

#: Words of which a text that only says "there is no text here" is made.
STAND_IN_WORDS = """
a abridgement abridgment absent abstract advised after also an and announced any applicable applicant are as at attached available
awaiting awaited be been being below blank but by claim claims confirmed currently data description document documents drawing
drawings due empty entered error exist exists expected false field figures file filed follow following follows for found from
full furnished given has have here herein in include included information is issued it know known language later lodged lost
missing n na nan nil no none not nothing null of office omitted on only or page patent pending placeholder please prepared present
provided publication published publish received record recorded refer reference required same see shown soon specification
specifications submitted summary supplied tba tbc tbd technical text the there this time title to unavailable undefined under
unknown unpublished void was were will with withheld without xxx yet
""".split()


def squeeze(c: Column) -> Column:
    """A key without any white space; empty for null."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"(?U)\s+", ""), F.lit(""))


def strip(c: Column) -> Column:
    """The text without white space and invisible characters at either end; empty for null."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^[\s​-‍⁠﻿]+|[\s​-‍⁠﻿]+$", ""), F.lit(""))


def holds_text(c: Column) -> Column:
    """Whether a text isn't null and has more than white space and invisible characters."""
    return F.coalesce(c.rlike(r"(?U)[^\s​-‍⁠﻿]"), F.lit(False))


def words_of(text: Column) -> Column:
    """Distinct words of letters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))


def is_stand_in(text: Column, words: Column | None = None) -> Column:
    """Whether a trimmed text is made of nothing but STAND_IN_WORDS and marks, with no digit."""
    bare = ~text.rlike(r"[\p{L}\p{N}]")
    words = words_of(text) if words is None else words
    return bare | (~text.rlike(r"\p{N}") & (F.size(F.array_except(words, F.array(*[F.lit(w) for w in STAND_IN_WORDS]))) == 0))


# What speaks for or against a text being this document's own: sources of the latent model, by bit, and what is believed of their sensitivity and specificity.
WITNESSES = {"seldom": (0.95, 0.5), "title": (0.8, 0.8), "claim": (0.8, 0.8), "words": (0.99, 0.95)}


def documents_of(clean: DataFrame) -> DataFrame:
    """One row a document that is there, with its record's number, title and times; rows without an application number are left out."""
    title = F.col("invention_title") if "invention_title" in clean.columns else F.lit(None).cast("string").alias("invention_title")
    return (
        clean.select(squeeze(F.col("application_number")).alias("application_number"), "rec_id", "fetched_at", title, "published_documents")
        .filter("application_number <> ''")
        .select("application_number", "rec_id", "fetched_at", "invention_title", F.posexplode("published_documents").alias("pos", "d"))
        .filter("d IS NOT NULL")
        .withColumn("abstract", strip(F.col("d.abstract")))
    )


def value_key(text: Column) -> Column:
    """One number for a text whatever its case, blanks and marks."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def usual_values(texts: DataFrame, column: str, share: float = 1e-4, least: int = 10) -> list[int]:
    """Keys of the texts that more than ``least`` and a ``share`` of all rows have: at most 1 / share of them."""
    counts = stage(texts.filter(F.col(column) != "").groupBy(value_key(F.col(column)).alias("k")).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.k for r in counts.filter(F.col("n") > least + share * total).select("k").collect()]


def testimony(docs: DataFrame, usual: list[int]) -> DataFrame:
    """Documents with ``told`` (claims, speaks; null without an abstract), bits of WITNESSES: who says that the abstract is the document's own, and who has anything to say."""
    bit = lambda i, c: F.when(c, F.lit(1 << i)).otherwise(0)
    own = F.col("_words")
    first = F.coalesce(F.get(F.filter("d.claims", lambda c: F.length(c) > 0), F.lit(0)), F.lit(""))
    shared = lambda other, n: F.size(F.array_intersect(F.filter(own, lambda w: F.length(w) > 3), F.array_except(words_of(other), F.array(*[F.lit(w) for w in STAND_IN_WORDS])))) >= n
    title = F.coalesce("invention_title", F.lit(""))
    seldom = ~value_key(F.col("abstract")).isin(usual) if usual else F.lit(True)
    with_words = docs.withColumn("_words", words_of(F.col("abstract")))
    said = bit(0, seldom) + bit(1, shared(title, 1)) + bit(2, shared(first, 2)) + bit(3, ~is_stand_in(F.col("abstract"), own))
    speaks = F.lit(9) + bit(1, title.rlike(r"\p{L}")) + bit(2, first.rlike(r"\p{L}"))
    return with_words.withColumn("told", F.when(F.col("abstract") != "", F.struct(said.bitwiseAND(speaks).alias("claims"), speaks.alias("speaks")))).drop("_words")


def own_abstract(docs: DataFrame) -> Column:
    """Whether a document's abstract is its own rather than a stand-in: P >= 0.5 under the latent model over (claimed, speaks), fitted on all documents."""
    patterns = docs.filter("speaks IS NOT NULL").groupBy("claimed", "speaks").agg(F.count("*").alias("n")).collect()  # at most 3^4 rows
    model = Quality.fit([(bits(r.claimed), bits(r.speaks), r.n) for r in patterns], Quality.start(len(WITNESSES), believed=list(WITNESSES.values()), weight=20))
    true = [r.claimed * 16 + r.speaks for r in patterns if model.p_true(bits(r.claimed), bits(r.speaks)) >= 0.5]
    return (F.col("claimed") * 16 + F.col("speaks")).isin(true) if true else F.lit(False)


def best_documents(clean: DataFrame) -> DataFrame:
    """One row per application with two or more documents: where its claims and its abstract are best taken from.

    Whether an abstract is real is judged by the latent two-sided model: four witnesses (is the text seldom, does it share words
    with the title, with the first claim, is it more than words of absence) with sensitivities and specificities
    inferred by expectation-maximisation.  Among what is judged real, documents compete by (type rank, claims that aren't blank, length of the abstract, fetched_at, rec_id, place); see
    TESTDATA.md, p2_found.  Rows without an application number and null list elements don't count; a null list is
    empty; fetched_at null sorts last; repeated rows compete like any others.  -1, -1: no document has the field.

    Each row is reduced to its own best before the shuffle (no text moves) and partial maxima are merged map-side, so
    an application with a third of all rows costs one row per input partition.
    """
    code = F.upper(F.regexp_replace(F.coalesce(F.col("d.document_type_code"), F.lit("")), r"(?U)[^\p{L}\p{N}]+", ""))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in RANKED_CODES]), code), F.lit(0))
    found = documents_of(clean)
    told = testimony(found, usual_values(found.select("abstract"), "abstract"))
    # What the choice needs of each document, without its texts: read once for the model and once for the choice.
    docs = told.select(
        "application_number",
        "rec_id",
        "fetched_at",
        "pos",
        F.when(rank == 0, -len(RANKED_CODES) - 1).otherwise(-rank).cast("int").alias("rank"),
        F.size(F.filter(F.coalesce("d.claims", F.array().cast("array<string>")), holds_text)).alias("claims"),
        F.coalesce("d.claims_parse_ok", F.lit(True)).alias("ok"),
        F.length("abstract").alias("length"),
        F.col("told.claims").alias("claimed"),
        F.col("told.speaks").alias("speaks"),
    )
    docs = stage(docs)
    docs = docs.withColumn("chars", F.when(own_abstract(docs), F.col("length")).otherwise(0))
    order = F.struct("rank", "claims", "chars", "fetched_at", (-F.col("rec_id")).alias("r"), (-F.col("pos")).alias("p"))
    best = docs.groupBy("application_number").agg(
        F.count("*").alias("n"), F.max(F.when((F.col("claims") > 0) & F.col("ok"), order)).alias("c"), F.max(F.when(F.col("chars") > 0, order)).alias("a")
    )
    at = lambda s, f: F.coalesce(-F.col(f"{s}.{f}"), F.lit(-1)).cast("long")
    return best.filter("n >= 2").select("application_number", at("c", "r").alias("claims_rec"), at("c", "p").alias("claims_pos"), at("a", "r").alias("abstract_rec"), at("a", "p").alias("abstract_pos"))


def bits(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(mask.bit_length()) if mask >> i & 1)


@dataclass
class Quality:
    """Sensitivity P(claims | true) and specificity P(denies | false) of each source, and the prior of a value being true.

    ``believed`` are both before anything is seen, which count as ``weight`` observations.
    """

    sensitivity: list[float]
    specificity: list[float]
    prior: float
    believed: tuple[tuple[float, ...], tuple[float, ...]]
    weight: float

    @classmethod
    def start(cls, k: int, prior: float = 0.5, believed: Sequence[tuple[float, float]] | None = None, weight: float = 1.25) -> Quality:
        sens, spec = zip(*believed) if believed else ((0.8,) * k, (0.9,) * k)
        return cls(list(sens), list(spec), prior, (tuple(sens), tuple(spec)), weight)

    def p_true(self, claims: Sequence[int], speaks: Sequence[int]) -> float:
        """P(true) of a value that ``claims`` claim, out of the sources that speak."""
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for i in speaks:
            s, f = self.sensitivity[i], self.specificity[i]
            odds += math.log(s) - math.log(1 - f) if i in claims else math.log(1 - s) - math.log(f)
        return 1 / (1 + math.exp(-min(700, max(-700, odds))))

    def update(self, sums: dict[int, tuple[float, float, float, float]], true: float, total: float) -> Quality:
        """From sums by source (claimed and true, true, denied and false, false); what was believed keeps all off 0 and 1."""
        w, none = self.weight, (0.0, 0.0, 0.0, 0.0)
        got = [sums.get(i, none) for i in range(len(self.sensitivity))]
        return replace(
            self,
            sensitivity=[(w * b + x[0]) / (w + x[1]) for b, x in zip(self.believed[0], got)],
            specificity=[(w * b + x[2]) / (w + x[3]) for b, x in zip(self.believed[1], got)],
            prior=(true + 1) / (total + 2),
        )

    def close_to(self, other: Quality, by: float = 1e-7) -> bool:
        return all(abs(a - b) < by for a, b in zip([*self.sensitivity, *self.specificity, self.prior], [*other.sensitivity, *other.specificity, other.prior]))

    @classmethod
    def fit(cls, counts: Sequence[tuple[Sequence[int], Sequence[int], int]], model: Quality, rounds: int = 50) -> Quality:
        """Expectation-maximisation over (claims, speaks, how often), from a model to start with."""
        for _ in range(rounds):
            sums: dict[int, list[float]] = {}
            total = true = 0.0
            for claims, speaks, n in counts:
                p = model.p_true(claims, speaks)
                total, true = total + n, true + n * p
                for i in speaks:
                    y = i in claims
                    for j, x in enumerate((n * p * y, n * p, n * (1 - p) * (not y), n * (1 - p))):
                        sums.setdefault(i, [0.0] * 4)[j] += x
            last, model = model, model.update(sums, true, total)
            if model.close_to(last):
                break
        return model

    def column(self) -> Column:
        """p_true of the columns ``claims`` and ``speaks`` (array<int>)."""
        doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        yes = doubles(math.log(s) - math.log(1 - f) for s, f in zip(self.sensitivity, self.specificity))
        no = doubles(math.log(1 - s) - math.log(f) for s, f in zip(self.sensitivity, self.specificity))
        said = lambda i: F.when(F.array_contains("claims", i), F.get(yes, i)).otherwise(F.get(no, i))
        odds = F.aggregate("speaks", F.lit(math.log(self.prior) - math.log(1 - self.prior)), lambda s, i: s + said(i))
        return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))


def source_quality(votes: DataFrame, sources: Sequence[str], rounds: int = 50, prior: float = 0.5, driver_sources: int = 12) -> tuple[dict[str, tuple[float, float]], DataFrame]:
    """Latent two-sided source quality: sensitivity and specificity of each source, and P(true) of each value.

    ``votes`` has entity, value, source.  A source that speaks of an entity claims some of the values claimed for
    it and, silently, denies the rest.  Each (entity, value) is a binary latent truth; expectation-maximisation
    infers it together with every source's sensitivity P(claims | true) and specificity P(denies | false), so an
    entity keeps every value judged true.  A value is reduced to its pattern of claims and silence, and the data are read once to
    count patterns.  Up to ``driver_sources`` sources (at most 3^12 patterns) EM runs over the counts on the driver; with
    more, of any number, each round is an aggregation of the table of patterns.

    Returns {source: (sensitivity, specificity)} and (entity, value, p_true).  Nulls and unknown sources are
    ignored; repeated votes count once; an empty table gives the starting values.
    """
    spark = votes.sparkSession
    k = len(sources)
    number = spark.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, i int")
    known = votes.filter("entity IS NOT NULL AND value IS NOT NULL").join(F.broadcast(number), "source").select("entity", "value", "i")  # one row a source
    per_value = known.groupBy("entity", "value").agg(F.array_sort(F.collect_set("i")).alias("claims"))
    speaking = known.groupBy("entity").agg(F.array_sort(F.collect_set("i")).alias("speaks"))
    pattern = per_value.join(speaking, "entity")
    counted = pattern.groupBy("claims", "speaks").agg(F.count("*").alias("n"))
    if k <= driver_sources:
        model = Quality.fit([(r.claims, r.speaks, r.n) for r in counted.collect()], Quality.start(k, prior), rounds)
    else:
        table, model = stage(counted), Quality.start(k, prior)
        for _ in range(rounds):
            scored = table.withColumn("p", model.column())
            n, p, y = F.col("n"), F.col("p"), F.array_contains("claims", F.col("i")).cast("double")
            total = scored.agg(F.sum(n * p), F.sum("n")).first()
            if not total[1]:
                break
            each = scored.select("n", "p", "claims", F.explode("speaks").alias("i")).groupBy("i").agg(F.sum(n * p * y), F.sum(n * p), F.sum(n * (1 - p) * (1 - y)), F.sum(n * (1 - p))).collect()  # one row a source
            last, model = model, model.update({r[0]: r[1:] for r in each}, total[0], total[1])
            if model.close_to(last):
                break
    return {s: (model.sensitivity[i], model.specificity[i]) for i, s in enumerate(sources)}, pattern.select("entity", "value", model.column().alias("p_true"))
