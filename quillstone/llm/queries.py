"""The queries of this subpackage, by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import defects, leak, neardup, quality, scans, survivor, terms, tokens
from quillstone.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_documents(table(spark, d, "patent_clean"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_codes(table(spark, d, "patent_clean")).filter("mark IS NOT NULL").select("code", "mark")


def p2_source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Classification codes of each application judged true over its repeated records, records voting by their source.

    A source is the kind of document a record ends in: the best ranked code among its published documents.
    """
    clean = table(spark, d, "patent_clean")
    codes = F.transform(F.coalesce("published_documents", F.array().cast(clean.schema["published_documents"].dataType)), lambda p: F.upper(F.regexp_replace(p["document_type_code"], r"(?U)[^\p{L}\p{N}]+", "")))
    source = F.coalesce(F.get(F.filter(F.array(*[F.lit(c) for c in survivor.RANKED_CODES]), lambda c: F.array_contains(codes, c)), F.lit(0)), F.lit("other"))
    votes = clean.select(survivor.squeeze(F.col("application_number")).alias("entity"), F.explode("ipcr_classification").alias("raw"), source.alias("source")).filter("entity <> ''")
    _, judged = survivor.source_quality(votes.select("entity", terms.canonical_code(F.col("raw")).alias("value"), "source"), [*survivor.RANKED_CODES, "other"])
    return judged.filter("p_true >= 0.5").select(F.col("entity").alias("application_number"), F.col("value").alias("code"), F.round("p_true", 6).alias("p_true"))


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, "patent_text"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "patent_text")
    return scans.scan_noise(table(spark, d, "claims_scans"), [(texts, "claims_text"), (texts, "abstract")])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("scan_id", F.explode("kinds").alias("noise"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("scan_id", F.col("repaired").alias("claims_text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), lang_col="lang").filter("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), lang_col="lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(table(spark, d, "instructions"), table(spark, d, "documents").select("text", "lang"))


def p5_code_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_codes(table(spark, d, "patent_clean"))


def _near_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, d, "patent_text").filter(survivor.holds_text(F.col("abstract")) & survivor.holds_text(F.col("claim_1")))
    return neardup.near_duplicates(texts, "text_id", F.concat_ws(" ", "abstract", "claim_1"), words=3, similarity=0.5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand(*_near_texts(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each text with its class of equal shingles and the number of other classes that are similar to it."""
    members, links = _near_texts(spark, d)
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(degree, "class_id", "left").select(F.col("id").alias("text_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.verbatim(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_paraphrased(spark: SparkSession, d: str) -> DataFrame:
    return leak.paraphrased(table(spark, d, "documents"), table(spark, d, "eval_items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_source_quality, p3_token_budget, p4_found, p5_found, p5_code_counts, p6_found, p6_classes, p7_found, p7_repaired, p8_ids, p9_found, p9_paraphrased, p10_found, p10_statistics)}
