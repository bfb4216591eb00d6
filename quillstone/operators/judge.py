"""Verdicts of a judging model: prompts, parsing, reports that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import present, strip

# What replaces the end of a text that is cut, and the members of meta a judge may see.
CUT, CUT_ROOM = "\n…[truncated]…", 20
SHOWN = ["primary_ipc", "ipc_title", "has_definition_entry", "document_type"]


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(present(c)) > most, F.concat(F.substring(present(c), 1, most - CUT_ROOM), F.lit(CUT))).otherwise(present(c))


def payload(most: int = 12_000) -> Column:
    """What the judge sees, as JSON: no model or provider, null members of meta left out, long texts cut."""
    meta = F.struct(*[F.col(f"meta.{k}").alias(k) for k in SHOWN])
    texts = [cut(F.col(k), most).alias(k) for k in ("instruction", "input", "output")]
    return F.to_json(F.struct("task", "application_number", *texts, meta.alias("meta")))


def messages(system: str, body: Column) -> Column:
    """The chat that a judge is sent: array<struct<role, content>> of the instructions and a record's payload."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", body))


def in_meta(rows: DataFrame, block: str) -> DataFrame:
    """A block (``validation``, ``llm_judge``) as a member of ``meta``; a missing meta is made."""
    return rows.withColumn("meta", F.coalesce("meta", F.from_json(F.lit("{}"), rows.schema["meta"].dataType)).withField(block, F.col(block))).drop(block)


def parse_json_reply(reply: Column) -> Column:
    """The JSON value of a model's reply as VARIANT: without a code fence, else its outermost list, else its outermost object."""
    bare = strip(F.regexp_replace(strip(present(reply)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    span = lambda a, b: F.regexp_extract(bare, rf"(?s)\{a}.*\{b}", 0)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(span("[", "]")), F.try_parse_json(span("{", "}")))


def verdict(reply: Column, pass_score: int = 4) -> Column:
    """struct<score, pass, rationale, failure_tags> of a reply; null where it has no score from 1 to 5.

    A boolean ``pass`` wins over the score; tags that are no list become a list of one.
    """
    v = parse_json_reply(reply)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    kind = lambda k: F.schema_of_variant(get(k))
    number = F.try_variant_get(v, "$.score", "double")
    score = F.when(kind("score") == "STRING", strip(F.try_variant_get(v, "$.score", "string")).try_cast("int")).otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int"))
    said = F.when(kind("pass") == "BOOLEAN", F.try_variant_get(v, "$.pass", "boolean")).otherwise(score >= pass_score)
    raw = get("failure_tags")
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    tags = F.when(F.schema_of_variant(raw).startswith("ARRAY"), F.transform(F.try_variant_get(raw, "$", "array<variant>"), text)).when(raw.isNull() | F.is_variant_null(raw), F.array().cast("array<string>")).otherwise(F.array(text(raw)))
    return F.when(
        score.between(1, 5),
        F.struct(score.alias("score"), said.alias("pass"), strip(present(F.try_variant_get(v, "$.rationale", "string"))).alias("rationale"), tags.alias("failure_tags")),
    )


def judged(sampled: DataFrame, reply: str, judge_model: str, judge_provider: str) -> DataFrame:
    """Rows with meta.llm_judge; a reply that can't be used leaves it null (an error, to be tried again)."""
    v = verdict(F.col(reply))
    block = F.when(v.isNotNull(), F.struct(*[v[k].alias(k) for k in ("score", "pass", "rationale", "failure_tags")], F.lit(judge_model).alias("judge_model"), F.lit(judge_provider).alias("judge_provider")))
    return sampled.withColumn("llm_judge", block)


def judge_report(rows: DataFrame) -> DataFrame:
    """(task, judged, errors, score_sum, mean_score, passed, pass_rate) of rows with llm_judge."""
    j = F.col("llm_judge")
    return rows.groupBy("task").agg(
        F.count(j).alias("judged"),
        F.count_if(j.isNull()).alias("errors"),
        F.coalesce(F.sum(j["score"]), F.lit(0)).alias("score_sum"),
        F.count_if(j["pass"]).alias("passed"),
    ).withColumns({"mean_score": F.round(F.try_divide(F.col("score_sum"), F.col("judged")), 6), "pass_rate": F.round(F.try_divide(F.col("passed"), F.col("judged")), 6)})


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.select("task", F.explode("llm_judge.failure_tags").alias("tag")).groupBy("task", "tag").agg(F.count("*").alias("n"))


def merge_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two reports as one: sums are kept, so merging equals judging all rows at once; errors add up."""
    both = old.select("task", "judged", "errors", "score_sum", "passed").unionByName(new.select("task", "judged", "errors", "score_sum", "passed"))
    sums = both.groupBy("task").agg(*[F.sum(c).alias(c) for c in ("judged", "errors", "score_sum", "passed")])
    return sums.withColumns({"mean_score": F.round(F.try_divide(F.col("score_sum"), F.col("judged")), 6), "pass_rate": F.round(F.try_divide(F.col("passed"), F.col("judged")), 6)})
