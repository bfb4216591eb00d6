"""Validation of instruction records and merging of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.ipc import answer_body, classification_failures
from quillstone.functions.overlap import answer_contained, rouge_l_f1, token_f1
from quillstone.functions.text import is_blank, present, strip, tokens

# Thresholds below which a record fails.
FLOORS = {"semantic_cosine": 0.15, "rouge_l_f1": 0.02, "mrc_token_f1": 0.1}
REQUIRED = ["task", "application_number", "instruction", "input", "output", "meta"]


def schema_failures(v: Column, expected_task: Column | None = None) -> Column:
    """Failures of a record given as VARIANT: missing members end the check; blank texts, another task, a meta that is no object."""
    there = {k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in REQUIRED}
    missing = F.array_compact(F.array(*[F.when(~there[k], f"missing_key:{k}") for k in REQUIRED]))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    rules = [F.when((kind(k) != "STRING") | is_blank(text(k)), f"empty:{k}") for k in ("instruction", "input", "output", "application_number")]
    if expected_task is not None:
        rules.append(F.when(~text("task").eqNullSafe(expected_task), F.concat(F.lit("task_mismatch:"), F.coalesce(text("task"), F.lit("None")))))
    rules.append(F.when(~kind("meta").startswith("OBJECT"), "meta_not_object"))
    return F.when(F.size(missing) > 0, missing).otherwise(F.array_compact(F.array(*rules)))


def row_schema_failures(task: Column | None = None) -> Column:
    """The same rules for typed rows, where members can only be null."""
    rules = [F.when(is_blank(F.col(k)), f"empty:{k}") for k in ("instruction", "input", "output", "application_number")]
    if task is not None:
        rules.append(F.when(~F.col("task").eqNullSafe(task), F.concat(F.lit("task_mismatch:"), F.coalesce("task", F.lit("None")))))
    rules.append(F.when(F.col("meta").isNull(), "meta_not_object"))
    return F.array_compact(F.array(*rules))


def light_failures(task: Column) -> Column:
    """Checks by task: an abstract far longer than its claims; a question without a mark; an answer no shorter than the claims."""
    chars = lambda c: F.length(present(F.col(c)))
    drafting, reading = task == "abstract_drafting", task == "mrc"
    return F.array_compact(
        F.array(
            F.when(drafting & (chars("output") > F.greatest(2 * chars("input"), F.lit(50_000))), "output_too_long_vs_input"),
            F.when(reading & ~F.contains(present(F.col("instruction")), F.lit("?")), "mrc_instruction_not_question"),
            F.when(reading & (F.length(strip(present(F.col("output")))) >= F.length(strip(present(F.col("input"))))), "mrc_answer_not_shorter_than_claims"),
        )
    )


def length_features(given: Column, answer: Column) -> tuple[Column, Column, Column]:
    """Words of both, and their ratio (0 without input words)."""
    n_in, n_out = F.size(tokens(given)), F.size(tokens(answer))
    return n_in, n_out, F.coalesce(F.try_divide(n_out.cast("double"), n_in), F.lit(0.0))


def validate(pairs: DataFrame, semantic=None, rouge: bool = True, floors: dict[str, float] = FLOORS) -> DataFrame:
    """Rows with ``validation`` (passed, failed_rules, scores).

    Rules in order: schema, by task, classification, then floors; a null score never fails.  ``semantic``: a function
    of two columns that gives a cosine, or none.
    """
    task = present(F.col("task"))
    body = answer_body(F.col("output"))
    ipc, reading = task == "ipc_reasoning", task == "mrc"
    scored = F.when(ipc, body).otherwise(present(F.col("output")))
    known = (ipc & body.isNotNull()) | task.isin("abstract_drafting", "mrc")
    n_in, n_out, ratio = length_features(F.col("input"), F.coalesce(F.when(ipc, body), F.col("output")))
    score = {
        "len_input_tokens": n_in,
        "len_output_tokens": n_out,
        "compression_ratio": ratio,
        "rouge_l_f1": F.when(known, rouge_l_f1(present(F.col("input")), scored)) if rouge else F.lit(None).cast("double"),
        "token_f1": F.when(reading, token_f1(F.col("input"), F.col("output"))),
        "answer_contained": F.when(reading, answer_contained(F.col("output"), F.col("input"))),
        "semantic_cosine": F.when(known, semantic(present(F.col("input")), scored)) if semantic else F.lit(None).cast("double"),
    }
    scores = pairs.withColumns({f"_{k}": c for k, c in score.items()})
    floor = F.array_compact(
        F.array(
            F.when(F.col("_semantic_cosine") < floors["semantic_cosine"], "semantic_cosine_below_floor"),
            F.when(reading & ~F.coalesce("_answer_contained", F.lit(False)) & (F.col("_token_f1") < floors["mrc_token_f1"]), "mrc_lexical_below_floor"),
            F.when(~reading & (F.col("_rouge_l_f1") < floors["rouge_l_f1"]), "rouge_l_below_floor"),
        )
    )
    structural = F.concat(row_schema_failures(), light_failures(task), F.when(ipc, classification_failures(F.col("meta.primary_ipc"), F.col("output"))).otherwise(F.array().cast("array<string>")))
    failed = scores.withColumn("_failed", F.concat(structural, floor))
    block = F.struct((F.size("_failed") == 0).alias("passed"), F.col("_failed").alias("failed_rules"), F.struct(*[F.col(f"_{k}").alias(k) for k in score]).alias("scores"))
    return failed.withColumn("validation", block).select(*pairs.columns, "validation")


def report(validated: DataFrame) -> DataFrame:
    """(task, total, passed, rejected, means of the scores that are there, fail_rule_counts)."""
    s = F.col("validation.scores")
    mean = lambda f: F.round(F.avg(s[f]), 6)
    totals = validated.groupBy("task").agg(
        F.count("*").alias("total"), F.count_if("validation.passed").alias("passed"), F.count_if(~F.col("validation.passed")).alias("rejected"),
        mean("rouge_l_f1").alias("mean_rouge_l_f1"), mean("token_f1").alias("mean_token_f1"), mean("semantic_cosine").alias("mean_semantic_cosine"),
    )
    rules = validated.select("task", F.explode("validation.failed_rules").alias("rule")).groupBy("task", "rule").agg(F.count("*").alias("n"))
    per_task = rules.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("fail_rule_counts"))
    joined = totals.alias("t").join(per_task.alias("r"), F.col("t.task").eqNullSafe(F.col("r.task")), "left")
    return joined.select("t.*", "r.fail_rule_counts")
