"""The core queries by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import ipc, overlap, text, wordpiece
from quillstone.operators import classify, dewey, evaluate, instruct, judge, records, relate, stats, validate
from quillstone.plans.oracle import ORACLE
from quillstone.session import shared_dir, stage
from quillstone.sinks import prediction_line, shards
from quillstone.sources.jsonl import json_objects, read_shards
from quillstone.sources.tables import table
from quillstone.streaming.ingest import ingest

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PREFIXES = ["A01B, a42", "H6"]
LABELS = [f"L{i:02d}" for i in range(8)]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patent_clean")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.clean_records(table(spark, d, "patent_search"))


@query
def p1_found(spark, d):
    return dewey.child_objects(table(spark, d, "patent_search"))


def _child_table(spark, d, node):
    """The flat table of a node with the labels that link it to its record, as text."""
    t = dewey.child_table(table(spark, d, "patent_search"), node)
    return t.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ".") for c in ("label", "parent")})


@query
def p1_records(spark, d):
    return dewey.record_table(table(spark, d, "patent_search"))


@query
def p1_published_documents(spark, d):
    return _child_table(spark, d, "publishedDocuments")


@query
def p1_applicant(spark, d):
    return _child_table(spark, d, "applicant")


@query
def p1_inventors(spark, d):
    return _child_table(spark, d, "inventors")


@query
def p1_invention_title(spark, d):
    return _child_table(spark, d, "inventionTitle")


@query
def p1_ipcr_classification(spark, d):
    return _child_table(spark, d, "ipcrClassification")


@query
def p1_schema_paths(spark, d):
    """Every schema path of the records with its parent, kinds and number of nodes: the tables the records fall into."""
    nodes = dewey.shred(table(spark, d, "patent_search"), "rec_id", "response")
    return nodes.groupBy("path", "kind").agg(F.count("*").alias("nodes"), F.count_distinct("rec_id").alias("records"))


# Counts and distributions


@query
def label_counts_top40(spark, d):
    return stats.label_counts(_clean(spark, d), F.col("ipcr_classification")).orderBy(F.desc("n"), "code").limit(40)


@query
def label_counts(spark, d):
    return stats.label_counts(_clean(spark, d), F.col("ipcr_classification"))


@query
def label_freq_of_freq(spark, d):
    return stats.frequency_of_frequency(stats.label_counts(_clean(spark, d), F.col("ipcr_classification")))


@query
def label_tail_summary(spark, d):
    return stats.tail_summary(stats.label_counts(_clean(spark, d), F.col("ipcr_classification")))


@query
def prefix_subset_counts(spark, d):
    kept = _clean(spark, d).filter(ipc.matches_prefixes(F.col("ipcr_classification"), PREFIXES))
    return stats.label_counts(kept, F.col("ipcr_classification"))


def _primary_metrics(spark, d):
    """claims, abstract characters and mean words a claim of each record's primary document."""
    doc = records.primary_document(F.col("published_documents"))
    rows = _clean(spark, d).select("rec_id", doc.alias("doc"))
    claims = F.filter(F.coalesce("doc.claims", F.array().cast("array<string>")), lambda c: ~text.is_blank(c))
    words = F.aggregate(claims, F.lit(0), lambda s, c: s + F.size(text.tokens(c)))
    return rows.select("rec_id", F.size(claims).cast("long").alias("n_claims"), F.length(text.strip(text.present(F.col("doc.abstract")))).cast("long").alias("abstract_chars"), F.try_divide(words.cast("double"), F.size(claims)).alias("mean_words"))


@query
def metric_stats(spark, d):
    return stats.describe(_primary_metrics(spark, d), ["n_claims", "abstract_chars", "mean_words"])


@query
def p99_clip(spark, d):
    rows = stage(_primary_metrics(spark, d).select("rec_id", "n_claims", "abstract_chars"))
    return stats.clip(rows, ["n_claims", "abstract_chars"])


@query
def percentile_cap(spark, d):
    return stats.percentile_cap(table(spark, d, "documents"), "n_chars").select(F.round("cap", 6).alias("cap"))


@query
def hist_equal_width(spark, d):
    return stats.histogram(table(spark, d, "documents"), "n_chars")


@query
def hist_integer(spark, d):
    return stats.histogram_integer(stage(_primary_metrics(spark, d).select("n_claims")), "n_claims")


@query
def hist_2d(spark, d):
    return stats.histogram_2d(stage(_primary_metrics(spark, d).select("n_claims", "abstract_chars")), "n_claims", "abstract_chars")


@query
def corpus_summary(spark, d):
    return stats.corpus_summary(_clean(spark, d))


# Records and texts


@query
def clean_records(spark, d):
    return _records(spark, d)


@query
def clean_record_fields(spark, d):
    """The scalar members and name lists of the clean records."""
    r = _records(spark, d)
    return r.select("rec_id", "application_number", F.array_join("applicant", "|").alias("applicant"), F.array_join("inventors", "|").alias("inventors"), "invention_title", "patent_application_type", F.size("published_documents").cast("long").alias("documents"))


@query
def primary_label(spark, d):
    return _records(spark, d).select("rec_id", "primary_ipc", F.size("ipcr_classification").cast("long").alias("codes"))


@query
def clean_summary(spark, d):
    return records.clean_summary(_records(spark, d))


@query
def parse_claims(spark, d):
    """Claims of the scanned texts: number parsed and whether they begin with claim 1."""
    p = text.parse_claims(F.col("claims_text"))
    return table(spark, d, "claims_scans").select("scan_id", p.alias("p")).select("scan_id", F.size("p.claims").cast("long").alias("n_claims"), F.col("p.ok").alias("ok"))


@query
def parse_claims_roundtrip(spark, d):
    """Claims of each published document, numbered afresh, joined and parsed again: (rec_id, pos, claims, parsed)."""
    docs = _clean(spark, d).select("rec_id", F.posexplode("published_documents").alias("pos", "p"))
    body = lambda c: F.regexp_replace(F.regexp_replace(text.collapse(text.present(c)), r"^\d+\.\s*", ""), r"\.$", "")
    plain = F.filter(F.transform(F.coalesce("p.claims", F.array().cast("array<string>")), body), lambda c: c.rlike(r"^[A-Z][A-Za-z0-9 ,;:-]{30,}[a-z]$") & ~c.rlike(r"(?i)claims|what is claimed|\d-|-\d"))
    numbered = F.array_join(F.transform(plain, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c, F.lit("."))), " ")
    return docs.select("rec_id", F.col("pos").cast("long").alias("pos"), plain.alias("plain"), text.parse_claims(numbered).alias("r")).select("rec_id", "pos", F.size("plain").cast("long").alias("claims"), F.size("r.claims").cast("long").alias("parsed"), F.array_join("r.claims", "\n").alias("text"))


@query
def primary_document(spark, d):
    doc = records.primary_document(F.col("published_documents"))
    return _clean(spark, d).select("rec_id", doc.alias("doc")).filter("doc IS NOT NULL").select("rec_id", "doc.document_type_code", "doc.file_name")


@query
def patent_texts(spark, d):
    return records.patent_texts(_clean(spark, d))


@query
def text_exports_abstracts(spark, d):
    return records.text_exports(_clean(spark, d))["abstracts"]


@query
def text_exports_first_claims(spark, d):
    return records.text_exports(_clean(spark, d))["first_claims"]


@query
def text_exports_claims(spark, d):
    return records.text_exports(_clean(spark, d))["claims"]


# Ordinals, joins, sets


@query
def claim_seq(spark, d):
    rows = table(spark, d, "patent_text").filter(~text.is_blank(F.col("application_number")) & ~text.is_blank(F.col("claim_1")))
    return relate.running_number(rows.select(text.strip(F.col("application_number")).alias("application_number"), "text_id"), "application_number", ["text_id"])


@query
def row_shards(spark, d):
    return relate.shards(table(spark, d, "patent_text").select("text_id"), ["text_id"], 1000)


@query
def pending_ids(spark, d):
    seed = _clean(spark, d).select(text.strip(F.col("application_number")).alias("application_number")).filter("application_number <> ''").distinct()
    return relate.pending(seed, table(spark, d, "patent_text").select(text.strip(F.col("application_number")).alias("application_number")), "application_number")


@query
def ids_recovered(spark, d):
    return relate.recovered(table(spark, d, "patent_text"), table(spark, d, "instructions"), "application_number")


@query
def ordered_distinct(spark, d):
    return relate.ordered_distinct(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query
def catalog_lookup(spark, d):
    lookup = relate.catalog_lookup(table(spark, d, "ipc_catalog"), ["ipc_code_raw", "kind", "title"])
    return lookup.select("code", "kind", "title")


@query
def catalog_join(spark, d):
    """Records with a defined code, through the catalog."""
    lookup = relate.catalog_lookup(table(spark, d, "ipc_catalog"), ["ipc_code_raw", "kind", "title"]).filter("definition_statement IS NOT NULL AND trim(definition_statement) <> ''")
    joined = relate.with_catalog(_clean(spark, d).select("rec_id", "primary_ipc"), lookup.select("code", "title", "definition_statement", "scheme_note"))
    return joined.select("rec_id", "code", relate.grounding_text(F.col("title"), F.col("definition_statement"), F.col("scheme_note"), F.col("code")).alias("grounding"))


@query
def catalog_best_kind(spark, d):
    return relate.best_by_kind(table(spark, d, "ipc_catalog"), "ipc_code_raw", "kind", ["title"]).select("ipc_code_raw", "kind", "title")


@query
def catalog_with_notes(spark, d):
    """Every place with its best entry and, where there is one, its note; outer joins on the raw symbol."""
    c = table(spark, d, "ipc_catalog")
    best = relate.best_by_kind(c, "ipc_code_raw", "kind", ["title"]).select("ipc_code_raw", "kind", "has_definition_entry")
    notes = c.filter("scheme_note IS NOT NULL").groupBy("ipc_code_raw").agg(F.array_join(F.array_sort(F.collect_set("scheme_note")), " ").alias("notes"))
    return best.join(relate.small(notes), "ipc_code_raw", "left").select("ipc_code_raw", "kind", F.coalesce("has_definition_entry", F.lit(False)).alias("has_definition_entry"), "notes")


@query
def hash_sample(spark, d):
    done = table(spark, d, "patent_text").select("application_number")
    return relate.hash_sample(table(spark, d, "instructions"), "application_number", 50, 42, done)


@query
def catalog_built(spark, d):
    """The catalog from its own rows taken apart: scheme entries, notes and definitions joined again, in order of the symbol."""
    c = table(spark, d, "ipc_catalog")
    places = c.select(F.col("ipc_code_raw").alias("symbol"), "kind", "entry_type", "edition", F.trim("title").alias("title"), F.lit(None).cast("string").alias("note"), F.lit("").alias("end_symbol"), F.struct("kind", "title", "entry_type").alias("ord"))
    notes = c.filter("scheme_note IS NOT NULL").select(F.col("ipc_code_raw").alias("symbol"), F.lit("n").alias("kind"), F.lit(None).cast("string").alias("entry_type"), F.lit(None).cast("string").alias("edition"), F.lit(None).cast("string").alias("title"), F.col("scheme_note").alias("note"), F.lit("").alias("end_symbol"), F.struct(F.col("scheme_note").alias("kind"), "title", "entry_type").alias("ord"))
    defined = c.filter("definition_statement IS NOT NULL").groupBy(F.col("ipc_code_raw").alias("symbol")).agg(F.max("definition_statement").alias("definition_statement"))
    return relate.build_catalog(places.unionByName(notes), defined).select("ipc_code_raw", "ipc_code", "kind", "title", "scheme_note", "definition_statement", "has_definition_entry")


# Limits, runs and counters


@query
def input_limit(spark, d):
    """The first 1000 records in order: the limit is the feature."""
    return relate.first_rows(table(spark, d, "patent_text").select("text_id", "application_number"), ["text_id"], 1000)


@query
def success_limit(spark, d):
    """Records in order up to the 100th that passes the checks: the limit is the feature."""
    rows = table(spark, d, "instructions").select("row_id", "output")
    return relate.until_successes(rows, ["row_id"], ~text.is_blank(F.col("output")), 100)


@query
def tasks_backfilled(spark, d):
    """Records without a task take that of the shape of their input."""
    guess = F.when(F.col("instruction").endswith("?"), "mrc").when(F.col("input").startswith("Abstract:"), "ipc_reasoning").otherwise("abstract_drafting")
    return instruct.with_task(table(spark, d, "instructions"), guess).select("row_id", "task")


@query
def tasks_in_order(spark, d):
    """All tasks in one run: records and their places by task."""
    i = table(spark, d, "instructions")
    frames = {t: i.filter(F.lower(F.trim("task")) == t) for t in instruct.TASKS}
    return instruct.all_tasks(frames).groupBy("task_order", "task").agg(F.count("*").alias("n"))


@query
def coverage_counters(spark, d):
    return stats.coverage(_clean(spark, d))


@query
def bert_limit_mark(spark, d):
    """Words of abstracts as a histogram that says where the limit of a classifier's input lies."""
    words = stage(table(spark, d, "patent_text").select(F.size(text.tokens(F.col("claims_text"))).cast("int").alias("words")))
    return stats.marked_limit(stats.histogram_integer(words, "words"), stats.quantile(words.filter("words > 0"), "words", 0.99))


@query
def judge_messages(spark, d):
    """What a judge is sent: two messages a record, the second with the payload."""
    m = judge.messages("Judge the record.", judge.payload())
    return table(spark, d, "instructions").select("row_id", m.alias("m")).select("row_id", F.size("m").cast("long").alias("messages"), F.get("m", F.lit(0))["content"].alias("system"), F.get_json_object(F.get("m", F.lit(1))["content"], "$.application_number").alias("application_number"), F.length(F.get_json_object(F.get("m", F.lit(1))["content"], "$.input")).cast("long").alias("chars"))


@query
def meta_blocks(spark, d):
    """The verdict as a member of meta, beside what was there."""
    v = judge.in_meta(validate.validate(table(spark, d, "instructions"), rouge=False), "validation")
    return v.select("row_id", F.col("meta.primary_ipc").alias("primary_ipc"), F.col("meta.validation.passed").alias("passed"))


@query
def shards_written(spark, d):
    """Texts written in numbered shards, continued, and read again: lines by shard."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = table(spark, d, "patent_text").select("text_id", "application_number")
    shards.write_shards(rows.filter("text_id % 2 = 0"), folder, ["text_id"], 1000)
    shards.write_shards(rows.filter("text_id % 2 <> 0"), folder, ["text_id"], 1000, mode="append")
    back = read_shards(spark, folder).select("shard", F.try_variant_get("v", "$.text_id", "long").alias("text_id"))
    out = stage(back.groupBy("shard").agg(F.count("*").alias("n"), F.min("text_id").alias("first"), F.max("text_id").alias("last")))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return out


# Codes and validation


@query
def symbol_format(spark, d):
    c = table(spark, d, "ipc_catalog")
    return c.select("ipc_code_raw").distinct().select("ipc_code_raw", ipc.format_symbol(F.col("ipc_code_raw")).alias("formatted"))


@query
def ipc_check(spark, d):
    i = table(spark, d, "instructions").filter("lower(task) = 'ipc_reasoning'")
    return i.select("row_id", ipc.answer_code(F.col("output")).alias("code"), F.array_join(ipc.classification_failures(F.col("meta.primary_ipc"), F.col("output")), ",").alias("failures"))


@query
def schema_check(spark, d):
    """Schema rules on the records as JSON, their task held against the lower-case task."""
    i = table(spark, d, "instructions")
    whole = F.to_json(F.struct("task", "application_number", "instruction", "input", "output", "meta"), {"ignoreNullFields": "false"})
    return i.select("row_id", F.array_join(validate.schema_failures(F.try_parse_json(whole), F.lower("task")), ",").alias("failures"))


@query
def task_light(spark, d):
    return table(spark, d, "instructions").select("row_id", F.array_join(validate.light_failures(text.present(F.col("task"))), ",").alias("failures"))


@query
def length_features(spark, d):
    a, b, r = validate.length_features(F.col("input"), F.col("output"))
    return table(spark, d, "instructions").select("row_id", a.cast("long").alias("len_input_tokens"), b.cast("long").alias("len_output_tokens"), F.round(r, 6).alias("compression_ratio"))


@query
def token_f1(spark, d):
    return table(spark, d, "instructions").select("row_id", F.round(overlap.token_f1(F.col("input"), F.col("output")), 6).alias("token_f1"))


@query
def answer_contained(spark, d):
    return table(spark, d, "instructions").select("row_id", overlap.answer_contained(F.col("output"), F.col("input")).alias("contained"))


@query
def rouge_l(spark, d):
    return table(spark, d, "instructions").select("row_id", F.round(overlap.rouge_l_f1(text.present(F.col("input")), text.present(F.col("output"))), 6).alias("rouge_l_f1"))


@query
def validate_records(spark, d):
    """Verdict by the rules that SQL can check too: without ROUGE-L and the semantic cosine; validate_full has all."""
    v = validate.validate(table(spark, d, "instructions"), rouge=False)
    return v.select("row_id", F.col("validation.passed").alias("passed"), F.array_join("validation.failed_rules", ",").alias("failed_rules"))


def _validated(spark, d):
    """The whole validation: stemmed ROUGE-L and a cosine of hashed word vectors in place of a sentence encoder."""
    embed = overlap.hash_embedding()
    return validate.validate(table(spark, d, "instructions"), semantic=lambda a, b: overlap.cosine(embed(a), embed(b)))


@query
def validate_full(spark, d):
    """Verdict and scores by all rules."""
    return _validated(spark, d).select("row_id", "validation.passed", F.array_join("validation.failed_rules", ",").alias("failed_rules"), "validation.scores.*")


@query
def validate_report_full(spark, d):
    return validate.report(_validated(spark, d))


@query
def validate_rule_counts_full(spark, d):
    return _validated(spark, d).select("task", F.explode("validation.failed_rules").alias("rule")).groupBy("task", "rule").agg(F.count("*").alias("n"))


@query
def verdict_kappa_full(spark, d):
    """Agreement of the verdict by all rules with the made-up judge's."""
    rules = _validated(spark, d).select("row_id", F.col("validation.passed").alias("rule"))
    return evaluate.kappa(rules.join(_replies(spark, d).select("row_id", judge.verdict(F.col("reply"))["pass"].alias("judge")), "row_id"), "rule", "judge")


@query
def validate_report(spark, d):
    """The part SQL can check too: without ROUGE-L and the semantic cosine; validate_report_full has all."""
    r = validate.report(validate.validate(table(spark, d, "instructions"), rouge=False))
    return r.select("task", "total", "passed", "rejected", "mean_token_f1")


@query
def validate_rule_counts(spark, d):
    """The part SQL can check too: without ROUGE-L and the semantic cosine; validate_rule_counts_full has all."""
    v = validate.validate(table(spark, d, "instructions"), rouge=False)
    return v.select("task", F.explode("validation.failed_rules").alias("rule")).groupBy("task", "rule").agg(F.count("*").alias("n"))


@query
def ipc_accuracy_levels(spark, d):
    i = table(spark, d, "instructions").filter("lower(task) = 'ipc_reasoning'")
    return evaluate.hierarchy_accuracy(i, F.col("meta.primary_ipc"), ipc.answer_code(F.col("output")))


@query
def bigram_f1(spark, d):
    return table(spark, d, "instructions").select("row_id", F.round(evaluate.ngram_f1(F.col("input"), F.col("output"), 2), 6).alias("bigram_f1"))


@query
def application_split(spark, d):
    """Rows of each part; no application is in two parts."""
    parts = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]
    return table(spark, d, "instructions").select("row_id", evaluate.split_of(F.col("application_number"), parts).alias("part"))


@query
def verdict_kappa(spark, d):
    """Agreement of the rules' verdict, by the rules SQL can check too, with the made-up judge's; verdict_kappa_full has all rules."""
    rules = validate.validate(table(spark, d, "instructions"), rouge=False).select("row_id", F.col("validation.passed").alias("rule"))
    v = judge.verdict(F.col("reply"))
    return evaluate.kappa(rules.join(_replies(spark, d).select("row_id", v["pass"].alias("judge")), "row_id"), "rule", "judge")


# Judging


def _replies(spark, d):
    """Replies of a made-up judge in the forms models answer in."""
    score = F.pmod(F.col("row_id"), F.lit(7)).cast("string")
    plain = F.concat(F.lit('{"score": '), score, F.lit(', "rationale": " fine ", "failure_tags": ["short", "off_topic"]}'))
    strict = F.concat(F.lit('{"score": "'), score, F.lit('", "pass": false, "failure_tags": "strict"}'))
    reply = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit("Here it is: "), plain)).otherwise(strict)
    return table(spark, d, "instructions").select("row_id", F.lower("task").alias("task"), reply.alias("reply"))


@query
def judge_verdicts(spark, d):
    """Replies with prose around them give their inner list first, as no verdict; fenced and plain ones are read."""
    v = judge.verdict(F.col("reply"))
    return _replies(spark, d).select("row_id", v["score"].cast("long").alias("score"), v["pass"].alias("pass"), F.array_join(v["failure_tags"], ",").alias("tags"))


@query
def judge_report(spark, d):
    return judge.judge_report(judge.judged(_replies(spark, d), "reply", "judge", "local"))


@query
def judge_report_merged(spark, d):
    """Two halves judged apart and merged: equal to judge_report."""
    rows = judge.judged(_replies(spark, d), "reply", "judge", "local")
    half = F.col("row_id") % 2 == 0
    return judge.merge_reports(judge.judge_report(rows.filter(half)), judge.judge_report(rows.filter(~half)))


@query
def judge_tags(spark, d):
    return judge.tag_counts(judge.judged(_replies(spark, d), "reply", "judge", "local"))


@query
def judge_payload(spark, d):
    return table(spark, d, "instructions").select("row_id", judge.payload().alias("payload"))


# Vectors and predictions


@query
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(overlap.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _scores(spark, d):
    head = F.slice("embedding", 1, len(LABELS))
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(head, lambda x: F.round(F.abs(x.cast("double")), 6)).alias("scores"))


@query
def multi_hot(spark, d):
    s = _scores(spark, d)
    return s.select("vec_id", F.array_join(classify.multi_hot(F.col("scores"), 0.1).cast("array<string>"), "").alias("over"), F.array_join(classify.multi_hot(F.col("scores"), 3).cast("array<string>"), "").alias("top3"))


@query
def prediction_lines(spark, d):
    labels = F.array(*[F.lit(x) for x in LABELS])
    line = prediction_line(labels, F.col("scores"), 0.1)
    found, _ = classify.predicted(line)
    return _scores(spark, d).select("vec_id", F.array_join(found, ",").alias("labels"), F.size(found).cast("long").alias("n"))


@query
def kept_label_counts(spark, d):
    labels = F.array(*[F.lit(x) for x in LABELS])
    found, _ = classify.predicted(prediction_line(labels, F.col("scores"), 0.1))
    return _scores(spark, d).select(F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def label_accuracy(spark, d):
    truth = F.transform(F.array(*[F.lit(i) for i in range(len(LABELS))]), lambda i: (i == F.col("label")).cast("int"))
    rows = _scores(spark, d).select(truth.alias("truth"), classify.multi_hot(F.col("scores"), 0.1).alias("guess"))
    return classify.element_accuracy(rows, "truth", "guess")


@query
def claim_predictions(spark, d):
    """Claims numbered, scored by a stand-in model and written as prediction lines."""
    rows = table(spark, d, "patent_text").filter(~text.is_blank(F.col("claim_1")) & ~text.is_blank(F.col("application_number")))
    inputs = classify.claim_inputs(rows, "application_number", "claim_1", ["text_id"])

    def model():
        import zlib

        return lambda texts: [[(zlib.crc32(f"{x}{t}".encode()) % 1000) / 1000 for x in LABELS] for t in texts]

    scored = classify.predict(inputs, "text", model)
    return scored.select("id", "row_index", prediction_line(F.array(*[F.lit(x) for x in LABELS]), F.col("scores"), 0.7).alias("line"))


# JSON, tokens, generation, streams


@query
def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    v = json_objects(e)
    return v.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


def _vocabulary(spark, d):
    """A vocabulary of single characters and the most frequent words of the texts."""
    words = table(spark, d, "patent_text").select(F.explode(text.tokens(F.col("claims_text"))).alias("w")).filter("w rlike '^[a-z]{2,}$'")
    top = [r.w for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(2000).collect()]
    chars = [c for x in "abcdefghijklmnopqrstuvwxyz0123456789.,;:-()/" for c in (x, f"##{x}")]
    return {t: i for i, t in enumerate(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *chars, *top, *(f"##{w}" for w in top)]))}


@query
def wordpiece_lengths(spark, d):
    w = wordpiece.WordPiece(spark, _vocabulary(spark, d))
    return table(spark, d, "patent_text").select("text_id", w.length(F.col("abstract")).alias("abstract_tokens"), w.length(F.col("claims_text")).alias("claims_tokens"))


@query
def bert_features(spark, d):
    w = wordpiece.WordPiece(spark, _vocabulary(spark, d))
    return table(spark, d, "patent_text").select("text_id", w.features(F.col("claim_1")).alias("f")).select("text_id", "f.*")


def _flat(records_):
    """Instruction records with the members of meta as columns."""
    return records_.select("task", "application_number", "instruction", "input", "output", "meta.*")


@query
def abstract_drafting_records(spark, d):
    return _flat(instruct.abstract_drafting(records.patent_texts(_clean(spark, d)), ["Draft an abstract.", "Summarise the claims."]))


@query
def ipc_reasoning_records(spark, d):
    """Justifications by a stand-in model for records whose code is defined."""
    lookup = relate.catalog_lookup(table(spark, d, "ipc_catalog"), ["ipc_code_raw", "kind", "title"])
    prompts = instruct.ipc_prompts(records.patent_texts(_clean(spark, d)), lookup)

    def chat():
        return lambda messages: '```json\n{"justification": "The claims fall under ' + messages[0]["content"].split("\n")[0][:40].replace('"', "'") + '."}\n```'

    return _flat(instruct.ipc_reasoning(instruct.generate(prompts, chat, "prompt"), ["Explain the class.", "Justify the code."], "stand-in", "local"))


@query
def mrc_records(spark, d):
    texts = records.patent_texts(_clean(spark, d)).withColumn("prompt", F.col("claims_text"))

    def chat():
        return lambda messages: '{"question": "What is claimed?", "answer": "' + messages[0]["content"][:30].replace('"', "'").replace("\n", " ").replace("\\", " ") + '"}'

    return _flat(instruct.mrc(instruct.generate(texts, chat, "prompt"), "stand-in", "local"))


@query
def stream_ingest(spark, d):
    """Events read as a stream into a table, in one run that stops when all is read."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    ingest(spark, source, spark.read.parquet(source).schema, f"{base}/out", f"{base}/log").awaitTermination()
    counts = stage(spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return counts
