"""Queries over small tables of their own: nothing of the job is left out."""

import json
import math
import random
import zlib
from collections import Counter

from quillstone.functions.overlap import rouge_words
from quillstone.llm import leak
from quillstone.plans.core import QUERIES

INSTRUCTION = "row_id long, task string, application_number string, instruction string, input string, output string, meta struct<primary_ipc:string,document_type:string,model:string,provider:string,ipc_title:string,has_definition_entry:boolean>"


def run(spark, tmp_path, query, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet", mode="overwrite")
    return QUERIES[query](spark, str(tmp_path))


def test_judge_payload_cuts_no_text_the_reference_keeps(spark, tmp_path):
    texts = ["q" * 401, "x" * 12_000, "y" * 12_001]
    got = json.loads(run(spark, tmp_path, "judge_payload", "instructions", [(1, "mrc", "A", *texts, None)], INSTRUCTION).first().payload)
    assert got["instruction"] == texts[0] and got["input"] == texts[1]
    assert got["output"] == "y" * 11_980 + "\n…[truncated]…"


SEARCH = "rec_id long, response string"


def test_child_tables_hold_bare_objects_and_all_fields(spark, tmp_path):
    doc = {"documentTypeCode": "B2", "fileName": "f.pdf", "abstractText": "An abstract.", "claimsText": "1. A pump."}
    named = {"legalEntityName": "N"}
    rest = {"inventionTitle": {"title": "T", "language": "en"}, "ipcrClassification": {"classificationText": "A01B 1/02", "sequenceNumber": 1}}
    bare = {"publishedDocuments": doc, "applicant": named, "inventors": named, "bibliographicData": rest}
    listed = {"publishedDocuments": ["x", doc, {}], "bibliographicData": {"inventionTitle": [{"title": None}]}}
    rows = [(1, json.dumps(bare)), (2, json.dumps(json.dumps(listed))), (3, "{"), (4, '{"publishedDocuments": "x"}')]
    of = lambda q: sorted(tuple(r) for r in run(spark, tmp_path, q, "patent_search", rows, SEARCH).collect())
    texts = ("B2", "f.pdf", "An abstract.", "1. A pump.")
    assert of("p1_published_documents") == [(1, "0", "", 0, *texts), (2, "0.1", "0", 1, *texts), (2, "0.2", "0", 2, None, None, None, None)]
    assert of("p1_applicant") == [(1, "1", "", 0, "N")] and of("p1_inventors") == [(1, "2", "", 0, "N")]
    assert of("p1_invention_title") == [(1, "3.0", "3", 0, "T", "en"), (2, "1.0.0", "1.0", 0, None, None)]
    assert of("p1_ipcr_classification") == [(1, "3.1", "3", 0, "A01B 1/02", "1")]


def test_record_table(spark, tmp_path):
    record = {"ipRightStatusCode": 7, "filedDate": "2001-02-03", "priorityDate": {"x": 1}, "bibliographicData": {"applicationNumber": "A", "patentApplicationType": True}}
    rows = [(1, json.dumps(record)), (2, "{}"), (3, "[]"), (4, None)]
    got = sorted(tuple(r) for r in run(spark, tmp_path, "p1_records", "patent_search", rows, SEARCH).collect())
    assert got == [(1, "7", "2001-02-03", None, None, "A", "true"), (2, *[None] * 6)]


def brute_scores(a, b):
    """(ROUGE-L F1 by the plain table, cosine of hashed words) of two texts."""
    x, y = rouge_words(a), rouge_words(b)
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    u, v = ([0.0] * 256, [0.0] * 256)
    for text, w in ((a, u), (b, v)):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            w[h % 256] += 1 if h >> 16 & 1 else -1
    dot = lambda p, q: sum(m * n for m, n in zip(p, q))
    return 2 * t[-1][-1] / (len(x) + len(y)), dot(u, v) / math.sqrt(dot(u, u) * dot(v, v))


def test_full_reports_use_all_floors(spark, tmp_path):
    meta = ("A01B1/02", "B2", "m", "p", "t", True)
    given = "a rotor turns in the housing " * 3
    outputs = ["A rotor turning in a housing.", "Seals keep water out.", "Turns, housing: rotors!", "the", "x " * 200 + "rotor", "a rotor turns in the housing"]
    rows = [(i, "abstract_drafting", "A", "Draft.", given, o, meta) for i, o in enumerate(outputs)]
    want = {}
    for i, o in enumerate(outputs):
        r, c = brute_scores(given, o)
        want[i] = (["semantic_cosine_below_floor"] if c < 0.15 else []) + (["rouge_l_below_floor"] if r < 0.02 else [])
    rules = Counter(x for f in want.values() for x in f)
    passed = sum(not f for f in want.values())
    assert rules["rouge_l_below_floor"] and rules["semantic_cosine_below_floor"] and 0 < passed < len(rows)
    report = run(spark, tmp_path, "validate_report_full", "instructions", rows, INSTRUCTION).first()
    assert (report.total, report.passed, report.rejected, report.fail_rule_counts) == (len(rows), passed, len(rows) - passed, dict(rules))
    scores = [brute_scores(given, o) for o in outputs]
    assert abs(report.mean_rouge_l_f1 - sum(r for r, _ in scores) / len(rows)) < 1e-5 and abs(report.mean_semantic_cosine - sum(c for _, c in scores) / len(rows)) < 1e-5
    counts = run(spark, tmp_path, "validate_rule_counts_full", "instructions", rows, INSTRUCTION)
    assert {r.rule: r.n for r in counts.collect()} == dict(rules)
    # The made-up judge scores row_id % 7; rows of 1 mod 3 give no verdict, those of 2 mod 3 say false.
    pairs = [(not want[i], i % 3 == 0 and i % 7 >= 4) for i in range(len(rows)) if i % 3 != 1 and 1 <= i % 7 <= 5]
    k = run(spark, tmp_path, "verdict_kappa_full", "instructions", rows, INSTRUCTION).first()
    assert (k.n, k.agreement) == (len(pairs), round(sum(a == b for a, b in pairs) / len(pairs), 6))


def test_partial_paraphrases_at_any_offset(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocab) for _ in range(45)] for i in range(12)} | {12: [rng.choice(vocab) for _ in range(14)]}
    docs, want = {}, set()
    for d in range(72):
        i, k = d % 12, d // 12
        part = items[i][k + 2 :][:24] if k < 5 else items[i][-24:]
        changed = [f"x{d}{n}" if n % 5 == 2 else w for n, w in enumerate(part)]
        docs[d] = [rng.choice(vocab) for _ in range(30 + d % 8)] + changed + [rng.choice(vocab) for _ in range(30)]
        want.add((d, i))
    docs[72] = [rng.choice(vocab) for _ in range(37)] + items[12][:6] + ["x"] + items[12][7:] + [rng.choice(vocab) for _ in range(30)]
    docs[73] = items[0][3:23]  # a document under 24 words
    want |= {(72, 12), (73, 0)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    qs = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in leak.paraphrased(df, qs).collect()}
    assert len(set(got) & want) >= 0.9 * len(want) and {(72, 12), (73, 0)} <= set(got)
    exact = lambda a, b, n: max(leak.common_subsequence(a[o : o + n], b[max(0, s - n // 2) : s + n + n // 2]) for o in range(len(a) - n + 1) for s in range(max(1, len(b) - n + 1))) / n
    assert all(0.75 <= v <= exact(items[i], docs[d], min(24, len(items[i]))) for (d, i), v in got.items())
