import gzip
import json
import statistics

from pyspark.sql import functions as F

from quillstone import sinks
from quillstone.operators import classify, instruct, judge, relate, stats, validate
from quillstone.sources import api, jsonl
from quillstone.sources.xml_catalog import latest_definitions, read_catalog_xml


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_and_tail(spark):
    df = spark.createDataFrame([(["a", "B ", "c"],), (["C"] * 5,), (["d"] * 3,), (None,), ([None, ""],)], "codes array<string>")
    counts = stats.label_counts(df, F.col("codes"))
    assert rows(counts) == [("A", 1), ("B", 1), ("C", 6), ("D", 3)]
    assert rows(stats.frequency_of_frequency(counts)) == [(1, 2), (3, 1), (6, 1)]
    tail = dict(rows(stats.tail_summary(counts)))
    assert tail == {"unique_codes": 4, "singleton_codes": 2, "singleton_pct": 50, "few_codes": 3, "few_pct": 75, "assignments": 11, "singleton_assignments": 2, "singleton_assignments_pct": 18.1818}
    assert dict(rows(stats.tail_summary(counts.limit(0))))["few_pct"] == 0


def test_percentiles_and_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (1, 5, 7, 9, 30, 41, 2, 2, 8, 100)], "v int")
    assert abs(stats.percentile_cap(df, "v").first().cap - 94.69) < 1e-9
    assert stats.percentile_cap(df.limit(0), "v").first().cap is None
    h = rows(stats.histogram(df, "v"))
    assert sum(r[3] for r in h) == 9 and h[0][1] == 1 and h[-1][2] == 41
    assert rows(stats.histogram(df.limit(0), "v")) == [] and rows(stats.histogram(df.filter("v = 7"), "v")) == [(0, 7.0, 7.0, 1)]
    assert sum(r[1] for r in rows(stats.histogram_integer(df, "v"))) == 9
    d = stats.describe(df, ["v"]).first()
    assert (d.n, d.min, d.max, d["mean"]) == (10, 1, 100, round(statistics.mean((1, 5, 7, 9, 30, 41, 2, 2, 8, 100)), 4))


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with gzip.open(tmp_path / "d/part-00001.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n[{"a": 2}]\n5\ngarbage\n')
    (tmp_path / "d/part-00001.jsonl").write_text('{"a": 3}\n')
    (tmp_path / "d/part-00002.jsonl").write_text('{"a": 4}\n')
    (tmp_path / "d/._part-00003.jsonl.gz").write_text("x")
    value = lambda df: sorted(r.a for r in df.select(F.try_variant_get("v", "$.a", "int").alias("a")).collect())
    d = str(tmp_path / "d")
    assert value(jsonl.read_shards(spark, d)) == [1] and value(jsonl.read_shards(spark, d, include_open=True)) == [1, 3, 4] and value(jsonl.read_shards(spark, d, only_unfinished=True)) == [1, 4]
    assert jsonl.next_shard(jsonl.read_shards(spark, d, include_open=True)).first().next_shard == 3
    assert jsonl.read_shards(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    sinks.write_jsonl(spark.range(25).select("id", F.lit(None).cast("string").alias("x")).coalesce(1), out, shard_size=10)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.endswith(".json.gz")]) == 3
    assert spark.read.text(out).filter("value LIKE '%\"x\":null%'").count() == 25


def test_csv_and_ids(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿application_number,x\n 1 ,a\n,b\n2,c\n1,d\n", encoding="utf-8")
    assert sorted(r[0] for r in jsonl.read_seed(spark, str(tmp_path / "s.csv")).collect()) == ["1", "2"]
    (tmp_path / "c.csv").write_text('application_number,claim\n1,"a ""b""\nc"\n1,\n2,x\n')
    assert sorted((r[0], r[1]) for r in jsonl.read_claims_csv(spark, str(tmp_path / "c.csv")).collect()) == [("1", 'a "b"\nc'), ("2", "x")]
    sinks.write_ids(spark.createDataFrame([("7",), ("7",), (" 8 ",)], "id string"), str(tmp_path / "ids"))
    assert rows(jsonl.read_ids(spark, str(tmp_path / "ids"))) == [("7",), ("8",)] and jsonl.read_ids(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "j").mkdir()
    (tmp_path / "j/44.json").write_text('{"response": {}}')
    (tmp_path / "j/summary.json").write_text("{}")
    assert [r.application_number for r in jsonl.whole_json(spark, str(tmp_path / "j")).collect()] == ["44"]


SCHEME = """<r xmlns="urn:x"><ipcEntry symbol="A01B" kind="u"><textBody><title><titlePart><text>Soil  <b>working</b></text></titlePart><titlePart><text>tools</text></titlePart></title></textBody>
<ipcEntry symbol="A01B0001020000" kind="1" edition="2026"><textBody><title><titlePart><text>Spades</text></titlePart></title></textBody></ipcEntry>
<ipcEntry symbol="A01B" kind="n"><textBody><note>First note</note></textBody></ipcEntry><ipcEntry symbol="A01B" kind="n"><textBody><note>Second</note></textBody></ipcEntry></ipcEntry>
<ipcEntry symbol="A01B" kind="m"><textBody><title><titlePart><text>Main</text></titlePart></title></textBody></ipcEntry><ipcEntry symbol="" kind="m"/><ipcEntry symbol="B02C" kind="i"><textBody/></ipcEntry></r>"""
DEFS = """<r><IPC-DEFINITION IPC="A01B"><DEFINITION-STATEMENT>Old</DEFINITION-STATEMENT></IPC-DEFINITION><IPC-DEFINITION IPC="A01B"><DEFINITION-STATEMENT>This  place <b>covers</b></DEFINITION-STATEMENT>
<REFERENCES><LIMITINGREFERENCES><table><tr><td>Ploughs</td><td><a href="A01B 3/00">x</a><a href="A01B 3/00"/></td></tr><tr><td/><td>.</td></tr></table></LIMITINGREFERENCES><OTHER/></REFERENCES>
<GLOSSARYOFTERMS><dl><dt>Hoe</dt><dt>Pick</dt><dd>a tool</dd></dl></GLOSSARYOFTERMS><SYNONYMSANDKEYWORDS><SYNONYMS><ul><li>spade</li><li>shovel</li></ul></SYNONYMS><ABBREVIATIONS><dl><dt>SP</dt><dd>spade</dd></dl></ABBREVIATIONS><ODD>text</ODD></SYNONYMSANDKEYWORDS><NEWBLOCK>kept</NEWBLOCK></IPC-DEFINITION></r>"""


def test_xml_catalog(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SCHEME)
    (tmp_path / "d.xml").write_text(DEFS)
    scheme = read_catalog_xml(spark, [str(tmp_path / "s.xml")], "scheme")
    assert [r.symbol for r in scheme.orderBy("ord").collect()] == ["A01B0001020000", "A01B", "A01B", "A01B", "A01B", "B02C"]
    defs = latest_definitions(read_catalog_xml(spark, [str(tmp_path / "d.xml")], "definitions"))
    d = defs.first()
    assert d.definition_statement == "This place covers" and d.references == {"limitingreferences": [("Ploughs", ["A01B 3/00"])]} and d.glossary == [(["Hoe", "Pick"], "a tool")]
    assert d.synonyms_and_keywords.synonyms == [["spade", "shovel"]] and d.synonyms_and_keywords.abbreviations == [("SP", "spade")] and d.synonyms_and_keywords.other == {"odd": "text"} and d.extra == {"newblock": "kept"}
    c = {r.ipc_code_raw: r for r in relate.build_catalog(scheme, defs).collect()}
    assert sorted(c) == ["A01B", "A01B0001020000"] and c["A01B"].kind == "m" and c["A01B"].title == "Main" and c["A01B"].scheme_note == "First note Second"
    assert c["A01B"].has_definition_entry and not c["A01B0001020000"].has_definition_entry and c["A01B0001020000"].ipc_code == "A01B1/02"


def test_sets_and_ordinals(spark):
    seed = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "k string, ord long")
    done = spark.createDataFrame([("2",), ("2",), (None,)], "k string")
    assert [r.k for r in relate.pending(seed, done, "k", 1).collect()] == ["1"]
    assert rows(relate.recovered(done, seed, "k")) == [("1",), ("2",), ("3",)]
    claims = spark.createDataFrame([("a", "x\ty", 0), ("a", "y", 1), ("b", "z", 2), ("a", "w", 3)], "app string, text string, ord long")
    got = sorted((r.id, r.row_index, r.text) for r in classify.claim_inputs(claims, "app", "text", ["ord"]).collect())
    assert got == [("a__1", 0, "x y"), ("a__2", 1, "y"), ("a__3", 2, "w"), ("b__1", 3, "z")]
    assert rows(relate.shards(spark.range(5), ["id"], 2)) == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 4, 2)]
    assert relate.shards(spark.range(0), ["id"], 2).count() == 0
    sample = relate.hash_sample(seed.union(seed), "k", 2)
    drawn = {r.k for r in sample.collect()}
    some = spark.createDataFrame([(min(drawn),)], "k string")
    assert len(drawn) == 2 and {r.k for r in relate.hash_sample(seed, "k", 2, done=some).collect()} == drawn - {min(drawn)}


def test_predictions(spark):
    df = spark.createDataFrame([(0, "A61K (0.35), C12N (0.96)"), (1, ""), (2, None)], "row_index long, value string")
    labels, scores = classify.predicted(F.col("value"))
    assert rows(df.select("row_index", labels.alias("l"), scores.alias("s"))) == [(0, ["A61K", "C12N"], ["0.35", "0.96"]), (1, [], []), (2, [], [])]
    s = spark.createDataFrame([([0.30, 0.31, 0.90],)], "s array<double>")
    assert s.select(classify.multi_hot(F.col("s"), 0.3).alias("h")).first().h == [0, 1, 1] and s.select(classify.multi_hot(F.col("s"), 1).alias("h")).first().h == [0, 0, 1]
    assert s.select(sinks.prediction_line(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("s"), 0.3).alias("p")).first().p == "B (0.31), C (0.90)"
    scored = classify.predict(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.scores for r in scored.collect()) == [[0.0], [2.0]]


REPLIES = [('{"score": "4"}', (4, True, [])), ('{"score": 5, "pass": false}', (5, False, [])), ('{"score": 6}', None), ('{"score": 3, "failure_tags": "x"}', (3, False, ["x"])), ('```json\n{"score": 4}\n```', (4, True, [])), ("none", None), (None, None), ('x {"score": 2} y', (2, False, []))]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, r string")
    got = {r.i: r.v and (r.v.score, r.v["pass"], r.v.failure_tags) for r in df.select("i", judge.verdict(F.col("r")).alias("v")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(REPLIES)}
    assert instruct.reply_value('x {"a":[1]} y', list) == [1] and instruct.reply_value("none", dict) is None
    long = spark.createDataFrame([("t", "1", "i" * 50, "x", None, None)], "task string, application_number string, instruction string, input string, output string, meta struct<primary_ipc:string,ipc_title:string,has_definition_entry:boolean,document_type:string,model:string>")
    p = json.loads(long.select(judge.payload(30).alias("p")).first().p)
    assert p["instruction"] == "i" * 10 + "\n…[truncated]…" and p["output"] == ""


def test_schema_failures(spark):
    whole = {"task": "mrc", "application_number": "1", "instruction": "q?", "input": "i", "output": "o", "meta": {}}
    cases = [({k: v for k, v in whole.items() if k != "meta"}, ["missing_key:meta"]), (whole | {"input": " "}, ["empty:input"]), (whole | {"meta": "x"}, ["meta_not_object"]), (whole | {"output": 3, "task": "x"}, ["empty:output", "task_mismatch:x"]), (whole, [])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string")
    got = {r.i: r.f for r in df.select("i", validate.schema_failures(F.try_parse_json("j"), F.lit("mrc")).alias("f")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


META = "struct<primary_ipc:string,document_type:string,model:string,provider:string,ipc_title:string,has_definition_entry:boolean>"


def test_validate_rules_and_report(spark):
    meta = ("G06N 3/08", None, None, None, None, None)
    data = [
        ("mrc", "1", "Which", "short", "the longer answer", meta),
        ("mrc", "2", "Which?", "the rotor is hollow and long", "rotor", meta),
        ("mrc", "3", "Which?", "the rotor is hollow and long", "zebra", meta),
        ("abstract_drafting", "4", "Draft", "claims about rotors", "nothing alike", meta),
        ("ipc_reasoning", "5", "Why", "x", "bad", None),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, f"task string, application_number string, instruction string, input string, output string, meta {META}")
    v = validate.validate(df)
    got = {r.application_number: r.validation.failed_rules for r in v.collect()}
    assert got["1"] == ["mrc_instruction_not_question", "mrc_answer_not_shorter_than_claims", "mrc_lexical_below_floor"] and got["2"] == [] and got["3"] == ["mrc_lexical_below_floor"]
    assert got["4"] == ["rouge_l_below_floor"] and got["5"] == ["meta_not_object", "primary_ipc_invalid", "output_parse_failed"] and len(got[None]) == 5
    r = {x.task: x for x in validate.report(v).collect()}
    assert r["mrc"].total == 3 and r["mrc"].passed == 1 and r["mrc"].fail_rule_counts["mrc_lexical_below_floor"] == 2 and r["abstract_drafting"].mean_token_f1 is None
    assert sum(x.total for x in r.values()) == sum(x.passed + x.rejected for x in r.values()) == 6


def test_generation_and_fetch(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")

    def chat():
        tries = {}

        def run(messages):
            first = messages[0]["content"]
            tries[first] = tries.get(first, 0) + 1
            return "no json" if first == "b" or tries[first] == 1 else '{"x": 1}'

        return run

    got = {r.prompt: (r.reply, r.error) for r in instruct.generate(df, chat, "prompt").collect()}
    assert got["a"] == ('{"x": 1}', None) and got["b"][0] is None and got["b"][1]
    assert instruct.grow_pool(lambda m: '["p", "q", "p"]', ["s"], 3, "more") == ["s", "p", "q"]

    def client():
        calls = {}

        def run(k):
            calls[k] = calls.get(k, 0) + 1
            if k == "404":
                raise api.FetchError(404)
            if calls[k] == 1:
                raise api.FetchError(503)
            return {"id": k}

        return run

    assert api.fetch_one(client(), "1", wait=lambda s: None) == {"id": "1"} and api.spacing(500) == 60 / 450
    ids = spark.createDataFrame([("404",)], "k string")
    assert api.fetch(ids, "k", client, 60_000, 1).first().error == "status 404"


def test_stream_resumes(spark, tmp_path):
    from quillstone.streaming.ingest import ingest, merged_report

    src = str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    run = lambda: ingest(spark, src, "id long", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    spark.range(5, 7).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    total = lambda d: d.agg(F.count("*").alias("n"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    merged_report(stream, str(tmp_path / "ck2"), str(tmp_path / "rep"), total, lambda a, b: a.union(b).agg(F.sum("n").alias("n"))).awaitTermination()
    last = max((tmp_path / "rep").iterdir(), key=lambda p: int(p.name.partition("=")[2]))
    assert spark.read.parquet(str(last)).first().n == 7
