import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillstone import run
from quillstone.functions import overlap, text
from quillstone.operators import classify, instruct, judge, relate, stats
from quillstone.sinks import shards, write_csv
from quillstone.sources import jsonl


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shards_are_numbered_continued_and_refused(spark, tmp_path):
    folder = str(tmp_path / "s")
    df = spark.range(25).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("none"))
    assert shards.write_shards(df, folder, ["n"], 10) == ["part-00000.jsonl.gz", "part-00001.jsonl.gz", "part-00002.jsonl.gz"]
    with gzip.open(f"{folder}/part-00002.jsonl.gz", "rt") as f:
        assert f.read().splitlines() == [json.dumps({"n": n, "none": None}, separators=(",", ":")) for n in range(20, 25)]
    with pytest.raises(FileExistsError):
        shards.write_shards(df, folder, ["n"], 10)
    assert shards.write_shards(df.limit(3), folder, ["n"], 10, mode="append", gzip=False) == ["part-00003.jsonl"]
    assert shards.close_shards(spark, folder) == ["part-00003.jsonl.gz"] and shards.close_shards(spark, folder) == []
    assert jsonl.read_shards(spark, folder).count() == 28 and shards.count_lines(spark, folder) == 28
    assert jsonl.next_shard(jsonl.read_shards(spark, folder)).first()[0] == 4
    assert shards.write_shards(df, folder, ["n"], 20, mode="force") == ["part-00000.jsonl.gz", "part-00001.jsonl.gz"]
    assert sorted(shards.shard_numbers(spark, folder).values()) == [0, 1]
    assert shards.write_shards(df.limit(0), str(tmp_path / "none"), ["n"], 10) == []


def test_legacy_files_are_packed(spark, tmp_path):
    (tmp_path / "old").mkdir()
    for i in range(5):
        (tmp_path / f"old/{i}.json").write_text(json.dumps({"x": i}))
    out = str(tmp_path / "new")
    assert shards.pack(spark, str(tmp_path / "old"), out, 2) == ["part-00000.jsonl.gz", "part-00001.jsonl.gz", "part-00002.jsonl.gz"]
    with pytest.raises(FileExistsError):
        shards.pack(spark, str(tmp_path / "old"), out, 2)
    assert len(shards.pack(spark, str(tmp_path / "old"), out, 3, force=True)) == 2


def test_limits(spark):
    df = spark.range(100).select(F.col("id").alias("n"), (F.col("id") % 3 == 0).alias("ok"))
    assert [relate.first_rows(df, ["n"], k).count() for k in (None, 7, 0, -1)] == [100, 7, 0, 0]
    assert [relate.until_successes(df, ["n"], F.col("ok"), k).count() for k in (None, 1, 4, 999, 0)] == [100, 1, 10, 100, 0]


def test_hot_key_is_numbered(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1), ("b", 2), ("b", 1), ("b", 1)], "k string, i int").repartition(5)
    got = rows(relate.running_number(df, "k", ["i"]))
    assert got == rows(spark.createDataFrame([("hot", i, i + 1) for i in range(500)] + [(None, 1, 1), ("b", 1, 1), ("b", 1, 2), ("b", 2, 3)], "k string, i int, claim_seq long"))
    assert relate.running_number(df.limit(0), "k", ["i"]).count() == 0


def test_predictions_of_several_files_meet_their_inputs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = [f"L{i} (0.{i % 90 + 10})" for i in range(60)]
    for k in range(3):
        (tmp_path / f"p/part-{k}.txt").write_text("\n".join(lines[k * 20 : k * 20 + 20]) + "\n")
    inputs = classify.claim_inputs(spark.createDataFrame([(f"a{i:02d}", f"text {i}", i) for i in range(62)], "k string, t string, i int"), "k", "t", ["i"])
    got = {r.row_index: list(r.labels) for r in classify.attach_predictions(inputs, jsonl.read_predictions(spark, str(tmp_path / "p"))).collect()}
    assert got == {i: [f"L{i}"] for i in range(60)}


def test_readers_of_the_classifier(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[PAD]\n[UNK]\npump\n##s\n")
    assert jsonl.read_vocabulary(spark, str(tmp_path / "vocab.txt")) == {"[PAD]": 0, "[UNK]": 1, "pump": 2, "##s": 3}
    (tmp_path / "in.tsv").write_text('group_ids\tid\tdate\ttext\nA01B\t1\td\ta "quoted text\n \t2\td\tx\nB02C\t3\td\ty\n')
    read = lambda n: [(r.group_ids, r.id, r.text) for r in jsonl.read_examples(spark, str(tmp_path / "in.tsv"), number_of_predictions=n).orderBy("row_index").collect()]
    assert read(-1) == [("A01B", "1", 'a "quoted text'), ("B02C", "3", "y")] and read(2) == [("A01B", "1", 'a "quoted text')]
    assert jsonl.SECTIONS == ["A", "B", "C", "D", "E", "F", "G", "H", "Y"]


def test_tasks_and_blocks(spark):
    df = spark.createDataFrame([("", 1), (None, 2), ("mrc", 3)], "task string, n int")
    assert rows(instruct.with_task(df, F.lit("x"))) == [("mrc", 3), ("x", 1), ("x", 2)]
    run_all = instruct.all_tasks({"zz": df.limit(1), "mrc": df.filter("n = 3"), "ipc_reasoning": df.filter("n = 2")})
    assert rows(run_all) == [("ipc_reasoning", 2, 0), ("mrc", 3, 1), ("zz", 1, 2)]
    m = spark.createDataFrame([(1, (None,), ("good",)), (2, None, ("bad",))], "id int, meta struct<a:string>, validation struct<v:string>")
    assert rows(judge.in_meta(m, "validation").select("id", "meta.a", "meta.validation.v")) == [(1, None, "good"), (2, None, "bad")]
    assert [r.role for r in m.select(judge.messages("s", F.lit("b")).alias("m")).first().m] == ["system", "user"]


def test_quantiles_of_any_column(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.normal(size=997)] + [0.5] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    for q in (0.0, 0.25, 0.99, 1.0):
        assert abs(stats.quantile(df, "v", q) - float(np.quantile(values, q))) < 1e-12
    assert stats.quantile(df.limit(0), "v", 0.5) is None


def test_words_are_counted_with_repeats(spark):
    df = spark.createDataFrame([("a a b c", "a b b a a"), ("", "x"), (None, None), ("w " * 20_000, "w " * 10_000)], "a string, b string")
    got = [r[0] for r in df.select(overlap.token_f1(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) for x in got] == [0.6667, 0.0, 0.0, 0.6667]


def test_marks_inside_claims(spark):
    c = "1. A pump comprising a rotor\u0001 and a stator of hardened steel. 2. The pump of claim 1,\u0002 wherein the rotor is hollow."
    r = spark.createDataFrame([(c,)], "c string").select(text.parse_claims(F.col("c")).alias("p")).first().p
    assert r.ok and r.claims == ["1. A pump comprising a rotor and a stator of hardened steel", "2. The pump of claim 1, wherein the rotor is hollow"]


def test_one_file_is_for_small_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        write_csv(spark.range(2000), str(tmp_path / "big"), one_file=True, most=100)
    write_csv(spark.range(20), str(tmp_path / "small"), one_file=True)
    assert spark.read.csv(str(tmp_path / "small"), header=True).count() == 20


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"io": {"input": "a"}, "judge": {"sample_size": 7, "headroom": 1}}))
    c = run.load(str(tmp_path / "c.json"), ["judge.seed=5", "force=true", "ipc_prefixes=A01B,H04"])
    assert (c.input, c.sample_size, c.headroom, c.seed, c.force, c.ipc_prefixes, c.truncate_chars) == ("a", 7, 1.0, 5, True, ("A01B", "H04"), 12_000)
    for bad in (["nope=1"], ["seed=x"], ["shard_size=0"], ["pass_score_min=9"], ["seed"], ["force=3"]):
        with pytest.raises(ValueError):
            run.load(None, bad)


def test_jobs_from_raw_to_report(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    claims = "1. A pump comprising a rotor and a stator of steel. 2. The pump of claim 1, wherein the rotor is hollow."
    with gzip.open(raw / "part-00000.jsonl.gz", "wt") as f:
        for i in range(5):
            f.write(json.dumps({"application_number": str(i) if i else "", "fetched_at": "t", "response": {"bibliographicData": {"ipcrClassification": [{"classificationText": "A01B 1/02", "sequenceNumber": 1}]}, "publishedDocuments": [{"documentTypeCode": "B2", "abstractText": "An abstract.", "claimsText": claims}]}}) + "\n")
    said = run.main(["clean", f"input={raw}", f"output={tmp_path}/clean", "shard_size=3"])
    assert said == ["part-00000.jsonl.gz", "part-00001.jsonl.gz"]
    r = run.main(["summary", f"input={tmp_path}/clean"]).first()
    assert (r.records, r.with_claims, r.without_abstract, r.claims) == (4, 4, 0, 8)
    run.main(["export", f"input={tmp_path}/clean", f"output={tmp_path}/csv", "limit=2"])
    assert spark.read.csv(f"{tmp_path}/csv/claims", header=True).count() == 4
    assert {r.metric: r.value for r in run.main(["label-report", f"input={tmp_path}/clean", f"output={tmp_path}/rep"]).collect()}["assignments"] == 4.0
