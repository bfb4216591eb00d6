from pyspark.sql import functions as F

from quillstone.operators import evaluate


def test_levels(spark):
    df = spark.createDataFrame([("A01B 1/02", "A01B1/03"), ("A01B1/02", "a01b 1/02"), ("H04L 9/00", None), (None, "A01B1/02"), ("A01B1/02", "nonsense")], "t string, g string")
    r = evaluate.hierarchy_accuracy(df, F.col("t"), F.col("g")).first()
    assert (r.rows, r.well_formed, r.section_accuracy, r.subclass_accuracy, r.group_accuracy, r.full_accuracy) == (4, 0.5, 0.5, 0.5, 0.5, 0.25)
    assert evaluate.hierarchy_accuracy(df.limit(0), F.col("t"), F.col("g")).first().rows == 0


def test_ngrams_and_exact(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("a", "a"), (None, "x y"), ("a  B", "A b")], "r string, c string")
    got = [tuple(x) for x in df.select(evaluate.ngram_f1(F.col("r"), F.col("c"), 2), evaluate.exact_match(F.col("r"), F.col("c"))).collect()]
    assert got == [(0.5, False), (0.0, True), (0.0, False), (1.0, True)]


def test_kappa(spark):
    data = [(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15 + [(None, True)]
    r = evaluate.kappa(spark.createDataFrame(data, "a boolean, b boolean"), "a", "b").first()
    assert (r.n, r.agreement, r.kappa) == (50, 0.7, 0.4)


def test_split_keeps_keys_together(spark):
    df = spark.range(4000).select((F.col("id") % 1000).cast("string").alias("k")).withColumn("p", evaluate.split_of(F.col("k"), [("train", 0.8), ("dev", 0.1), ("test", 0.1)]))
    assert df.groupBy("k").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0
    n = {r.p: r["count"] for r in df.groupBy("p").count().collect()}
    assert 700 < n["train"] / 4 < 880 and set(n) == {"train", "dev", "test"}
    assert spark.createDataFrame([(None,)], "k string").select(evaluate.split_of(F.col("k"), [("a", 0.5), ("b", 0.5)]).alias("p")).first().p is None
