import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import ipc, overlap, text
from quillstone.functions.stem import porter
from quillstone.functions.wordpiece import basic_tokens, truncate_pair, wordpieces


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


CLAIMS = [
    ("CLAIMS1. A widget comprising a rotor and a stator. 2. The widget of claim 1, wherein the rotor is hollow.", ["1. A widget comprising a rotor and a stator", "2. The widget of claim 1, wherein the rotor is hollow"], True),
    ("1. A pen. 2. The pen of claim 1 wherein the cap is threaded.", [], False),
    ("[Claim 1] Grinder comprising a motor and a wheel. [Claim 2] Grinder as above with a guard fitted.", ["1. Grinder comprising a motor and a wheel", "2. Grinder as above with a guard fitted"], True),
    ("1. An apparatus having a long threaded shaft. 3. The apparatus wherein the shaft is steel.", ["1. An apparatus having a long threaded shaft"], True),
    ("1. A pump with an inlet valve assembly -23- debris 2. The pump having an outlet valve.", ["1. A pump with an inlet valve assembly", "2. The pump having an outlet valve"], True),
    ("", [], False),
    (" \n", [], False),
    (None, [], False),
]


def test_parse_claims(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLAIMS)], "i int, x string")
    got = {r.i: (r.p.claims, r.p.ok) for r in df.select("i", text.parse_claims(F.col("x")).alias("p")).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(CLAIMS)}


def test_parse_claims_long_text(spark):
    whole = " ".join(f"{i}. The widget number {'x' * 30} wherein the rotor is hollow." for i in range(1, 900))
    assert len(one(spark, whole, text.parse_claims).claims) == 899


def test_claim_words_are_removed_anywhere(spark):
    assert one(spark, "The method of claims 1 to 3", text.normalized_claims_text) == "The method of 1 to 3"


@pytest.mark.parametrize("numbers,want", [([1, 2, 2, 4], [1, 2]), ([2, 3], []), ([1, 2, 3], [1, 2, 3]), ([], [])])
def test_contiguous_prefix(spark, numbers, want):
    assert one(spark, numbers, lambda c: text.contiguous_prefix(c, lambda x: x), "array<int>") == want


@pytest.mark.parametrize("symbol,want", [("A01B0001020000", "A01B1/02"), ("A01B0001000000", "A01B1/00"), ("A01B0001100000", "A01B1/1"), ("A01", "A01"), (None, None)])
def test_format_symbol(spark, symbol, want):
    assert one(spark, symbol, ipc.format_symbol) == want
    if symbol == "A01B0001100000":
        assert one(spark, symbol, lambda c: ipc.format_symbol(c, fix_subgroup=True)) == "A01B1/10"


def test_prefixes(spark):
    assert one(spark, ["g06n 3/08"], lambda c: ipc.matches_prefixes(c, ["G06N,G06V"]), "array<string>")
    assert one(spark, ["A01"], lambda c: ipc.matches_prefixes(c, []), "array<string>")
    assert not one(spark, None, lambda c: ipc.matches_prefixes(c, ["A"]), "array<string>")


ANSWERS = [
    ("G06N 3/08", "Classification: G06N3/08\nJustification: Trains a network.", []),
    ("G06N 3/08", "Classification: G06N3/08\nJustification: Unlike H04L9/00.", ["conflicting_ipc_in_justification"]),
    ("G06N 3/08", "Classification: G06N 3/08\nJustification: x", ["output_parse_failed"]),
    (None, None, ["primary_ipc_invalid", "output_parse_failed"]),
    ("G06N 3/08", "Classification: H04\nJustification: x", ["classification_code_invalid", "ipc_code_mismatch"]),
]


def test_classification_failures(spark):
    df = spark.createDataFrame([(i, *a[:2]) for i, a in enumerate(ANSWERS)], "i int, p string, o string")
    got = {r.i: r.f for r in df.select("i", ipc.classification_failures(F.col("p"), F.col("o")).alias("f")).collect()}
    assert got == {i: a[2] for i, a in enumerate(ANSWERS)}


def test_overlap(spark):
    df = spark.createDataFrame([("a a b c", "a b b a a"), ("", "x"), (None, None)], "r string, c string")
    got = [r.f for r in df.select(overlap.token_f1(F.col("r"), F.col("c")).alias("f")).collect()]
    assert [round(x, 4) for x in got] == [0.6667, 0, 0]
    assert one(spark, "  The   Rotor ", lambda c: overlap.answer_contained(c, F.lit("the rotor is hollow")))
    assert not one(spark, "", lambda c: overlap.answer_contained(c, F.lit("x")))
    assert overlap.common_length("a b c d e f".split(), "x a c e g f".split()) == 4
    r = spark.createDataFrame([("running dogs", "the dog runs"), ("", "x"), (None, "x")], "r string, c string").select(overlap.rouge_l_f1("r", "c").alias("f")).collect()
    assert [round(x.f, 3) for x in r] == [0.4, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_length_is_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert overlap.common_length(a, b) == t[-1][-1]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_wordpiece():
    assert wordpieces("unaffable", {"un": 0, "##aff": 1, "##able": 2}) == ["un", "##aff", "##able"]
    assert wordpieces("x" * 201, {"x": 0}) == ["[UNK]"] and wordpieces("xq", {"x": 0}) == ["[UNK]"]
    assert basic_tokens("Héllo, wörld!\x00中文") == ["hello", ",", "world", "!", "中", "文"] and basic_tokens(None) == []


def test_truncate_pair(spark):
    for na, nb, most in ((5, 2, 4), (3, 3, 3), (1, 1, 5), (0, 4, 2), (6, 6, 7)):
        a, b = list(range(na)), list(range(nb))
        got = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(truncate_pair(F.col("a"), F.col("b"), most).alias("r")).first().r
        while len(a) + len(b) > most:
            (a if len(a) > len(b) else b).pop()
        assert (got.a, got.b) == (a, b)
