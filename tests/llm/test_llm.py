import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import defects, leak, neardup, quality, scans, survivor, terms, tokens

HAS_TOKENIZERS = os.path.isdir(tokens.TOKENIZER_DIR)
needs_tokenizers = pytest.mark.skipif(not HAS_TOKENIZERS, reason="no tokenizer files")

DOC = "struct<document_type_code:string,file_name:string,abstract:string,claims:array<string>,claims_parse_ok:boolean>"
CLEAN = f"rec_id long, application_number string, fetched_at string, primary_ipc string, ipcr_classification array<string>, published_documents array<{DOC}>, term string, member string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 2: best documents


def doc(code, abstract="", claims=(), ok=None):
    return (code, "f", abstract, list(claims) if claims is not None else None, ok)


def clean(spark, data):
    return spark.createDataFrame([(i, a, t, None, None, d, "", "") for i, a, t, d in data], CLEAN)


def test_best_documents(spark):
    df = clean(
        spark,
        [
            (1, " 1 0 ", "2024-01-01T00:00:00Z", [doc("A1", "A short one.", ["c"]), doc("b-2", "not available", ["c", " "])]),
            (2, "10", "2024-01-02T00:00:00Z", [doc("B2", "  ", ["c", None])]),
            (3, "20", "2024", [doc("A1")]),
            (4, "30", None, [doc(None, None, None), None, doc("Z")]),
            (5, "40", "2024", [doc("B9", "x", ["c"], False), doc("A1", "", ["c"])]),
            (5, "40", "2024", [doc("B9", "x", ["c"], False), doc("A1", "", ["c"])]),
            (6, None, "2024", [doc("A1", "x", ["c"])] * 2),
            (7, "50", "2024", None),
        ],
    )
    # B2 of record 2 was fetched later; the stand-in abstract has length 0, so only A1 has an abstract.
    assert rows(survivor.best_documents(df)) == [("10", 2, 0, 1, 0), ("30", -1, -1, -1, -1), ("40", 5, 1, 5, 0)]
    assert survivor.best_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,standin", [("", 1), ("n/a", 1), ("Abstract to follow", 1), ("???", 1), ("[abstract not available]", 1), ("A slotted pill counter.", 0), ("No text available at this time", 1), ("Soap.", 0), ("See Figure 1.", 0), ("要約", 0)])
def test_stand_ins(spark, text, standin):
    assert spark.createDataFrame([(text,)], "x string").select(survivor.is_stand_in(survivor.strip(F.col("x"))).alias("y")).first().y == bool(standin)


def test_source_quality_learns_who_lies(spark):
    rng = random.Random(1)
    votes = []
    for e in range(1500):
        for v in ("t1", "t2", "f1", "f2"):
            for s, sens, spec in (("good", 0.95, 0.95), ("fair", 0.8, 0.9), ("bad", 0.5, 0.55)):
                if rng.random() < (sens if v[0] == "t" else 1 - spec):
                    votes.append((f"e{e}", v, s))
    df = spark.createDataFrame([*votes, (None, "t1", "good"), ("e1", None, "good"), ("e1", "t1", "who")], "entity string, value string, source string")
    quality_of, judged = survivor.source_quality(df, ["good", "fair", "bad"])
    assert quality_of["good"][0] > quality_of["bad"][0] + 0.2 and quality_of["good"][1] > quality_of["bad"][1] + 0.2
    kept = [(r.value[0] == "t") == (r.p_true >= 0.5) for r in judged.collect()]
    assert sum(kept) / len(kept) > 0.9
    assert survivor.source_quality(df.limit(0), ["good"])[1].count() == 0
    # The same by aggregation, and with any number of sources.
    again, spread_out = survivor.source_quality(df, ["good", "fair", "bad"], rounds=12, driver_sources=1)
    once, _ = survivor.source_quality(df, ["good", "fair", "bad"], rounds=12)
    assert all(abs(a - b) < 1e-6 for s in once for a, b in zip(once[s], again[s])) and spread_out.count() == judged.count()
    many = [f"s{i}" for i in range(20)]
    wide = spark.createDataFrame([(f"e{e}", v, s) for e in range(60) for v in ("t", "f") for i, s in enumerate(many) if rng.random() < ((0.9 if i < 15 else 0.5) if v == "t" else (0.1 if i < 15 else 0.5))], "entity string, value string, source string")
    kept = {(r.entity, r.value): r.p_true >= 0.5 for r in survivor.source_quality(wide, many, rounds=15)[1].collect()}
    assert all(k == (v == "t") for (_, v), k in kept.items())


def test_stand_ins_are_judged_by_the_model(spark):
    data = [(i, str(i), "2024", [doc("A1", "No abstract." if i % 4 == 0 else f"A pump number {i} with a rotor and a stator.", ["A pump with a rotor and a stator."]), doc("A2", "None. " * 100 if i % 8 == 0 else "", ["c"])]) for i in range(80)]
    df = clean(spark, data).withColumn("invention_title", F.lit("Pump"))
    got = {r.application_number: r.abstract_pos for r in survivor.best_documents(df).collect()}
    assert got == {str(i): -1 if i % 4 == 0 else 0 for i in range(80)}


# 5: terms


@pytest.mark.parametrize(
    "raw,code",
    [("A01B 1/02", "A01B1/02"), (" h61n 90 / 59 ", "H61N90/59"), ("G59K0028590000", "G59K28/59"), ("A01B1234567890", "A01B1234/56789"), ("A01B0000000000", "A01B0/00"), ("a01b 0001/02", "A01B1/02"), ("A01B00001234/02", "A01B1234/02"), ("A01B12345/02", None), ("A01B0001000000", "A01B1/00"), ("B32B 82/58 (2018.01)", "B32B82/58"), ("H43H 28/33", "H43H28/33"), ("unknown", None), ("-", None), ("", None), (None, None), ("A01B", None)],
)
def test_canonical_code(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "x string").select(terms.canonical_code(F.col("x")).alias("y")).first().y == code


def test_term_counts_hot_and_split(spark):
    rng = random.Random(2)
    data = [("hot", f"m{rng.randrange(500)}") for _ in range(3000)] + [(f"t{rng.randrange(300)}", f"m{rng.randrange(500)}") for _ in range(3000)] + [(None, "m"), ("x", None)]
    df = spark.createDataFrame(data, "term string, member string")
    uses, members = Counter(), defaultdict(set)
    for t, m in data:
        if t and m:
            uses[t] += 1
            members[t].add(m)
    want = sorted((t, n, len(members[t])) for t, n in uses.items())
    for bits, split in ((3, 10**6), (3, 100), (1, 40), (2, 7)):
        assert rows(terms.term_counts(df, bits=bits, split_rows=split)) == want
    assert rows(terms.term_counts(df.withColumn("uses", F.lit(2)))) == [(t, 2 * n, m) for t, n, m in want]
    assert terms.term_counts(df.limit(0)).count() == 0


def test_marked_codes(spark):
    data = [(i, str(i), "t", "A01B 1/02", ["a01b1/02", "C07D 5/10", None] if i < 3 else None, None, "", "") for i in range(40)] + [(99, None, "t", "Z", ["H01B 2/22"], None, "", "")]
    got = {r.code: (r.uses, r.applications, r.mark) for r in terms.marked_codes(spark.createDataFrame(data, CLEAN)).collect()}
    assert got == {"A01B1/02": (43, 40, "common"), "C07D5/10": (3, 3, "common")}


# 3 and 8: tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary.load(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def texts_for_tokens():
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x2FFF), rng.randrange(0x1F000, 0x1FFFF), 32, 10])) for _ in range(3000)) for _ in range(5)]
    return [*odd, "a" * 5000, " " * 3000 + "x", "aaaaaab" * 300, "It's <|endoftext|> a\x1c\x1d b c　d", "don't we'll IT'S", "", "\n\n \n", "".join(rng.choice("abcde -_=\n") for _ in range(30000))]


@needs_tokenizers
def test_encoding_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    texts = texts_for_tokens()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None, texts[0]])], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == [] and got[len(texts) + 1] == want[0]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@needs_tokenizers
def test_prefixes_appends_and_edits(vocabulary):
    rng = random.Random(4)
    whole = lambda s: tokens.PrefixEncoder(vocabulary.engine, s)
    for _ in range(200):
        s = bytes(rng.choice(b"abcdefgh the") for _ in range(rng.randrange(0, 400)))
        e = whole(b"")
        for i in range(0, len(s), 7):
            e.append(s[i : i + 7])
        assert e.last == whole(s).last and b"".join(vocabulary.tokens[t] for t in e.tokens()) == s
        i = rng.randrange(0, len(s) + 1)
        j, new = min(len(s), i + rng.randrange(0, 5)), bytes(rng.choice(b"abcthe ") for _ in range(rng.randrange(0, 5)))
        e.replace(i, j, new)
        assert e.last == whole(s[:i] + new + s[j:]).last


@needs_tokenizers
def test_symbol_merging_counts_tokens(vocabulary):
    import regex

    pieces = sorted({p for t in texts_for_tokens() for p in regex.findall(tokens.PRE_SPLIT, t)})
    encoder = tokens.TextEncoder(vocabulary)
    counts = tokens.count_symbols([p.encode() for p in pieces], tokens.MergeTable(vocabulary))
    assert counts.tolist() == [len(encoder.piece(p)) for p in pieces]


@needs_tokenizers
def test_token_budget(spark, vocabulary):
    data = [("s", " EN", "A01B 1/02", "one two", "three", 1), ("s", "en-AU", "a01b1/02", None, "", 1), (None, None, "none", "x", None, 1), (None, "", None, None, None, 1)]
    df = spark.createDataFrame(data, "source string, lang string, primary_ipc string, abstract string, claims_text string, n int")
    e = tokens.TextEncoder(vocabulary)
    assert rows(tokens.token_budget(df)) == [("s", "en", "A", 2, 12, len(e.encode("one two")) + len(e.encode("three"))), ("unknown", "unknown", "unknown", 2, 1, 1)]
    assert tokens.token_budget(df.limit(0)).count() == 0


# 4: defects


@pytest.fixture(scope="module")
def languages(spark):
    en = [f"The rotating shaft {i} of the machine is held by a bearing and moves with the lever" for i in range(40)]
    de = [f"Die Welle {i} der Maschine wird durch ein Lager gehalten und bewegt sich mit dem Hebel" for i in range(40)]
    return spark.createDataFrame([(t, "EN " if i % 2 else "en-AU") for i, t in enumerate(en)] + [(t, "de") for t in de] + [(None, "en"), ("x", None), ("kurz", "fr"), ("Un petit appareil de mesure pour les eaux de la ville.", "fr")], "text string, lang string")


CLAIMS = "1. A pump comprising a rotor, a stator and a casing which holds the rotor near the stator.\n\n2. The pump of claim 1, wherein the rotor has a width of between 10 and 20 mm."
PAIRS = [
    ("mrc", "What width does the rotor have?", CLAIMS, "between 10 and 20 mm", None),
    ("mrc", "What width does the rotor have?", CLAIMS, "The rotor has a width of between", "truncated"),
    ("mrc", "What width does the rotor have?", CLAIMS, "what width does the rotor have", "copy"),
    ("mrc", "What width does the rotor have?", CLAIMS, CLAIMS, "copy"),
    ("mrc", "What width does the rotor have?", CLAIMS, "The pump of claim 1, wherein the rotor has a width of between 10 and 20 mm.", None),
    ("abstract_drafting", "Draft an abstract.", CLAIMS, "A device moves fluid by turning blades inside a housing of steel.", None),
    ("abstract_drafting", "Draft an abstract.", CLAIMS, "A device moves fluid by turning blades inside a hou", "truncated"),
    ("ABSTRACT_DRAFTING", "Draft an abstract.", CLAIMS, "Abstract: " + CLAIMS.upper(), "copy"),
    ("abstract_drafting", "Draft an abstract.", CLAIMS, "Eine Maschine bewegt die Welle und der Hebel wird durch ein Lager gehalten.", "language"),
    (None, None, None, "I'm sorry, but I can't help with that request.", "refusal"),
    ("ipc_reasoning", "Why?", CLAIMS, "Classification: A01B1/02\nJustification: I must decline to answer.", "refusal"),
    ("ipc_reasoning", "Why?", CLAIMS, "Classification: A01B1/02\nJustification: Machines with turning blades belong here.", None),
    (None, None, None, None, "empty"),
    ("mrc", "Q?", CLAIMS, " \t​…", "empty"),
    ("mrc", "Q?", CLAIMS, "Answer:", "empty"),
    ("mrc", "Q?", CLAIMS, "<empty>", "empty"),
    ("abstract_drafting", "Draft an abstract.", CLAIMS, "I'm sorry, but I can't help with that request. " * 110, "refusal"),
    ("abstract_drafting", "Draft an abstract.", CLAIMS, "The pump declines to start while the rotor is unable to turn.", None),
    ("mrc", "Q?", CLAIMS, "none " * 20, "empty"),
    ("mrc", "What width does the rotor have?", CLAIMS, "between 10 and 20 m", "truncated"),
    ("abstract_drafting", "Draft", CLAIMS * 300, "A device moves fluid by turning blades. " * 3000, None),
]


def test_broken_pairs(spark, languages):
    df = spark.createDataFrame([(i, *p[:4], "x") for i, p in enumerate(PAIRS)], "row_id long, task string, instruction string, input string, output string, defect string")
    got = {r.row_id: r.defect for r in defects.broken_pairs(df, languages).collect()}
    assert got == {i: p[4] for i, p in enumerate(PAIRS) if p[4]}
    assert defects.broken_pairs(df.limit(0), languages).count() == 0
    assert set(r.defect for r in defects.broken_pairs(df, languages.limit(0)).collect()) <= {"empty", "refusal", "copy", "truncated"}


def test_declining_is_learned(spark):
    rng = random.Random(14)
    said = ["I'm sorry, but I can't help with that request.", "I must decline to answer.", "Unfortunately I am unable to do this for you."]
    tails = ["You may wish to contact the patent office.", "I hope you understand."]
    data = [(CLAIMS, rng.choice(said) + " " + rng.choice(tails)) for _ in range(40)] + [(CLAIMS, f"A device with {i} blades moves fluid inside a housing. It cannot be opened by hand.") for i in range(80)]
    model = defects.train_declining(spark.createDataFrame([*data, (None, None), (None, "")], "input string, output string"))
    assert model.is_refusal("I hope you understand. I must decline to help.", CLAIMS) and not model.is_refusal("It cannot be opened by hand.", CLAIMS)
    assert model.is_refusal("I must decline to answer. " * 500, CLAIMS) and not model.is_refusal("I must decline to answer. " + "A device moves fluid inside a housing. " * 5, CLAIMS)


def test_language_model_on_held_out_texts(spark, languages):
    model = defects.train_languages(languages)
    assert model.names == ["de", "en", "und"]
    assert model.differ("Der Hebel bewegt die Welle der Maschine", "The lever moves the shaft of the machine") and not model.differ("The lever holds a bearing", "A bearing is held by the shaft")


# 6: near duplicates


def shingle_sets(texts, n):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return out


def near_truth(texts, n, least):
    s = {i: x for i, x in shingle_sets(texts, n).items() if x}
    return sorted((a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= least * len(s[a] | s[b]))


def edited_texts(seed=5, groups=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, i = {}, 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts[i] = " ".join(t)
            i += 1
    return texts


@pytest.mark.parametrize("part", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, part):
    texts = edited_texts()
    texts |= {900: texts[0], 901: texts[0].upper(), 902: "too short", 903: ""}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(904, None, 1), (3, texts[3], 2), (0, texts[0], 2)], "text_id long, t string, a int")
    members, links = neardup.near_duplicates(df, "text_id", F.col("t"), words=3, similarity=0.5, part=part)
    assert rows(neardup.expand(members, links)) == sorted(near_truth(texts, 3, 0.5), key=repr)
    assert members.filter("id = class_id").count() + 2 <= members.count()


def test_near_duplicates_defaults_and_empty(spark):
    texts = edited_texts(6, 12)
    df = spark.createDataFrame(list(texts.items()), "text_id long, t string")
    assert rows(neardup.expand(*neardup.near_duplicates(df, "text_id", F.col("t")))) == sorted(near_truth(texts, 5, 0.8), key=repr)
    assert neardup.expand(*neardup.near_duplicates(df.limit(0), "text_id", F.col("t"))).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(7)
    s = rng.integers(0, 256, (300, neardup.BITS // 8), np.uint8)
    s[100:200] = s[:100] ^ (rng.random((100, neardup.BITS // 8)) < 0.1).astype(np.uint8)
    a, b = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    a[:100], b[:100] = np.arange(100), np.arange(100, 200)
    radius = rng.integers(0, 260, 5000)
    distance = np.unpackbits(s[a] ^ s[b], axis=1).sum(axis=1)
    assert (neardup.within(s, a, b, radius, lanes=777) == (distance <= radius)).all()


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x = rng.integers(0, 2**63, 200, np.uint64)
        y = np.r_[x[: rng.integers(1, 200)], rng.integers(0, 2**63, rng.integers(1, 100), np.uint64)]
        x, y = np.unique(x), np.unique(y)
        one, two = neardup.sketch(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]))
        d = np.unpackbits(one ^ two).sum()
        assert d <= len(np.setxor1d(x, y))


# 7: scans


LEXICON = scans.Lexicon({w: 50 for w in "a an the of claim wherein rotor stator is made steel comprising and hollow wedge shaped between mm pump resin at least as claimed in by surrounds having when load".split()})
SCANS = [
    ("1. A pump comprising a rotor and a sta-\ntor.\n2. The pump of claim 1, wherein the rotor is hollow.", {"hyphen"}),
    ("1. A pump comprising a ro­\n\nPage 3 of 9\ntor and a stator.", {"hyphen", "page_no"}),
    ("1. A wedge-\nshaped pump comprising a rotor.", set()),
    ("1. A pump cornprising a r0tor and a stator.", {"misread"}),
    ("1. A pump having at least 2O of the rotor.", {"misread"}),
    ("1. A pump comprising a rotor\nWO 2015/246129  PCT/AU2015/046129\nand a stator.", {"header"}),
    ("1. A pump comprising a rotor\nAMENDED SHEET\n- 4 -\nand a stator.", {"header", "page_no"}),
    ("1. A pump comprising a rotor\r\nNabosa Handling Pty Ltd - Hollow pump\r\n[12]\r\nand a stator.", {"header", "page_no"}),
    ("CLAIMS\n1. A pump of steel, the stator -69- wherein.\n2. The pump of claim 1 as made by AX-7.", set()),
    ("", set()),
    (None, set()),
    (" \n\f", set()),
]


@pytest.mark.parametrize("text,kinds", SCANS)
def test_scan_kinds(text, kinds):
    assert scans.repair(text, LEXICON)[0] == kinds


def test_scan_repair_gives_paragraphs():
    noisy = "1. A pump cornprising a ro-\n\x0c\n- 5 -\ntor and a stator. 2. The pump\nAMENDED SHEET\nof claim 1, wherein the rotor is hollow."
    assert scans.repair(noisy, LEXICON)[1] == "1. A pump comprising a rotor and a stator.\n2. The pump of claim 1, wherein the rotor is hollow."
    assert scans.paragraphs("3. Of 12. It 1. A pump. 2. The pump.") == ["3. Of 12. It", "1. A pump.", "2. The pump."]


def test_scan_splits_and_merges(spark):
    noisy = "1. A pump com prising a rotor andstator wherein the ro tor is hol low. 2. The pumpof claim 1, wherein the zaxeloqide is made ofsteel."
    mended = "1. A pump comprising a rotor and stator wherein the rotor is hollow.\n2. The pump of claim 1, wherein the zaxeloqide is made of steel."
    assert scans.repair(noisy, LEXICON) == (set(), mended)
    assert scans.repair("1. A pump compri5ing a ro-\ntor andst-\nator", LEXICON)[1] == "1. A pump comprising a rotor and stator"
    words = spark.createDataFrame([(" ".join(LEXICON.counts),)] * 50, "t string")
    df = spark.createDataFrame([(1, noisy), (1, noisy), (2, None)], "scan_id long, claims_text string")
    assert rows(scans.scan_noise(df, [(words, "t")])) == [(1, [], mended), (2, [], "")]


JOINT_NOISE = [
    ("A pump and5tator", {"misread"}, "A pump and stator"),
    ("The comp ri5ing rotor iscl aimed", {"misread"}, "The comprising rotor is claimed"),
    ("thep ump andthestator", set(), "the pump and the stator"),
    ("A pump and5-\ntator of sta-\nto r", {"hyphen", "misread"}, "A pump and stator of stator"),
    ("A wedge-\nshaped zaxel oqide Nabosa pump", set(), "A wedge-shaped zaxel oqide Nabosa pump"),
]


def test_scan_noise_is_decoded_jointly(spark):
    assert [scans.repair(t, LEXICON) for t, _, _ in JOINT_NOISE] == [(k, m) for _, k, m in JOINT_NOISE]
    words = spark.createDataFrame([(" ".join(LEXICON.counts),)] * 50, "t string")
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(JOINT_NOISE)], "scan_id long, claims_text string")
    assert rows(scans.scan_noise(df, [(words, "t")])) == [(i, [k for k in scans.KINDS if k in kinds], m) for i, (_, kinds, m) in enumerate(JOINT_NOISE)]


def test_no_cheaper_reading_of_a_stretch_is_lost():
    def cheapest(words):  # all edges, by brute force
        text, ends = "".join(words), set(np.cumsum([len(w) for w in words]).tolist())
        best = [0.0] + [np.inf] * len(text)
        for q in range(1, len(best)):
            for p in range(q):
                known, inside = LEXICON.read(text[p:q]), sum(p < e < q for e in ends)
                if known or not inside:
                    best[q] = min(best[q], best[p] + scans._cost(text[p:q], known, LEXICON.total) + scans.MERGED * inside + scans.SPLIT * (q not in ends))
        return best[-1]

    def price(said, words):  # of the text that was chosen, by what each of its words was
        text, ends, at, cost = "".join(words), set(np.cumsum([len(w) for w in words]).tolist()), 0, 0.0
        for w in said.split():
            q = min((q for q in range(at + 1, len(text) + 1) if text[at:q] == w or (LEXICON.read(text[at:q]) or "")[:1] == (w,)), key=lambda q: abs(q - at - len(w)))
            cost += scans._cost(text[at:q], LEXICON.read(text[at:q]), LEXICON.total) + scans.MERGED * sum(at < e < q for e in ends) + scans.SPLIT * (q not in ends)
            at = q
        return cost

    rng = random.Random(7)
    for _ in range(300):
        text = " ".join(rng.choice([*LEXICON.counts, "zaxeloqide"]) for _ in range(4))
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(1, len(text))
            text = rng.choice([text[:k] + " " + text[k:], text[:k].rstrip(" ") + text[k:].lstrip(" "), text.replace("e", "c", 1), text.replace("m", "rn", 1)])
        words = text.split()
        assert price(scans.repair(text, LEXICON)[1], words) == pytest.approx(cheapest(words)), text


def test_long_unknown_stretches():
    text = "qzx" * 5000 + " " + " ".join(["zqvk"] * 3000)
    assert scans.repair(text, LEXICON) == (set(), text)
    assert scans.repair("-\n".join(["zqvk"] * 2000) + " wedge-\nshaped ro-\nt-\nor", LEXICON) == ({"hyphen"}, "zqvk" * 2000 + " wedge-shaped rotor")


def test_keys_of_misreadings_agree(spark):
    rng = random.Random(13)
    for seen, meant in scans.CONFUSIONS.items():
        for was in meant if len(seen) == 1 and len(meant) > 1 else [meant]:
            a, b = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)), "stone"
            assert scans.reading_key(a + seen + b) == scans.reading_key(a + was + b), (seen, was)
    words = ["clamp", "1iii", "kwd", "bh6", "A"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(scans._key_column(F.col("w")))
    assert [r[0] for r in df.collect()] == [scans.reading_key(w) for w in words]


def test_claims_of_any_number():
    text = " ".join(f"{i}. A claim of steel." for i in range(1, 2500))
    assert len(scans.paragraphs(text)) == 2499


def test_scan_operator(spark):
    clean_texts = spark.createDataFrame([("1. A pump comprising a rotor and a stator. 2. The pump of claim 1, wherein the rotor is hollow.",)] * 5, "t string")
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(SCANS[:2] + SCANS[-3:])] + [(50, "1. A pump. " * 20000, "x")], "scan_id long, claims_text string, kinds string")
    got = {r.scan_id: set(r.kinds) for r in scans.scan_noise(df, [(clean_texts, "t")]).collect()}
    assert got == {0: {"hyphen"}, 1: {"hyphen", "page_no"}, 2: set(), 3: set(), 4: set(), 50: set()}
    assert scans.scan_noise(df.limit(0), [(clean_texts.limit(0), "t")]).count() == 0


# 9: leaks


def leak_truth(docs, items, n=12):
    index = defaultdict(set)
    for i, t in items.items():
        w = leak.words_of(t)
        for k in range(len(w) - n + 1):
            index[tuple(w[k : k + n])].add(i)
    return sorted({(d, i) for d, t in docs.items() for w in [leak.words_of(t)] for k in range(len(w) - n + 1) for i in index.get(tuple(w[k : k + n]), ())})


def leak_data(seed=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))) for i in range(20)}
    docs = {}
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            source = items[rng.randrange(20)].split()
            a = rng.randrange(len(source))
            w[10:10] = source[a : a + rng.randrange(8, 30)]
        docs[d] = ", ".join(w).title()
    return docs, items


@pytest.mark.parametrize("sample", [10_000, 20])
def test_verbatim_equals_brute_force(spark, sample):
    docs, items = leak_data()
    docs[1000] = " ".join(docs.values())
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(2000, None, 1), (2001, "", 1), (0, docs[0], 1)], "doc_id long, text string, item_id int")
    qs = spark.createDataFrame([*items.items(), (77, None), (78, "")], "item_id long, text string")
    assert rows(leak.verbatim(df, qs, sample=sample)) == sorted(leak_truth(docs, items), key=repr)
    assert leak.verbatim(df.limit(0), qs).count() == 0 and leak.verbatim(df, qs.limit(0)).count() == 0


def test_paraphrases_recall(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(300)]
    items = {i: [rng.choice(vocab) for _ in range(40)] for i in range(10)}
    docs, want = {}, set()
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(60)]
        if d % 2:
            i = rng.randrange(10)
            para = [x for x in items[i] if rng.random() > 0.1]
            w[20:20] = para
            want.add((d, i))
        docs[d] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    qs = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.paraphrased(df, qs).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2


@pytest.mark.parametrize("operator", [leak.verbatim, leak.paraphrased])
def test_space_counts_all_texts(spark, monkeypatch, operator):
    texts = [f"alpha w{i} w{i % 7} beta" for i in range(12_000)]
    made = []
    fit = leak.latent_space
    monkeypatch.setattr(leak, "latent_space", lambda corpus, words, rank: made.append((words, fit(corpus, words, rank)[1])) or fit(corpus, words, rank))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:500], None])], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "alpha w3 w11 beta gamma")], "item_id long, text string")
    operator(df, qs).count()
    words, idf = made[0]
    get = words.lookup().__getitem__ if isinstance(words, leak._HashedVocabulary) else words.get
    df = np.zeros(len(words))
    for t in texts:  # each is one passage, repeated ones count once
        for w in {get(w) for w in leak.words_of(t)} - {None}:
            df[w] += 1
    assert idf == pytest.approx(np.log1p(1 / ((df + 1) / (df.sum() + 1))))


def test_products_of_long_texts_in_parts(spark):
    words = {f"w{i}": i for i in range(5)}
    rng = random.Random(4)
    text = " ".join(rng.choice([*words, "other"]) for _ in range(4 * 1500))
    basis = np.random.default_rng(1).standard_normal((5, 3))
    share = spark.sparkContext.broadcast
    product, df = leak._gram_product(spark.createDataFrame([(text,), ("",), ("other",)], "text string"), share(words), 3, share(basis), 4)
    cut = [text.split()[i : i + 4] for i in range(0, 4 * 1500, 4)]
    a = np.array([[p.count(w) for w in words] for p in cut], float)
    assert product == pytest.approx(a.T @ (a @ basis)) and df.tolist() == (a > 0).sum(axis=0).tolist()


# 10: quality


KINDS = [
    ("The pump has a rotor which is held by a bearing, and the casing of the pump is made of steel.", "prose"),
    ("Насос имеет ротор, который удерживается подшипником, и корпус насоса выполнен из стали.", "prose"),
    ("该泵具有转子，转子由轴承保持，泵的壳体由钢制成。当杠杆移动时，轴旋转。", "prose"),
    ("Pompa ma wirnik, który jest podtrzymywany przez łożysko, a obudowa pompy jest wykonana ze stali.", "prose"),
    ("펌프는 베어링에 의해 지지되는 회전자를 가지며 펌프의 하우징은 강철로 만들어진다.", "prose"),
    ("本発明の装置は、供給筒と、駆動容器に接続された圧縮歯車とを備える。", "prose"),
    ("11 - rotor arm\n15 - steel lever bush\n17 - pump casing lever\n18 - bearing rotor", "list"),
    ("rotor arm; steel lever; pump casing; bearing rotor; lever arm; casing pump; " * 9, "list"),
    ("B28G 20/42\nC19F 5/90\nE13G 9/76", "list"),
    ("Sample\tflow\tpitch\nR1\t405.2\t593\nR2\t12.1\t44\nR3\t<0.1\t3", "table"),
    ("Sample;" + "1" * 100 + ";" + "2.5;" * 60, "table"),
    ("00000000  f3 a4 d3 35 12 48 8f 1f 2e b8 ba 8e\n00000010  99 0e 89 ea 35 50 87 e2", "junk"),
    ("@!%% ]}/ ~% \\^`][= ]:|@>@+-~/ [@:*+", "junk"),
    ("mppu trroo vlleer gnbrea gncsai mra hbsu tlsee lhweel mrfae ppumm rtoro lreev gnrbea.", "junk"),
    ("", None),
    (None, None),
    (" \n​", None),
]


@pytest.fixture(scope="module")
def prose_corpus(spark):
    rng = random.Random(12)
    heads = ["pump", "rotor", "lever", "bearing", "casing", "arm", "bush", "steel", "wheel", "frame"]
    part = [a + b for a in heads for b in [*heads, "", "er"]]
    said = ["The {} of the {} is held by a {} and moves with the {}.", "A {} which has a {} is set in the {} of a {}.", "In use the {} turns and the {} is drawn to a {} by the {}."]
    texts = [" ".join(rng.choice(said).format(*rng.sample(part, 4)) for _ in range(4)) for _ in range(400)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11))) for _ in range(400)]
    return spark.createDataFrame([(t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(" ".join(noise[i : i + 20]), "en") for i in range(0, 400, 20)], "text string, lang string")


def test_text_quality(spark, prose_corpus):
    language = quality.learn(prose_corpus, lang_col="lang")
    assert {"the", "a", "is"} <= language.common and "pump" not in language.common
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(KINDS)], "doc_id long, text string, words string")
    got = {r.doc_id: r.kind for r in quality.text_quality(df, language=language).collect()}
    assert got == {i: k for i, (_, k) in enumerate(KINDS)}
    r = quality.text_quality(spark.createDataFrame([(1, "One two.\nThree four\n")], "doc_id long, text string")).first()
    assert (r.words, r.lines, r.ended_line_share, r.symbol_ratio) == (4, 2, 0.5, 1 / 16) and r.mean_word_length == 3.75
    assert quality.text_quality(df.limit(0)).count() == 0


def test_languages_the_corpus_knows_nothing_of(spark):
    df = spark.createDataFrame([(i, t) for i, (t, k) in enumerate(KINDS) if k == "prose"], "doc_id long, text string")
    assert {r.kind for r in quality.text_quality(df).collect()} == {"prose"}


def test_chunks_add_up(spark, prose_corpus):
    rng = random.Random(11)
    language = quality.learn(prose_corpus, lang_col="lang")
    texts = [" ".join(rng.choice([t for t, _ in KINDS if t]) for _ in range(12)) for _ in range(20)] + ["x" * 5000, "ab " * 3000, "é。" * 900, "One two. \n\n" * 300, " " * 500 + "\n" * 400 + "a. b.  c\n."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (3, texts[3])], "doc_id long, text string")
    whole = rows(quality.text_counts(df, language))
    assert len(whole) == len(texts) and whole == rows(quality.text_counts(df, language, chunk=7)) == rows(quality.text_counts(df, language, chunk=100))


# Registered queries against SQL


def test_against_sql(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    import duckdb

    from quillstone.llm.oracle import ORACLE
    from quillstone.llm.queries import QUERIES

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    for name, sql in ORACLE.items():
        QUERIES[name](spark, data).write.parquet(str(tmp_path / name))
        a, b = con.sql(f"SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')"), con.sql(sql)
        cols = ", ".join(f'"{c}"' for c in sorted(b.columns))
        assert con.sql(f"(SELECT {cols} FROM a EXCEPT ALL SELECT {cols} FROM b) UNION ALL (SELECT {cols} FROM b EXCEPT ALL SELECT {cols} FROM a)").fetchall() == [], name
